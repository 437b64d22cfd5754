"""Operator 5: benchmark decontamination by SimHash over item-sized windows.

Every benchmark item and every item-sized window of every document gets a 64-bit SimHash of its 5-word shingles (each
occurrence counts, so repeated shingles weigh more). Item lengths are grouped in classes at most CLASS_RATIO wide; a
document is cut into windows of each class's length at steps of an eighth of it, and a document shorter than a window is
one window. A multi-index of BLOCKS 16-bit blocks finds all fingerprints within RADIUS: of the blocks of two such
fingerprints one differs in RADIUS div BLOCKS bits at most, so each block's table lists the items for every value within
that distance. What passes the full Hamming test is verified exactly: the weighted Jaccard similarity (sum of the lower
over sum of the higher shingle counts) of the item and a window of the item's own length, the best of the places around
the candidate. A document leaks an item from a similarity of 0.8.

Fingerprints alone miss some near copies: they are samples, and the windows lie on a grid. So places are counted too: a
window of w shingles and an item of n reach 0.8 only if 4/9 (w + n) of the window's shingles occur in the item. Every window
of an item's own length, at every position, that holds so many is verified as well. This bound drops nothing that reaches
0.8, so the pairs and their best places are complete.

The index of the items is made in tasks and kept as Parquet in the shared folder, in slices of at most SLICE_ITEMS items and
SLICE_BYTES bytes of text (or one longer item). Documents are read once: a task that holds a piece of them goes through the
slices one after the other, so it holds one slice at a time and nothing is broadcast, whatever the benchmark's size.

Defined results: null, empty and blank texts match nothing, on either side; texts with fewer than five words have one
shingle, the whole sequence; repeated rows of either table give repeated rows (repeated items are indexed once, with their
number); equal doc_ids are not merged; ties of places go to the first; items and documents may have any length; empty tables
give an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, pieces, shared_dir, shingle_hashes, table, word_hashes
from .warc import _file_system

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, CLASS_RATIO, STEPS = 15, 4, 1.12, 8
SLICE_ITEMS, SLICE_BYTES = 1024, 4 << 20
SEGMENT = 1 << 15
PIECE, PIECE_OF_MANY = 1 << 20, 4 << 20  # bytes of documents that meet the slices at once: of one slice, of several
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, words long"
INDEX = "slice string, item_id long, copies long, shingles long, print long, values array<long>, counts array<long>"


def shingle_runs(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts in order, and of every text the index of its first."""
    words, first = word_hashes(column)
    runs = shingle_hashes(words, size)
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    start = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(start[-1], np.uint64)
    for i in np.flatnonzero((n > 0) & (n < size)):
        out[start[i]] = shingle_hashes(words[first[i] : first[i + 1]], int(n[i]))[0]
    long = np.flatnonzero(n >= size)
    if len(long):
        shift = np.repeat(first[long] - start[long], counts[long])
        to = np.concatenate([np.arange(start[i], start[i + 1]) for i in long])
        out[to] = runs[to + shift]
    return out, start


def _bits(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(ones: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHashes of windows from how many of their shingles have each bit."""
    return np.packbits(ones > (sizes // 2).astype(ones.dtype)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _long_simhashes(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHashes of few and long windows: running sums are kept at their borders only."""
    borders = np.unique(np.concatenate((starts, ends)))
    sums, total = np.zeros((len(borders), 64), np.int64), np.zeros(64, np.int64)
    for lo in range(0, len(shingles), SEGMENT):
        run = np.cumsum(_bits(shingles[lo : lo + SEGMENT]), axis=0, dtype=np.int64)
        i, j = np.searchsorted(borders, (lo, lo + len(run)), side="right")
        sums[i:j] = total + run[borders[i:j] - lo - 1]
        total += run[-1]
    return _majority(sums[np.searchsorted(borders, ends)] - sums[np.searchsorted(borders, starts)], ends - starts)


def simhashes(shingles: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """SimHashes of lists of windows (starts, ends) of the shingle sequence, each list in order of its starts.

    Running sums of the shingles' bits are built once for each segment of the sequence and serve all lists; windows longer
    than a segment have a pass of their own.
    """
    out = [np.empty(len(starts), np.uint64) for starts, _ in windows]
    short = [np.flatnonzero(ends - starts <= SEGMENT) for starts, ends in windows]
    brief = [(starts[at], ends[at]) for at, (starts, ends) in zip(short, windows, strict=True)]
    reach = max((int((ends - starts).max()) for starts, ends in brief if len(starts)), default=0)
    wide = np.uint8 if reach < 256 else np.uint32  # sums may wrap: only differences count
    for lo in range(0, len(shingles), SEGMENT):
        parts = [np.searchsorted(starts, (lo, lo + SEGMENT)) for starts, _ in brief]
        if all(i == j for i, j in parts):
            continue
        bits = _bits(shingles[lo : lo + SEGMENT + reach])
        sums = np.zeros((len(bits) + 1, 64), wide)
        np.cumsum(bits, axis=0, dtype=wide, out=sums[1:])
        for prints, at, (starts, ends), (i, j) in zip(out, short, brief, parts, strict=True):
            ones = sums[ends[i:j] - lo]
            ones -= sums[starts[i:j] - lo]
            prints[at[i:j]] = _majority(ones, ends[i:j] - starts[i:j])
    for prints, (starts, ends) in zip(out, windows, strict=True):
        at = np.flatnonzero(ends - starts > SEGMENT)
        if len(at):
            prints[at] = _long_simhashes(shingles, starts[at], ends[at])
    return out


def _near_values(bits: int, radius: int) -> np.ndarray:
    """All words of `bits` bits with at most `radius` ones."""
    every = np.arange(1 << bits, dtype=np.uint64)
    return every[np.bitwise_count(every) <= radius].astype(np.int64)


class ItemClass:
    """Items of about one length, with their multi-index: tables of 64-bit masks, one bit an item, in groups of 64."""

    def __init__(self, length: int, items: list[tuple], prints: np.ndarray):
        self.length, self.items, self.prints = length, items, prints  # items: (id, copies, shingle values, counts, number of shingles)
        near = _near_values(16, RADIUS // BLOCKS)
        self.tables = np.zeros((-(-len(items) // 64), BLOCKS, 1 << 16), np.uint64)
        for i, p in enumerate(prints):
            for k in range(BLOCKS):
                self.tables[i // 64, k, (int(p) >> (16 * k) & 0xFFFF) ^ near] |= U64(1 << (i % 64))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within RADIUS."""
        blocks = [((prints >> U64(16 * k)) & U64(0xFFFF)).astype(np.int64) for k in range(BLOCKS)]
        windows, found = [], []
        for g, tables in enumerate(self.tables):
            mask = tables[0][blocks[0]]
            for k in range(1, BLOCKS):
                mask |= tables[k][blocks[k]]
            live = np.flatnonzero(mask)
            held, fp = mask[live], prints[live]
            for i in range(64 * g, min(64 * g + 64, len(self.items))):
                at = np.flatnonzero(held & U64(1 << (i % 64)))
                at = at[np.bitwise_count(fp[at] ^ self.prints[i]) <= RADIUS]
                windows.append(live[at])
                found.append(np.full(len(at), i))
        return (np.concatenate(windows), np.concatenate(found)) if windows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def indexed(column: pa.Array):
    """(number of shingles, SimHash, shingle values, counts) of each text."""
    shingles, start = shingle_runs(column, SHINGLE)
    n = np.diff(start)
    full = np.flatnonzero(n)
    prints = np.zeros(len(n), np.uint64)
    prints[full] = simhashes(shingles, [(start[full], start[full + 1])])[0]
    for i in range(len(n)):
        yield int(n[i]), prints[i], *np.unique(shingles[start[i] : start[i + 1]], return_counts=True)


def classes_of(rows: list[tuple]) -> list[ItemClass]:
    """Classes of items (id, copies, number of shingles, SimHash, shingle values, counts); items without shingles are left out."""
    out = []
    rows = sorted((r for r in rows if r[2]), key=lambda r: r[2])
    while rows:
        part = [r for r in rows if r[2] <= rows[0][2] * CLASS_RATIO]
        rows = rows[len(part) :]
        items = [(i, copies, values, counts, n) for i, copies, n, _, values, counts in part]
        out.append(ItemClass(int(round((part[0][2] + part[-1][2]) / 2)), items, np.array([r[3] for r in part], np.uint64)))
    return out


def item_classes(items: list[tuple[int, str]]) -> list[ItemClass]:
    return classes_of([(i, 1, *rest) for (i, _), rest in zip(items, indexed(pa.array([t for _, t in items], pa.string())), strict=True)])


def class_windows(start: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of all windows of `length` shingles, whole documents where they are shorter."""
    n = np.diff(start)
    full = np.where(n >= length, (n - length) // step + 1, (n > 0).astype(np.int64))
    tail = (n > length) & ((n - length) % step > 0)
    docs = np.repeat(np.arange(len(n)), full + tail)
    nth = np.arange(len(docs)) - np.repeat(np.cumsum(full + tail) - full - tail, full + tail)
    begin = start[docs] + np.minimum(nth * step, np.maximum(n[docs] - length, 0))
    return docs, begin, np.minimum(begin + length, start[docs + 1])


def overlaps(shingles: np.ndarray, first: int, last: int, size: int, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every window of `size` shingles that begins at first to last: the sum of the lower counts of it and of an item.

    A place of a shingle that the item holds c times counts in the windows that hold the place and less than c earlier places
    of that shingle: in one stretch of windows. So all windows cost one pass, whatever their length.
    """
    span = shingles[first : last + size]
    at = np.minimum(np.searchsorted(values, span), len(values) - 1)
    place = np.flatnonzero(values[at] == span)
    which = at[place]
    order = np.argsort(which, kind="stable")
    place, which = place[order], which[order]
    back = np.arange(len(place)) - counts[which]
    held = np.maximum(back, 0)
    after = np.where((back >= 0) & (which[held] == which), place[held] + 1, 0)
    begin, stop = np.maximum(after, place - size + 1), np.minimum(place, last - first) + 1
    real = begin < stop
    n = last - first + 2
    return np.cumsum(np.bincount(begin[real], minlength=n) - np.bincount(stop[real], minlength=n))[: n - 1]


def best_place(shingles: np.ndarray, first: int, last: int, size: int, item: tuple) -> tuple[float, int]:
    """(weighted Jaccard similarity, begin) of the likest of the windows of `size` shingles that begin at first to last."""
    _, _, values, counts, n = item
    both = overlaps(shingles, first, last, size, values, counts)
    at = int(np.argmax(both))  # the similarity grows with the overlap, as all these windows have one size
    return float(both[at] / (size + n - both[at])), first + at


class Postings:
    """The items that hold a shingle."""

    def __init__(self, classes: list[ItemClass]):
        held = [(values, c, i) for c, cls in enumerate(classes) for i, (_, _, values, _, _) in enumerate(cls.items)]
        values = np.concatenate([v for v, _, _ in held]) if held else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(held)), [len(v) for v, _, _ in held])
        order = np.argsort(values, kind="stable")
        self.values, self.first = np.unique(values[order], return_index=True)
        self.first, self.owner = np.append(self.first, len(order)), owner[order]
        self.items = [(c, i) for _, c, i in held]

    def places(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of every shingle that an item holds, sorted."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, shingles), len(self.values) - 1)
        place = np.flatnonzero(self.values[at] == shingles)
        lo, n = self.first[at[place]], np.diff(self.first)[at[place]]
        item = self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place = np.repeat(place, n)
        order = np.argsort(item, kind="stable")
        return item[order], place[order]


def full_windows(shingles: np.ndarray, start: np.ndarray, classes: list[ItemClass], postings: Postings):
    """(document, class, item, first, last, shingles) of all stretches of windows of an item's length where some may hold
    enough of its shingles to reach 0.8."""
    item, place = postings.places(shingles)
    doc = np.searchsorted(start, place, side="right") - 1
    cuts = np.flatnonzero((np.diff(item) != 0) | (np.diff(doc) != 0)) + 1
    edges = np.concatenate(([0], cuts, [len(item)])) if len(item) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        c, i = postings.items[item[a]]
        d, n = int(doc[a]), classes[c].items[i][4]
        lo, hi = int(start[d]), int(start[d + 1])
        w = min(n, hi - lo)
        if b - a >= -(-4 * (w + n) // 9):
            yield d, c, i, max(lo, int(place[a]) - w + 1), min(hi - w, int(place[b - 1])), w


def leaks_in(shingles: np.ndarray, start: np.ndarray, classes: list[ItemClass], postings: Postings | None = None) -> dict[tuple[int, int, int], tuple[float, int, int]]:
    """Best (similarity, first shingle, shingles) by (document, class, item)."""
    best: dict[tuple[int, int, int], tuple[float, int, int]] = {}
    steps = [max(1, cls.length // STEPS) for cls in classes]
    cut = [class_windows(start, cls.length, step) for cls, step in zip(classes, steps, strict=True)]
    prints = simhashes(shingles, [(begin, end) for _, begin, end in cut])

    def verify(d: int, c: int, i: int, first: int, last: int, size: int) -> None:
        sim, s = best_place(shingles, first, last, size, classes[c].items[i])
        at = s - int(start[d])
        old, seen = best.get((d, c, i), (0.0, 0, 0))[:2]
        if sim >= SIMILARITY and (sim > old or sim == old and at < seen):
            best[d, c, i] = (sim, at, size)

    for c, (cls, step, (docs, begin, end)) in enumerate(zip(classes, steps, cut, strict=True)):
        windows, found = cls.candidates(prints[c])
        for w, i in zip(windows.tolist(), found.tolist(), strict=True):
            _, _, values, _, n = cls.items[i]
            d = int(docs[w])
            lo, hi = int(start[d]), int(start[d + 1])
            if not np.isin(shingles[begin[w] : end[w]], values).any():
                continue
            slack, size = abs(n - cls.length) + step, min(n, hi - lo)
            first = min(max(lo, int(begin[w]) - slack), hi - size)
            verify(d, c, i, first, max(first, min(int(begin[w]) + slack, hi - size)), size)
    for d, c, i, first, last, size in full_windows(shingles, start, classes, postings or Postings(classes)):
        verify(d, c, i, first, last, size)
    return best


def _index(batches):
    for b in pieces(batches, "text", PIECE):
        n, prints, values, counts = zip(*indexed(b.column("text")), strict=True)
        edges = pa.array(np.concatenate(([0], np.cumsum([len(v) for v in values]))), pa.int32())
        lists = lambda parts: pa.ListArray.from_arrays(edges, pa.array(np.concatenate(parts).view(np.int64)))
        yield pa.RecordBatch.from_arrays([
            b.column("slice"), b.column("item_id"), b.column("copies"), pa.array(n, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)),
            lists(values), lists([c.astype(np.int64) for c in counts]),
        ], [name.split()[0] for name in INDEX.split(", ")])


def write_index(benchmark: DataFrame) -> list[str]:
    """Index the items in tasks, as Parquet in the shared folder; the addresses of its slices."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("text IS NOT NULL")
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = 1 + max(rows // SLICE_ITEMS, size // SLICE_BYTES)
    once = items.groupBy("item_id", "text").agg(F.count("*").alias("copies")).withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets)))
    order = W.partitionBy("bucket").orderBy("item_id", "text")
    before = F.coalesce(F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nth = F.floor(before / SLICE_BYTES) + F.floor((F.row_number().over(order) - 1) / SLICE_ITEMS)
    sliced = once.select(F.concat_ws("-", "bucket", nth).alias("slice"), "item_id", "copies", "text")
    folder = shared_dir(spark, "benchmark-index")
    sliced.mapInArrow(_index, INDEX).write.option("compression", "zstd").partitionBy("slice").parquet(folder)
    files, path = _file_system(folder)
    return sorted(f"{folder}/{f.base_name}" for f in files.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith("slice="))


def read_slice(address: str) -> tuple[list[ItemClass], Postings]:
    files, path = _file_system(address)
    rows = []
    for b in pq.read_table(path, filesystem=files, partitioning=None).to_batches():
        lists = [(x.values.to_numpy(), x.offsets.to_numpy()) for x in (b.column("values"), b.column("counts"))]
        whole = [b.column(c).to_pylist() for c in ("item_id", "copies", "shingles")]
        prints = b.column("print").to_numpy().view(np.uint64)
        (values, edge), (counts, _) = lists
        for k, (item, copies, n) in enumerate(zip(*whole, strict=True)):
            rows.append((item, copies, n, prints[k], values[edge[k] : edge[k + 1]].view(np.uint64), counts[edge[k] : edge[k + 1]]))
    classes = classes_of(rows)
    return classes, Postings(classes)


def _leaks(slices: list[str], batches):
    """(piece of the documents, its leaks: (document, item, (similarity, first shingle, shingles)) in order)."""
    only = read_slice(slices[0]) if len(slices) == 1 else None
    for b in pieces(batches, "text", PIECE if only else PIECE_OF_MANY):
        shingles, start = shingle_runs(b.column("text"), SHINGLE)
        found = []
        for address in slices:
            classes, postings = only or read_slice(address)
            found += [(d, classes[c].items[i][:2], x) for (d, c, i), x in leaks_in(shingles, start, classes, postings).items()]
        yield b, sorted(found, key=lambda x: x[0])


def _scan(slices: list[str], batches):
    for b, found in _leaks(slices, batches):
        ids = b.column("doc_id")
        yield pa.RecordBatch.from_arrays([
            ids.take(pa.array([d for d, _, _ in found], pa.int64())), pa.array([i for _, (i, _), _ in found], pa.int64()),
            pa.array([round(s, 6) for _, _, (s, _, _) in found], pa.float64()), pa.array([a for _, _, (_, a, _) in found], pa.int64()),
            pa.array([n + SHINGLE - 1 for _, _, (_, _, n) in found], pa.int64()), pa.array([c for _, (_, c), _ in found], pa.int64()),
        ], ["doc_id", "item_id", "similarity", "start_word", "words", "copies"])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text) and (item_id, text) to (doc_id, item_id, similarity, start_word, words), one row a pair."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(partial(_scan, write_index(benchmark)), SCHEMA + ", copies long")
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def _clean(slices: list[str], batches):
    for b, found in _leaks(slices, batches):
        keep = np.ones(b.num_rows, bool)
        keep[[d for d, _, _ in found]] = False
        yield b.filter(pa.array(keep))


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that hold no benchmark item. Each row goes or stays by its own text: null and repeated
    doc_ids take no other rows with them."""
    return docs.mapInArrow(partial(_clean, write_index(benchmark)), docs.schema)


def op5_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds, with the best place."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
