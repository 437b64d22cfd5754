"""Operator 13: packing tokenized documents into sequences by patterns fitted with non-negative least squares.

Documents become token ids with an end token; only documents longer than a sequence are cut, into pieces. All that the plan
needs is how many pieces there are of each length, at most one number a length, whatever the corpus. Lengths are grouped
into classes; every way to fill a sequence with up to PATTERN_DOCS pieces of classes is a pattern; the repeat counts of the
patterns are fitted to the histogram by non-negative least squares and rounded down; patterns are filled with pieces of
exact lengths. What is left over is packed by best fit, longest first and whole runs of equal lengths at a time, into the
gaps of the filled patterns and then into new sequences.

The plan is a list of stretches of ranks among the pieces of one length. A piece's rank is its row number within (length,
part of its hash) plus the pieces of the parts before, so no length is numbered in one task, and its place is looked up in
the plan. The driver holds the histogram by part, at most (capacity x PARTS) numbers, and the plan, whose size depends on
the lengths only.

Defined results: a null or empty text has the end token alone; a null doc_id is kept; repeated rows are packed each; ties
among equal pieces don't matter; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pieces, table
from .tokens import encode_column, ragged, word_memo

CAPACITY, END = 4096, 1
#: Pieces of a pattern at most; classes of lengths; parts in which the pieces of a length are numbered.
PATTERN_DOCS, CLASSES, PARTS = 3, 256, 256
Items = tuple[tuple[int, int], ...]  # (length, pieces)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's ids and the end token, cut where longer than a sequence.

    ids are little-endian 32-bit numbers in a binary column.
    """

    def run(batches):
        memo = word_memo(path)
        for batch in pieces(batches, "text", 4 << 20):
            ids, at = encode_column(batch.column(1), memo)
            ids = np.insert(ids.astype("<u4"), at[1:], end)
            sizes = np.diff(at) + 1
            n = -(-sizes // capacity)
            owner, number = np.repeat(np.arange(len(n)), n), ragged(n, np.zeros(len(n), np.int64))
            start = number * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            bounds = np.concatenate(([0], np.cumsum(length))) * 4
            cut = pa.Array.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(bounds), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), cut.cast(pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


# --- the plan, from counts of lengths --------------------------------------------------------------------------------


def patterns_of(classes: np.ndarray, total: int, most: int) -> np.ndarray:
    """All ways to write `total` as a sum of up to `most` of the (ascending) classes, 0 standing for none: (pattern, part)."""
    have = np.zeros(total + 1, bool)
    have[classes] = have[0] = True
    rows = np.array([[total]]) if have[total] else np.zeros((0, 1), int)
    heads = np.zeros((1, 0), int)  # parts chosen so far, descending
    out = [np.pad(rows, ((0, 0), (0, most - 1)))]
    for k in range(1, most):
        left = total - heads.sum(axis=1)
        before = heads[:, -1] if k > 1 else np.full(len(heads), total)
        grid = np.broadcast_to(classes, (len(heads), len(classes)))
        ok = (grid <= before[:, None]) & (grid < left[:, None]) & (grid * (most - k + 1) >= left[:, None])
        at = np.nonzero(ok)
        heads = np.concatenate((heads[at[0]], grid[ok][:, None]), axis=1)
        last = total - heads.sum(axis=1)
        ends = (last <= heads[:, -1]) & have[np.maximum(last, 0)]
        out.append(np.pad(np.concatenate((heads[ends], last[ends, None]), axis=1), ((0, 0), (0, most - 1 - k))))
    return np.concatenate(out)


def nonnegative_fit(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises the squared difference of used and given pieces, each class weighed by its length.

    counts[k] pieces have class k. Active sets are grown by the steepest pattern and shrunk where the fit turns negative.
    """
    n = len(counts)
    weight = np.arange(n, dtype=float)
    scale = max(1.0, float((weight * counts).max()))
    target = weight * counts / scale
    x = np.zeros(len(patterns))
    columns: dict[int, np.ndarray] = {}
    active: list[int] = []

    def column(j: int) -> np.ndarray:
        if j not in columns:
            columns[j] = np.bincount(patterns[j], minlength=n) * weight
        return columns[j]

    for _ in range(6 * n):
        used = sum((column(j) * x[j] for j in active), np.zeros(n))
        slope = (weight * (target - used))[patterns].sum(axis=1)
        slope[active] = -1
        best = int(slope.argmax()) if len(slope) else -1
        if best < 0 or slope[best] <= 1e-9 * n:
            break
        active.append(best)
        while active:
            a = np.stack([column(j) for j in active], axis=1)
            fit = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(active)), a.T @ target)
            if (fit > 0).all():
                x[active] = fit
                break
            now = x[active]
            falling = fit <= 0
            step = float((now[falling] / np.maximum(now[falling] - fit[falling], 1e-300)).min())
            moved = np.where(now + step * (fit - now) > 1e-12, now + step * (fit - now), 0)
            x[active] = moved
            kept = [j for j, v in zip(active, moved, strict=True) if v > 0]
            if len(kept) == len(active):
                break
            active = kept
    return x * scale


def _fill(patterns: np.ndarray, repeats: np.ndarray, left: np.ndarray, width: int, capacity: int) -> Iterator[tuple[int, Items]]:
    """Patterns with exact lengths taken out of `left` (pieces by length), as (times, items).

    All but the shortest piece of a pattern are the longest of their classes; the shortest one is the longest that still fits,
    so that what the classes round up is not lost.
    """

    def longest(lo: int, hi: int) -> int:
        found = np.flatnonzero(left[lo:hi])
        return int(lo + found[-1]) if len(found) else 0

    for p in np.argsort(-repeats, kind="stable"):
        parts, todo = sorted(patterns[p][patterns[p] > 0].tolist(), reverse=True), int(repeats[p])
        while todo > 0:
            items: list[int] = []
            for k in parts[:-1]:
                items.append(longest((k - 1) * width + 1, k * width + 1))
                left[items[-1]] -= 1  # so that the next part sees what is left
            items.append(longest(1, capacity - sum(items) + 1) if all(items) else 0)
            left[items[-1]] -= 1
            np.add.at(left, items, 1)  # chosen; taken below, as often as they last
            if not all(items) or items[-1] <= (parts[-1] - 1) * width:
                break
            exact, need = np.unique(items, return_counts=True)
            times = min([todo, *(int(left[n]) // int(m) for n, m in zip(exact, need, strict=True))])
            left[exact] -= times * need
            todo -= times
            yield times, tuple((int(n), int(m)) for n, m in zip(exact[::-1], need[::-1], strict=True))


def _best_fit(groups: list[tuple[int, Items]], left: np.ndarray, capacity: int) -> list[tuple[int, Items]]:
    """Pieces in `left`, longest first, into the tightest gaps of the groups, then into new sequences."""
    by_gap: dict[int, list[tuple[int, Items]]] = defaultdict(list)
    for times, items in groups:
        by_gap[capacity - sum(n * k for n, k in items)].append((times, items))
    gaps = sorted(by_gap)

    def put(gap: int, times: int, items: Items) -> None:
        if not by_gap[gap]:
            insort(gaps, gap)
        by_gap[gap].append((times, items))

    for length in range(len(left) - 1, 0, -1):
        todo = int(left[length])
        while todo:
            i = bisect_left(gaps, length)
            gap = gaps[i] if i < len(gaps) else capacity
            each = min(gap // length, todo)
            if i < len(gaps):
                times, items = by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps.pop(i)
                used = min(times, todo // each)
                if used < times:
                    put(gap, times - used, items)
            else:
                used, items = todo // each, ()
            put(gap - each * length, used, (*items, (length, each)))
            todo -= used * each
    return [g for gap in sorted(by_gap) for g in by_gap[gap]]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, Items]]:
    """counts[n] pieces of n tokens (1 to capacity) as (times, items): so many sequences that hold these pieces."""
    left = counts.astype(np.int64).copy()
    width = -(-capacity // CLASSES)
    total = capacity // width  # classes round up, so their sums stay within the sequence
    by_class = np.zeros(total + 1, np.int64)
    lengths = np.flatnonzero(left)
    np.add.at(by_class, np.minimum(-(-lengths // width), total), left[lengths])
    if capacity % width:  # lengths beyond the last whole class are left to best fit
        by_class[total] = left[(total - 1) * width + 1 : total * width + 1].sum()
    classes = np.flatnonzero(by_class)
    classes = classes[classes > 0]
    groups: list[tuple[int, Items]] = []
    if len(classes):
        patterns = patterns_of(classes, total, PATTERN_DOCS)
        repeats = np.floor(nonnegative_fit(patterns, by_class) + 1e-6).astype(np.int64)
        keep = repeats > 0
        groups = list(_fill(patterns[keep], repeats[keep], left, width, capacity))
    return _best_fit(groups, left, capacity)


def stretches(groups: list[tuple[int, Items]]) -> np.ndarray:
    """(length, first rank, first sequence, pieces a sequence, offset) of the pieces that each item takes, ascending."""
    out, next_rank, sequence = [], defaultdict(int), 0
    for times, items in groups:
        offset = 0
        for length, each in items:
            out.append((length, next_rank[length], sequence, each, offset))
            next_rank[length] += times * each
            offset += length * each
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


# --- places of the pieces ------------------------------------------------------------------------------------------------


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (read twice) that has doc_id, start and length."""
    part = F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(PARTS)).cast("int")
    rows = rows.withColumn("_ax_part", part)
    found = rows.groupBy("length", "_ax_part").count().toArrow()  # at most capacity x PARTS rows
    sizes = np.zeros((capacity + 1, PARTS), np.int64)
    sizes[found.column("length").to_numpy(), found.column("_ax_part").to_numpy()] = found.column("count").to_numpy()
    spans = stretches(plan(sizes.sum(axis=1), capacity))
    ahead = np.cumsum(sizes, axis=1) - sizes
    context = rows.sparkSession.sparkContext
    known = context.broadcast((spans[:, 0] << 44 | spans[:, 1], spans, ahead))
    within = W.partitionBy("length", "_ax_part").orderBy("doc_id", "start", *(c for c in rows.columns if c not in ("doc_id", "start", "length", "_ax_part", "ids")))
    numbered = rows.withColumn("_ax_row", F.row_number().over(within))

    def run(batches):
        keys, spans, ahead = known.value
        for b in batches:
            length, part, row = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_ax_part", "_ax_row"))
            rank = ahead[length, part] + row - 1
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            k = rank - spans[at, 1]
            each = spans[at, 3]
            columns = {c: b.column(i) for i, c in enumerate(b.schema.names) if not c.startswith("_ax_")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(spans[at, 2] + k // each), "offset": pa.array(spans[at, 4] + k % each * length)})

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_ax_part"]
    return numbered.mapInArrow(run, ", ".join([*kept, "sequence_id long", "offset long"]))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): pieces with their ids put together; a sequence holds at most its capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the lower-casing word vocabulary in sequences of 4,096 tokens."""
    import public_tokenizers

    rows = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    rows = materialize(rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "token-pieces")
    return place(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
