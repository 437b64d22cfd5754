"""Operator 12: alignment of two tokenizers' tokens over the same bytes.

Every text, with a space before it, is encoded by a byte-level BPE (A) and a sentence-piece BPE (B). Byte offsets where
tokens of both end cut the tokens into groups, found by divide and conquer: of an interval of A tokens, the ends nearest to
its middle are looked up among B's ends by bisection, in rings that double in width; the nearest common one splits the
interval in two, and an interval without a common inner end is a group. All intervals of a batch of texts take a step
together. Within a group, every A and B token whose bytes overlap are linked.

Encoded texts with their groups are written once (two bytes a token, eight a group) and read twice: for the count of every linked pair of ids
(in how many documents it occurs; summed in the tasks before the shuffle), and for the documents' own figures. The pairs'
counts go to all tasks if they are at most BROADCAST_PAIRS, else the documents' pairs are joined with them. Memory of a task
is bounded by its largest text, about 150 bytes a byte.

Defined results: texts that are null or empty, or that differ from the joined bytes of either tokenizer's tokens (for B
those with U+2581), have no tokens, no group and no link; repeated rows count as documents of their own; a null doc_id is
kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces, table, utf8_buffers
from .tokens import byte_level, ragged, sentence_pieces, spread, units_of

#: Counts of so many id pairs (17 bytes each) are sent to every task; beyond, documents' pairs are joined with them.
BROADCAST_PAIRS = 2_000_000
#: Linked pairs that a counting task holds before it hands on their sums.
HELD_PAIRS = 500_000
ENCODED = "a", "b", "tokens_a", "tokens_b"


def encode(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a, b, tokens_a, tokens_b): 16-bit ids of both tokenizers, 32-bit numbers of tokens of each group.

    Binary columns of little-endian numbers, empty for texts without tokens.
    """

    def run(batches):
        (memo_a, bytes_a), (memo_b, bytes_b) = byte_level(a_path), sentence_pieces(b_path)
        for batch in pieces(batches, "text", 1 << 20):
            data, offsets = utf8_buffers(batch.column(1))
            full = np.diff(offsets) > 0
            spaced = np.insert(data, offsets[:-1][full], 0x20)
            offsets = offsets + np.concatenate(([0], np.cumsum(full)))
            units, codes, first = units_of(spaced, offsets)
            wrong, found = np.zeros(len(units), bool), []
            for memo, spelling in ((memo_a, bytes_a), (memo_b, bytes_b)):
                ids, counts = memo.ids_of_units(units)
                wrong |= _misspelled(units, ids, counts, spelling)
                found.append(spread(codes, first, ids, counts))
            doubtful = np.concatenate(([0], np.cumsum(wrong[codes])))[first]
            keep = doubtful[1:] == doubtful[:-1]
            for i in np.flatnonzero(~keep):  # units may differ where the text as a whole does not
                text = spaced[offsets[i] : offsets[i + 1]].tobytes()
                keep[i] = all(b"".join([spelling[t] for t in ids[at[i] : at[i + 1]].tolist()]) == text for (ids, at), spelling in zip(found, (bytes_a, bytes_b), strict=True))
            (a, first_a), (b, first_b) = (_kept(ids, at, keep) for ids, at in found)
            groups = common_ends(*(np.cumsum(size[x]) for size, x in zip(_sizes(a_path, b_path), (a, b), strict=True)), first_a, first_b)
            first = np.searchsorted(groups[0], first_a, side="right")
            columns = _binary(a, first_a), _binary(b, first_b), *(_binary(np.diff(x, prepend=0).astype(np.uint32), first) for x in groups)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *ENCODED])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, a binary, b binary, tokens_a binary, tokens_b binary")


def _misspelled(units: list[bytes], ids: np.ndarray, counts: np.ndarray, spelling: list[bytes]) -> np.ndarray:
    """Whether the bytes of a unit's ids differ from the unit."""
    sizes = np.fromiter(map(len, spelling), np.int64, len(spelling))
    want, flat = np.frombuffer(b"".join(units), np.uint8), np.frombuffer(b"".join(spelling), np.uint8)
    lengths, ends = np.fromiter(map(len, units), np.int64, len(units)), np.cumsum(counts)
    total = np.concatenate(([0], np.cumsum(sizes[ids])))
    wrong = total[ends] - total[ends - counts] != lengths
    ids = ids[np.repeat(~wrong, counts)]
    got, want = flat[ragged(sizes[ids], (np.cumsum(sizes) - sizes)[ids])], want[np.repeat(~wrong, lengths)]
    same = np.flatnonzero(~wrong)
    wrong[same[np.searchsorted(np.cumsum(lengths[same]), np.flatnonzero(got != want), side="right")]] = True
    return wrong


def _kept(ids: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.where(keep, np.diff(at), 0)
    return ids[ragged(lengths, at[:-1])], np.concatenate(([0], np.cumsum(lengths)))


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Stretches of values as binary values."""
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int64) * values.itemsize), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _unbinary(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    column, size = column.cast(pa.large_binary()), np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // size
    values = np.frombuffer(column.buffers()[2], kind)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, kind)
    return values, offsets - (offsets[0] if len(offsets) else 0)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of texts' tokens, as (one past the last A token, one past the last B token), ascending.

    Ends ascend over all texts; text i has the A tokens first_a[i] to first_a[i + 1], and both sides end together.
    """
    full = np.diff(first_a) > 0
    todo = tuple(x[full].astype(np.int32) for x in (first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]))
    leaves_a, leaves_b = [], []
    while len(todo[0]):
        a0, a1, b0, b1 = todo
        inner = (a1 - a0 > 1) & (b1 - b0 > 1)
        leaves_a.append(a1[~inner])
        leaves_b.append(b1[~inner])
        a0, a1, b0, b1 = (x[inner] for x in todo)
        cut = (a0 + a1) // 2 - 1  # the middle one of the inner ends, those of the tokens a0 to a1 - 2
        at, hit = _bisect(ends_a, ends_b, cut)
        missed = np.flatnonzero(~hit)
        if len(missed):
            cut[missed], at[missed] = _nearest(ends_a, ends_b, a0[missed], a1[missed] - 1, cut[missed])
            none = missed[cut[missed] < 0]
            leaves_a.append(a1[none])
            leaves_b.append(b1[none])
            a0, a1, b0, b1, cut, at = (np.delete(x, none) for x in (a0, a1, b0, b1, cut, at))
        halves = (a0, cut + 1), (cut + 1, a1), (b0, at + 1), (at + 1, b1)
        todo = tuple(np.stack(x, axis=1).ravel() for x in halves)  # neighbours stay neighbours: look-ups ascend
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (leaves_a, leaves_b))
    return np.sort(a).astype(np.int64), np.sort(b).astype(np.int64)


def _bisect(ends_a: np.ndarray, ends_b: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The B token that ends where each A token ends, and whether there is one."""
    ends = ends_a[tokens]
    at = np.searchsorted(ends_b, ends).astype(np.int32)
    return at, ends_b[at] == ends


def _nearest(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The common end nearest to the middle among the A tokens lo to hi - 1 and its B token; -1 where there is none."""
    cut, at = np.full(len(lo), -1, np.int32), np.full(len(lo), -1, np.int32)
    active, near = np.arange(len(lo)), 1
    while len(active):
        m, far = middle[active], 2 * near
        begin = np.concatenate((np.maximum(m - far + 1, lo[active]), np.minimum(m + near, hi[active])))
        end = np.concatenate((np.maximum(m - near + 1, lo[active]), np.minimum(m + far, hi[active])))
        tried, owner = ragged(end - begin, begin), np.repeat(np.concatenate((active, active)), end - begin)
        found, hit = _bisect(ends_a, ends_b, tried)
        tried, owner, found = tried[hit], owner[hit], found[hit]
        order = np.argsort(-np.abs(tried - middle[owner]), kind="stable")  # the nearest is written last
        cut[owner[order]], at[owner[order]] = tried[order], found[order]
        near = far
        active = active[(cut[active] < 0) & ((m - near >= lo[active]) | (m + near < hi[active]))]
    return cut, at


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of every A token and B token that overlap, A ascending."""
    n_a, n_b = np.diff(groups_a, prepend=0), np.diff(groups_b, prepend=0)
    of = np.repeat(np.arange(len(n_a)), n_a)
    lo, hi = (groups_b - n_b)[of], groups_b[of] - 1  # first and last B token that an A token meets: all of its group
    mixed = np.flatnonzero((n_a > 1)[of])
    if len(mixed):
        inner = ends_a[mixed]
        hi[mixed] = np.searchsorted(ends_b, inner)
        begins = mixed[of[mixed] == of[mixed - 1]] if mixed[0] else mixed[1:][of[mixed[1:]] == of[mixed[1:] - 1]]
        lo[begins] = np.searchsorted(ends_b, ends_a[begins - 1], side="right")
    return np.repeat(np.arange(len(of)), hi - lo + 1), ragged(hi - lo + 1, lo)


class _Aligned:
    """Groups and links of the encoded texts of a batch."""

    def __init__(self, batch: pa.RecordBatch, size_a: np.ndarray, size_b: np.ndarray):
        column = lambda name, kind: _unbinary(batch.column(batch.schema.get_field_index(name)), kind)
        (self.a, self.first_a), (self.b, self.first_b) = column("a", np.uint16), column("b", np.uint16)
        (n_a, self.first_group), (n_b, _) = column("tokens_a", np.uint32), column("tokens_b", np.uint32)
        self.groups_a, self.groups_b = np.cumsum(n_a, dtype=np.int64), np.cumsum(n_b, dtype=np.int64)
        ends = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        self.link_a, self.link_b = links_of(*ends, self.groups_a, self.groups_b)
        self.first_link = np.searchsorted(self.link_a, self.first_a)
        self.pair = self.a[self.link_a].astype(np.int64) << 16 | self.b[self.link_b]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of each text's distinct pairs."""
        text = np.repeat(np.arange(len(self.first_link) - 1), np.diff(self.first_link))
        both, times = np.unique(text << 32 | self.pair, return_counts=True)
        return both >> 32, both & 0xFFFFFFFF, times

    def spelled(self) -> list[str]:
        """SHA-256 of every text's groups as decimal ids; empty for texts without tokens."""
        n_a, n_b = np.diff(self.groups_a, prepend=0), np.diff(self.groups_b, prepend=0)
        order = np.empty(len(self.a) + len(self.b), np.int64)  # A tokens of a group, then its B tokens
        at_a = np.arange(len(self.a)) + np.repeat(self.groups_b - n_b, n_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.groups_a, n_b)
        order[at_a], order[at_b] = self.a, self.b
        mark = np.zeros(len(order), np.int64)
        mark[at_a[self.groups_a - 1]], mark[at_b[self.groups_b - 1]] = 1, 2
        first = self.first_a + self.first_b
        full = np.diff(first) > 0
        mark[first[1:][full] - 1] = 3
        text = _decimals()[mark << 16 | order].view(np.uint8).reshape(-1, 6)
        sizes = np.concatenate(([0], np.cumsum((text != 0).sum(axis=1))))[first]
        flat = text.ravel()
        flat = flat[flat != 0].tobytes()
        return [hashlib.sha256(flat[x:y]).hexdigest() if y > x else "" for x, y in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def _decimals() -> np.ndarray:
    """Every 16-bit id in decimal, followed by a comma, a bar, a semicolon or nothing, in six bytes."""
    return np.array([f"{i}{mark}".encode() for mark in (",", "|", ";", "") for i in range(1 << 16)], "S6")


@lru_cache(maxsize=1)
def _sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.fromiter(map(len, x), np.int64, len(x)) for x in (byte_level(a_path)[1], sentence_pieces(b_path)[1]))


def pair_counts(encoded: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n, best): every linked pair of ids (A's times 65,536 plus B's), its documents, whether A's id has none with more."""

    def run(batches):
        sizes = _sizes(a_path, b_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed():
            pairs, n = (np.concatenate(x) for x in zip(*held, strict=True))
            found, where = np.unique(pairs, return_inverse=True)
            return found, np.bincount(where, weights=n).astype(np.int64)

        for batch in pieces(batches, "a", 1 << 20):
            held.append(np.unique(_Aligned(batch, *sizes).pairs()[1], return_counts=True))
            if sum(len(p) for p, _ in held) > HELD_PAIRS:
                held[:] = [summed()]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), ["pair", "n"])
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, summed())), ["pair", "n"])

    counts = encoded.select(*ENCODED).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 16).alias("id")).agg(F.max("n").alias("most"))  # at most one row an id of A
    return counts.join(most, F.shiftright("pair", 16) == F.col("id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _figures(x: _Aligned) -> dict[str, pa.Array]:
    counts = {"n_a": x.first_a, "n_b": x.first_b, "n_groups": x.first_group, "n_links": x.first_link}
    return {k: pa.array(np.diff(v).astype(np.int64)) for k, v in counts.items()} | {"groups_sha256": pa.array(x.spelled(), pa.string())}


def align(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row of docs: doc_id, numbers of tokens, groups and links, the groups' digest, n_best and count_sum."""
    spark = docs.sparkSession
    encoded = materialize(encode(docs, a_path, b_path), "two-encodings")
    counts = materialize(pair_counts(encoded, a_path, b_path), "pair-best")
    if counts.count() <= broadcast_pairs:
        rows = counts.toArrow().sort_by("pair")
        known = spark.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "n", "best")))

        def run(batches):
            sizes, (pairs, n, best) = _sizes(a_path, b_path), known.value
            for batch in pieces(batches, "a", 1 << 20):
                x = _Aligned(batch, *sizes)
                text, pair, times = x.pairs()
                at = np.searchsorted(pairs, pair)
                total = lambda w: np.bincount(text, weights=w, minlength=batch.num_rows).astype(np.int64)  # noqa: B023, E731
                more = {"n_best": pa.array(total(best[at] * times)), "count_sum": pa.array(total(n[at] * times))}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | _figures(x) | more)

        return encoded.mapInArrow(run, f"doc_id long, {FIGURES}, n_best long, count_sum long")

    # rows get numbers once, in a table, so that both passes agree on them
    rows = materialize(encoded.withColumn("row", F.monotonically_increasing_id()), "two-encodings-rows")

    def figures(batches):
        sizes = _sizes(a_path, b_path)
        for batch in pieces(batches, "a", 1 << 20):
            yield pa.RecordBatch.from_pydict({"row": batch.column(batch.schema.get_field_index("row")), "doc_id": batch.column(0)} | _figures(_Aligned(batch, *sizes)))

    def links(batches):
        sizes = _sizes(a_path, b_path)
        for batch in pieces(batches, "a", 1 << 20):
            text, pair, times = _Aligned(batch, *sizes).pairs()
            yield pa.RecordBatch.from_pydict({"owner": batch.column(batch.schema.get_field_index("row")).take(pa.array(text)), "pair": pa.array(pair), "times": pa.array(times)})

    sums = rows.mapInArrow(links, "owner long, pair long, times long").join(counts, "pair").groupBy("owner").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    out = rows.mapInArrow(figures, f"row long, doc_id long, {FIGURES}").join(sums, F.col("row") == F.col("owner"), "left")
    return out.drop("row", "owner").fillna(0, ["n_best", "count_sum"])


def op12_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between the byte-level and the sentence-piece vocabulary."""
    import public_tokenizers

    out = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
