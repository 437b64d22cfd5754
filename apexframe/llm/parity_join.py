"""Operator 8: n-gram Jaccard join on parity sketches.

Texts become sets of hashed word shingles. Two sets link when den * |A & B| >= num * |A | B|, which bounds their symmetric
difference by D = (|A| + |B|) (den - num) / (den + num).

* Parity sketch: each shingle is XOR-ed into one of m blocks. A shingle in the symmetric difference changes one block at
  most, so two sets within D agree on at least m - D blocks.
* Size bands: sizes are cut into bands of ratio 1.35; D and m = D + 1 + slack are fixed per band. A set is entered in its
  band and, where its smallest possible partner lies in the next lower one, there too.
* Pigeonhole join: sets that share a (band, block, parity) key are candidates. Empty blocks are not entered. The slack
  makes up for them; a set with more empty blocks than slack is entered again under another hash, and after four hashes
  its empty blocks are entered too, so no pair within D is ever missed.
* A packed bit sketch (a power of two of bits, foldable by XOR) gives a Hamming distance that never exceeds the symmetric
  difference: candidates beyond D fall out before any text moves. The rest is verified on the whole shingle sets.
* In each key every set is first paired with two pivots, the smallest set and the one of the smallest hash, so pairs grow in
  proportion to rows; both orders hold for all keys, so a group that shares many keys has few pivots. Once these links are
  verified, sets of one component need no more links. Keys that still hold different components get two other pivots, which are
  paired with the sets of other components, for as long as that finds links and ROUNDS rounds at most: sets with many links
  are joined here. What is then left is compared across components on packed sketches, in cells of CELL x CELL sets, and all
  that is near is verified, so no link is lost.

Equal sets are one node from the start (64-bit fingerprint), so copies are never expanded into pairs.

Defined results: null, empty and blank texts have 0 shingles and link with nothing (component_id is their own doc_id);
texts with fewer words than a shingle have one shingle, the whole sequence; null doc_ids are never a component's id unless
a component has no other; repeated rows give repeated results; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, materialize, mix64, pieces, shingle_hashes, table, word_hashes
from .components import connected_components

FIRST, RATIO, CELL, SEEDS, ROUNDS = 2, 1.35, 1024, 4, 3
BROADCAST_ROWS = 500_000  # of 8-byte ids: 4 MB and hash overhead


class Bands:
    """Size bands with their distance bound D, slack and block count."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        self.lows, self.blocks, self.slack = [], [], []
        lo = FIRST
        while lo <= largest:
            hi = max(lo + 1, int(np.ceil(lo * RATIO)))
            a = hi - 1
            d = self.distance(a, a * den // num)
            self.lows.append(lo)
            self.slack.append(2 + d // 8)
            self.blocks.append(d + 1 + self.slack[-1])
            lo = hi

    def distance(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, n: int) -> list[int]:
        """The bands that a set of n shingles is entered in; none if only an equal set could link with it."""
        if self.distance(n, n * self.den // self.num) < 1 and self.distance(n, -(-n * self.num // self.den)) < 1:
            return []
        own = int(np.searchsorted(self.lows, n, side="right")) - 1
        low = int(np.searchsorted(self.lows, max(FIRST, -(-n * self.num // self.den)), side="right")) - 1
        return list(range(low, own + 1))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a batch."""
    words, first = word_hashes(column)
    runs = shingle_hashes(words, size)
    out = []
    for i in range(len(first) - 1):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= size:
            out.append(np.unique(runs[lo : hi - size + 1]))
        elif hi > lo:
            out.append(shingle_hashes(words[lo:hi], int(hi - lo)) ^ U64(hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> int:
    """Of a set: signed 64 bits."""
    both = mix64(np.array([np.bitwise_xor.reduce(s), s.sum(dtype=np.uint64)], dtype=np.uint64) + U64(len(s)))
    return int(mix64(both[:1] + both[1:] * U64(3)).view(np.int64)[0])


def packed_sketch(s: np.ndarray) -> bytes:
    bits = 1 << max(6, int(4 * len(s) - 1).bit_length())
    odd = np.bincount((mix64(s ^ U64(0x5851F42D4C957F2D)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def block_keys(s: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """Keys of the parity blocks of a set in a band."""
    m, slack = bands.blocks[band], bands.slack[band]
    limits = ((np.arange(1, m, dtype=np.uint64) << U64(32)) + U64(m - 1)) // U64(m)
    out = []
    for seed in range(SEEDS):
        h = s if seed == 0 else np.sort(mix64(s ^ U64(seed * 0x2545F4914F6CDD1D)))
        run = np.concatenate(([U64(0)], np.bitwise_xor.accumulate(mix64(h + U64(1)))))
        cut = np.concatenate(([0], np.searchsorted(h >> U64(32), limits), [len(h)]))
        parity = run[cut[1:]] ^ run[cut[:-1]]
        place = mix64(np.arange(m, dtype=np.uint64) + U64(((band * SEEDS + seed) << 32) + 7))
        empty = parity == 0
        out.append(mix64(parity + place)[~empty])
        if empty.sum() <= slack:
            break
    else:
        out.append(mix64(place[empty]))
    return np.concatenate(out)


def _members(size: int, batches):
    for b in pieces(batches, "text"):
        sets = shingle_sets(b.column("text"), size)
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "node": pa.array([fingerprint(s) for s in sets], pa.int64()),
            "sketch": pa.array([packed_sketch(s) if len(s) else b"" for s in sets], pa.binary())})


def _keys(size: int, num: int, den: int, batches):
    bands, seen = Bands(num, den), set()  # a set that this task has entered is not entered again
    for b in pieces(batches, "text"):
        nodes, keys = [], []
        for s in shingle_sets(b.column("text"), size):
            node = fingerprint(s)
            if node not in seen:
                seen.add(node)
                for band in bands.of(len(s)):
                    keys.append(block_keys(s, band, bands))
                    nodes.append(np.full(len(keys[-1]), node, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["key", "node"])


def _near(num: int, den: int, batches):
    """Keeps pairs whose sketches are no further apart than linked sets can be."""
    bands = Bands(num, den, FIRST)
    for b in batches:
        keep = []
        a, c = b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist()
        for i, (x, y, n, k) in enumerate(zip(a, c, b.column("n_a").to_pylist(), b.column("n_b").to_pylist(), strict=True)):
            if min(n, k) * den < max(n, k) * num:
                continue
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            w = min(len(x), len(y))
            h = int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum())
            if h <= bands.distance(n, k):
                keep.append(i)
        out = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], ["a", "b"])


def _linked(size: int, num: int, den: int, batches):
    """Keeps pairs of texts that link."""
    for b in pieces(pieces(batches, "text_a"), "text_b"):
        sa, sb = shingle_sets(b.column("text_a"), size), shingle_sets(b.column("text_b"), size)
        keep = []
        for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(bool(len(x)) and den * both >= num * (len(x) + len(y) - both))
        out = b.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], ["a", "b"])


def _cells(num: int, den: int, batches):
    """Pairs of different components with near sketches, within each cell; rows come sorted by (key, i, j)."""
    bands = Bands(num, den, FIRST)

    def near(rows: pa.Table, out: list):
        comp, node, n, side = (rows.column(c).to_numpy() for c in ("component", "node", "n_shingles", "side"))
        if comp.min() == comp.max():
            return
        raw = [np.frombuffer(x, np.uint64) for x in rows.column("sketch").to_pylist()]
        words = min(map(len, raw))
        packed = np.stack([fold(x, words) for x in raw])
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else np.arange(len(side))
        for i in left:
            to = right[(comp[right] != comp[i]) & (n[right] * den >= n[i] * num) & (n[i] * den >= n[right] * num)]
            ham = np.bitwise_count(packed[i][None, :] ^ packed[to]).sum(axis=1)
            to = to[ham <= (n[i] + n[to]) * (den - num) // (den + num)]
            out += [(min(node[i], x), max(node[i], x)) for x in node[to]]

    held = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not rows.num_rows:
            continue
        key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        out: list = []
        for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
            near(rows.slice(lo, hi - lo), out)
        held = rows.slice(int(cuts[-1]) if len(cuts) else 0).combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
    if held is not None and held.num_rows:
        out = []
        near(held, out)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes that link, by the whole texts of one document each."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = materialize(nodes.join(ends, "node").select(F.col("doc_id").alias("_ax_id")), "parity-needed")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    found = docs.join(needed, docs["doc_id"].eqNullSafe(F.col("_ax_id")), "left_semi")

    def named(batches):
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in shingle_sets(b.column("text"), size)], pa.int64()), b.column("text")], ["node", "text"])

    texts = found.select("text").mapInArrow(named, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))
    texts = materialize(texts, "parity-texts")
    wide = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    wide = wide.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return wide.mapInArrow(partial(_linked, size, num, den), "a long, b long")


def _sketched(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The candidate pairs (a, b) that the packed sketches leave."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    wide = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return wide.mapInArrow(partial(_near, num, den), "a long, b long")


def _mixed(kept: DataFrame, components: DataFrame) -> DataFrame:
    """(key, node, component) of the keys that hold sets of different components."""
    labelled = kept.select("key", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    return materialize(labelled.join(mixed.select("key"), "key").select("key", "node", "component"), "parity-mixed")


def _joined(components: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) with further links: a component's star stands for all links found before."""
    return connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def _with_pivots(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of two sets of each key with those of other components: a set drawn by hash, and one of a component
    drawn by hash."""
    sets, groups = F.xxhash64("node", F.lit(turn)), F.xxhash64("component", F.lit(turn))
    draws = [F.min_by(c, h) for h in (sets, groups) for c in ("node", "component")]
    pivots = mixed.groupBy("key").agg(*(d.alias(n) for d, n in zip(draws, ("p0", "c0", "p1", "c1"), strict=True)))
    pivots = pivots.select("key", F.explode(F.array(F.struct(F.col("p0").alias("p"), F.col("c0").alias("c")), F.struct(F.col("p1").alias("p"), F.col("c1").alias("c")))).alias("pivot"))
    pairs = mixed.join(pivots, "key").where(F.col("component") != F.col("pivot.c"))
    return pairs.select(F.least("pivot.p", "node").alias("a"), F.greatest("pivot.p", "node").alias("b")).distinct()


def _rest_of_groups(mixed: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share a key and have near sketches, compared in cells."""
    sizes = mixed.groupBy("key").agg(F.count("*").alias("g"))
    rows = mixed.join(sizes, "key")
    cells = F.ceil(F.col("g") / CELL).cast("int")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("node"), cells).cast("int")).withColumn("cells", cells)
    # cell (i, j) with i <= j holds slices i and j; each slice goes to as many cells as the group has slices
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rows = rows.select("key", "node", "component", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), (F.col("slice") > F.col("other")).cast("int").alias("side"))
    rows = rows.join(nodes.select("node", "n_shingles", "sketch"), "node")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(partial(_cells, num, den), "a long, b long").distinct()


def similarity_classes(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id)."""
    docs = docs.select("doc_id", "text")
    args = (shingle, num, den)
    members = materialize(docs.mapInArrow(partial(_members, shingle), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, node long, sketch binary"), "parity-members")
    nodes = materialize(members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")), "parity-nodes")

    keys = docs.select("text").mapInArrow(partial(_keys, *args), "key long, node long").repartition("key")
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.min_by("node", F.xxhash64("node")).alias("any"))
    kept = keys.join(shared.where("first < last").drop("last").hint("shuffle_hash"), "key").dropDuplicates(["key", "node"])
    kept = materialize(kept.select("key", "node", "first", "any"), "parity-keys")

    stars = kept.select(F.explode(F.array("first", "any")).alias("pivot"), "node").where("pivot <> node")
    stars = stars.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    tried = materialize(_sketched(stars, nodes, num, den), "parity-stars")
    links = materialize(_verify(tried, nodes, docs, *args), "parity-links")
    comps = connected_components(links)
    mixed = _mixed(kept, comps)
    for turn in range(ROUNDS):
        again = materialize(_sketched(_with_pivots(mixed, turn).join(tried, ["a", "b"], "left_anti"), nodes, num, den), "parity-again")
        more = materialize(_verify(again, nodes, docs, *args), "parity-more") if again.take(1) else again
        tried = tried.unionByName(again)
        if not more.take(1):
            break
        comps = _joined(comps, more)
        mixed = _mixed(mixed, comps)
    rest = materialize(_rest_of_groups(mixed, nodes, num, den).join(tried, ["a", "b"], "left_anti"), "parity-rest")
    if rest.take(1):
        comps = _joined(comps, _verify(rest, nodes, docs, *args))

    reached = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = reached.join(smallest, "component").select("node", "component_id")
    out = members.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 4-word shingles at a Jaccard similarity of at least 0.85."""
    return similarity_classes(table(spark, sf_dir, "documents"), 4, 85, 100)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)]) END AS sh
  FROM w
), g AS (
  SELECT sh AS one, min(doc_id) AS rep, list(doc_id) AS ids, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) WHERE len(sh) > 0 GROUP BY sh
), u AS (
  SELECT rep, n, unnest(one) AS x FROM g
), i AS (
  SELECT a.rep AS p, b.rep AS q, a.n AS na, b.n AS nb, count(*) AS k
  FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL
), e AS (
  SELECT p, q FROM i WHERE 100 * k >= 85 * (na + nb - k) UNION ALL SELECT q, p FROM i WHERE 100 * k >= 85 * (na + nb - k)
), r AS (
  SELECT rep AS a, rep AS b FROM g UNION SELECT r.a, e.q FROM r JOIN e ON r.b = e.p
), c AS (
  SELECT a, min(b) AS c FROM r GROUP BY a
), m AS (
  SELECT unnest(g.ids) AS doc_id, c.c FROM g JOIN c ON g.rep = c.a
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.c, s.doc_id) AS component_id FROM s LEFT JOIN m ON s.doc_id = m.doc_id
"""
