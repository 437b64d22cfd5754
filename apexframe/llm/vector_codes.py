"""Operator 11: product codes of integer vectors, assigned through memoised grid cells.

Vectors are scaled to integers and cut into equal parts, each with a codebook of its own. A part's nearest entry is found
through the coarse cell (a box of CELL units a side) that holds it: an entry whose least distance from the box is more than
the smallest of all entries' greatest distances can be nearest to nothing in the box. The entries that remain are kept for
the cell, in the task, and only these are compared exactly. Least and greatest distances add up over components, so they
are summed from small tables (component, cell coordinate, entry). All figures are 64-bit integers, so results are exact and
the same at any partitioning.

Codebooks (parts x entries x part length) are all that goes through the driver. They start as the parts of the vectors with
the smallest ids; each round sums every entry's parts in the tasks, then over tasks.

Defined results: vectors that are null or hold a null or non-finite component are dropped; scaled components are clamped to
+-2^27 so that distances fit into 64 bits; kept vectors have to be of one length that the parts divide, else an error names
the length; null ids come last among the first vectors, equal ids are ordered by their components; with fewer vectors than
entries the codebooks are as short; repeated rows count each; an empty table gives an empty result; null labels are one
label; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LIMIT = 1 << 27
#: Side of a cell in scaled units; cells that a task remembers for each part.
CELL, MEMO_CELLS = 32, 100_000
#: Vectors that a task works on at once.
BLOCK = 2048


def quantise(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): kept vectors as integers, floor(SCALE * x)."""
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    clamp = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("int")
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(v, clamp).alias("v"))


class CellMemo:
    """Nearest entries of one part's codebook (entries x length, 64-bit integers)."""

    def __init__(self, entries: np.ndarray, cell: int = CELL):
        self.entries, self.cell = entries, cell
        self.known: dict[bytes, np.ndarray] = {}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _bounds(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance, per component and entry, to the interval of a cell coordinate."""
        if coordinate not in self.tables:
            low, high = coordinate * self.cell, (coordinate + 1) * self.cell - 1
            below, above = low - self.entries, self.entries - high
            self.tables[coordinate] = np.maximum(0, np.maximum(below, above)).T ** 2, np.maximum(high - self.entries, self.entries - low).T ** 2
        return self.tables[coordinate]

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries that are not dominated across each cell (a row of coordinates), ascending."""
        if len(self.tables) > 4096:
            self.tables.clear()
        least = np.zeros((len(cells), len(self.entries)), np.int64)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            values, where = np.unique(cells[:, d], return_inverse=True)
            near, far = zip(*(self._bounds(int(c)) for c in values), strict=True)
            least += np.stack([x[d] for x in near])[where]
            most += np.stack([x[d] for x in far])[where]
        keep = least <= most.min(axis=1, keepdims=True)
        return [np.flatnonzero(k).astype(np.int32) for k in keep]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part; ties go to the lower entry."""
        cells, where = np.unique(parts // self.cell, axis=0, return_inverse=True)
        names = [c.tobytes() for c in cells]
        fresh = [i for i, n in enumerate(names) if n not in self.known]
        found = dict(zip((names[i] for i in fresh), self._candidates(cells[fresh]), strict=True)) if fresh else {}
        lists = [found[n] if n in found else self.known[n] for n in names]
        if len(self.known) + len(found) > MEMO_CELLS:
            self.known.clear()
        self.known.update(found)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, first = np.concatenate(lists), np.cumsum(sizes) - sizes
        where = where.ravel()
        best, least = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for lo in range(0, len(parts), 256):  # at most 256 x entries exact comparisons at once
            cell = where[lo : lo + 256]
            n = sizes[cell]
            starts = np.cumsum(n) - n
            entry = flat[np.arange(int(n.sum())) + np.repeat(first[cell] - starts, n)]
            off = self.entries[entry] - np.repeat(parts[lo : lo + 256], n, axis=0)
            distance = np.einsum("ij,ij->i", off, off)
            smallest = np.minimum.reduceat(distance, starts)
            hits = np.flatnonzero(distance == np.repeat(smallest, n))
            owner = np.repeat(np.arange(len(n)), n)[hits]
            _, firsts = np.unique(owner, return_index=True)
            best[lo : lo + 256], least[lo : lo + 256] = entry[hits[firsts]], smallest
        return best, least


def _blocks(batches, length: int):
    """(batch, vectors as rows of 64-bit integers)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            v = part.column(part.schema.get_field_index("v"))
            yield part, v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), length)


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(part, entry, position) from the vectors with the smallest ids; at most `entries` rows reach the driver."""
    sizes = [r[0] for r in rows.select(F.size("v").alias("n")).distinct().limit(2).collect()]
    if not sizes:
        return np.zeros((parts, 0, 0), np.int64)
    if len(sizes) > 1 or sizes[0] % parts or not sizes[0]:
        raise ValueError(f"vectors have to be of one length that {parts} parts divide; found lengths {sorted(sizes)}")
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    v = np.array([r["v"] for r in first], np.int64)
    return v.reshape(len(v), parts, -1).swapaxes(0, 1)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> np.ndarray:
    """Codebooks of a written table of quantised vectors."""
    books = first_codebooks(rows, parts, entries)
    width = books.shape[2]
    for _ in range(rounds if books.size else 0):

        def run(batches, books=books):
            memos = [CellMemo(b, cell) for b in books]
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for _, v in _blocks(batches, parts * width):
                for p, memo in enumerate(memos):
                    part = v[:, p * width : (p + 1) * width]
                    entry, _ = memo.nearest(part)
                    np.add.at(sums[p], entry, part)
                    counts[p] += np.bincount(entry, minlength=len(memo.entries))
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"part": pa.array(part), "entry": pa.array(entry), "n": pa.array(counts[part, entry]), "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

        found = rows.select("v").mapInArrow(run, "part long, entry long, n long, sums array<long>")
        total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
        books = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # at most parts x entries rows
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return books


def encode(rows: DataFrame, books: np.ndarray, cell: int = CELL) -> DataFrame:
    """(vec_id, label, codes, error): nearest entries by part and their squared distances' sum."""
    parts, _, width = books.shape

    def run(batches):
        memos = [CellMemo(b, cell) for b in books]
        for batch, v in _blocks(batches, parts * width):
            codes, errors = zip(*(m.nearest(v[:, p * width : (p + 1) * width]) for p, m in enumerate(memos)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(np.stack(codes, axis=1)), pa.list_(pa.int64())), pa.array(sum(errors))], ["vec_id", "label", "codes", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, codes array<long>, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """Add `v`, the scaled vector that the codes stand for."""
    entries = [F.array(*(F.array(*(F.lit(int(x)) for x in e)) for e in b)) for b in books]
    parts = [F.element_at(e, (F.col("codes")[p] + 1).cast("int")) for p, e in enumerate(entries)]
    return codes.withColumn("v", F.concat(*parts))


def op11_cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kept embeddings in four parts of at most 256 entries after four rounds."""
    rows = materialize(quantise(table(spark, sf_dir, "embeddings")), "scaled-vectors")
    books = train(rows)
    out = materialize(encode(rows, books), "vector-codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    hexes = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_ax_label")
    return out.join(sums, F.col("label").eqNullSafe(F.col("_ax_label"))).select(
        "vec_id", hexes.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """The rounds as chained tables: nearest entries, then their components' floored means."""
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""near{k} AS MATERIALIZED (
  SELECT vec_id, label, part, v, arg_min(entry, {{score}}) AS entry, min(dist) AS dist FROM (
    SELECT p.vec_id, p.label, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
    FROM parts p JOIN book{k} b USING (part)) GROUP BY ALL)""".replace("{score}", "dist * 1024 + entry"))
        if k < ROUNDS:
            out.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT part, entry, list(floor_mean ORDER BY i) AS v FROM (
      SELECT part, entry, i, (sum(v[i]) // count(*) - CASE WHEN sum(v[i]) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS floor_mean
      FROM near{k}, range(1, 1 + (SELECT max(len(v)) FROM parts)) r(i) GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry))""")
    return ",\n".join(out)


OP11_SQL = f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: greatest(-{LIMIT}, least({LIMIT}, floor(x::DOUBLE * {SCALE})))::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) r(part)),
book0 AS MATERIALIZED (
  SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM parts) WHERE entry < {ENTRIES}),
{_rounds_sql()},
rows_ AS (SELECT vec_id, label, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows_, digest"""
