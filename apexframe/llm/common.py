"""Shared helpers of the training-data operators: table access, shared scratch space, text kernels."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, label: str, column: str) -> DataFrame:
    """Like materialize, bucketed by a column: a join on it leaves these rows where they are.

    Both sides of such a join have to be near unique in the column, as Spark doesn't split a skewed bucket. The table is
    taken out of the catalogue at once; its files stay in the shared folder.
    """
    spark, name = df.sparkSession, f"apexframe_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", shared_dir(spark, label)).bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


# --- vectorised text kernels over Arrow string batches -------------------------------------------------------------

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAMMA = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _GAMMA) | U64(1)
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Bytes (or hashes) that the kernels below hold in working arrays at once, whatever a text's length.
SEGMENT = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_POWER, _INVERSE = _powers(_BASE, 2 * SEGMENT), _powers(_UNBASE, SEGMENT)  # 3 MB


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end of every word, and of every text the index of its first word (one more than texts).

    Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D; no word crosses a text's end.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts, ends = [], []
    for lo in range(0, n, SEGMENT):
        hi = min(n, lo + SEGMENT)
        solid = np.zeros(hi - lo + 2, dtype=bool)  # with one byte more on either side
        a, b = max(0, lo - 1), min(n, hi + 1)
        solid[a - lo + 1 : b - lo + 1] = ~_WHITE[data[a:b]]
        edge = np.zeros(hi - lo + 1, dtype=bool)  # a text begins or ends here
        edge[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo] = True
        core = solid[1:-1]
        starts.append(np.flatnonzero(core & (~solid[:-2] | edge[:-1])) + lo)
        ends.append(np.flatnonzero(core & (~solid[2:] | edge[1:])) + lo + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def _long_sum(word: np.ndarray) -> int:
    """The polynomial of a word of any length, segment by segment."""
    total, shift, step = 0, 1, pow(_BASE, SEGMENT, 1 << 64)
    for lo in range(0, len(word), SEGMENT):
        part = _BYTE_CODE[_FOLD[word[lo : lo + SEGMENT]]]
        total += int((part * _POWER[: len(part)]).sum(dtype=np.uint64)) * shift
        shift = shift * step & 0xFFFFFFFFFFFFFFFF
    return total & 0xFFFFFFFFFFFFFFFF


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word with A-Z lower-cased, and the first word's index of every text."""
    data, offsets = utf8_buffers(column)
    starts, ends, first = word_spans(data, offsets)
    out = np.empty(len(starts), np.uint64)
    sums = np.zeros(2 * SEGMENT + 1, np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(starts, lo + SEGMENT))
        if ends[j - 1] - lo > 2 * SEGMENT:  # only the last of them can be so long
            j -= 1
            out[j] = _long_sum(data[starts[j] : ends[j]])
        if j > i:
            n = int(ends[j - 1]) - lo
            np.cumsum(_BYTE_CODE[_FOLD[data[lo : lo + n]]] * _POWER[:n], out=sums[1 : n + 1])
            out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * _INVERSE[starts[i:j] - lo]
        i = int(np.searchsorted(starts, lo + SEGMENT))
    for lo in range(0, len(out), SEGMENT):
        part = slice(lo, lo + SEGMENT)
        out[part] = mix64(out[part] + (ends[part] - starts[part]).astype(np.uint64) * _GAMMA)
    return out, first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words (over text borders too: the caller cuts those)."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for lo in range(0, n, SEGMENT):
        part = out[lo : lo + SEGMENT]
        for i in range(size):
            part *= U64(_BASE)
            part += words[lo + i : lo + i + len(part)]
        part[:] = mix64(part)
    return out


def run_hashes(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` values from each of the (ascending) starts, order included."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(starts, lo + SEGMENT))
        part = values[lo : int(starts[j - 1]) + size]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * _POWER[: len(part)], dtype=np.uint64)))
        at = starts[i:j] - lo
        out[i:j] = mix64((sums[at + size] - sums[at]) * _INVERSE[at])
        i = j
    return out


def pieces(batches, column: str, limit: int = 2 << 20):
    """Cut Arrow batches so that no piece holds much more than `limit` bytes of `column`; a row is never cut."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < n:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
