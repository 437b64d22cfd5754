"""Operator 4: audio media columns and their features.

A payload of bytes is stored as 8-bit mono PCM in a WAV container (a binary column, built by Spark expressions) and read
back from there sample by sample. Features: polyphase resampling from 16 to 10 kHz (5 up, 8 down, windowed-sinc filter in
5 phases), log-mel filterbanks over frames that overlap by half, and segmentation of the frame energies with hysteresis (a
segment opens at the high and closes below the low threshold, both quantiles of the clip's own energies). Log-mels are
stored as fixed-shape Arrow tensors of TENSOR_FRAMES x MELS with their time spans, one Arrow stream per clip.

Each clip is computed alone with the same operations, so equal texts give equal bytes. Defined results: null and empty
texts give 64 zero bytes of payload; a clip shorter than a frame has one frame, padded with silence; repeated rows give
repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

RATE, UP, DOWN, TAPS = 16_000, 5, 8, 16
FRAME, HOP, MELS, TENSOR_FRAMES = 256, 128, 24, 32
WAV_HEADER = 44
SCHEMA = "doc_id long, n_bytes long, media binary, tensors binary, frames long, segments array<struct<start_s: double, end_s: double>>, level_db double"


def _le(value: Column, width: int) -> Column:
    h = F.lpad(F.hex(value), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(width)))))


def payload_of(text: Column, block: int = 64) -> Column:
    """UTF-8 bytes of text and zero bytes up to a positive multiple of `block`."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / block)).cast("int") * block
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), size - F.octet_length(raw))))


def wav_of(payload: Column, rate: int = RATE) -> Column:
    """The payload's bytes as samples of 8-bit mono PCM."""
    n = F.octet_length(payload)
    u32, u16 = lambda v: _le(v, 4), lambda v: _le(F.lit(v), 2)
    tag = lambda s: F.lit(s.encode())
    return F.concat(tag("RIFF"), u32(n + 36), tag("WAVEfmt "), u32(F.lit(16)), u16(1), u16(1), u32(F.lit(rate)), u32(F.lit(rate)), u16(1), u16(8), tag("data"), u32(n), payload)


def _filter() -> np.ndarray:
    """Windowed sinc of TAPS taps a phase, as (phase, tap)."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h * UP / h.sum()).reshape(TAPS, UP).T[:, ::-1].astype(np.float32)


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)
    rise, fall = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None], (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(rise, fall), 0, None).T.astype(np.float32)


_H, _BANK, _WINDOW = _filter(), _mel_bank(RATE * UP / DOWN), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at RATE to RATE * UP / DOWN; output j is the filter's phase (j * DOWN) mod UP at sample (j * DOWN) div UP."""
    n = -(-len(x) * UP // DOWN)
    views = sliding_window_view(np.concatenate((np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS, np.float32))), TAPS)
    y = np.empty(n, np.float32)
    for first in range(min(UP, n)):
        at = np.arange(first, n, UP) * DOWN
        y[first::UP] = views[at // UP] @ _H[(first * DOWN) % UP]
    return y


def hysteresis(energy: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
    """Runs of frames (first, one past the last) that open at `high` and stay until below `low`."""
    change = np.where(energy >= high, 1, np.where(energy < low, -1, 0))
    last = np.maximum.accumulate(np.where(change != 0, np.arange(len(change)), -1))
    on = (last >= 0) & (change[np.maximum(last, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(wav: bytes) -> tuple[bytes, int, list[dict], float]:
    """Tensor stream, number of frames, segments and mean level of a stored clip."""
    x = (np.frombuffer(wav, np.uint8, offset=WAV_HEADER).astype(np.float32) - 128) / 128
    y = resample(x)
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate((y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)))
    power = np.abs(np.fft.rfft(sliding_window_view(y, FRAME)[::HOP] * _WINDOW)) ** 2
    mels = 10 * np.log10(power.astype(np.float32) @ _BANK + np.float32(1e-6))
    energy = mels.mean(axis=1)
    step = HOP * DOWN / (UP * RATE)
    runs = hysteresis(energy, *np.quantile(energy, [0.4, 0.7]))
    blocks = -(-n // TENSOR_FRAMES)
    cube = np.full((blocks * TENSOR_FRAMES, MELS), -60, np.float32)
    cube[:n] = mels
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(cube.reshape(blocks, TENSOR_FRAMES, MELS))
    starts = np.arange(blocks) * TENSOR_FRAMES
    ends = np.minimum(starts + TENSOR_FRAMES, n)
    batch = pa.RecordBatch.from_arrays([tensor, pa.array(starts * step), pa.array((ends - 1) * step + FRAME * DOWN / (UP * RATE))], ["log_mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    segments = [{"start_s": a * step, "end_s": b * step} for a, b in runs]
    return sink.getvalue().to_pybytes(), n, segments, float(energy.mean())


def read_tensors(stream: bytes) -> pa.Table:
    """(log_mel tensor, start_s, end_s) of one clip."""
    return pa.ipc.open_stream(stream).read_all()


def _features(batches):
    segment = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    for b in pieces(batches, "media", 4 << 20):
        found = [features(w) for w in b.column("media").to_pylist()]
        tensors, n, segments, level = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"), b.column("media"), pa.array(tensors, pa.binary()), pa.array(n, pa.int64()), pa.array(segments, segment), pa.array(level, pa.float64())],
            ["doc_id", "n_bytes", "media", "tensors", "frames", "segments", "level_db"])


def audio_features(clips: DataFrame) -> DataFrame:
    """(doc_id, n_bytes of content, media WAV) with tensors, frames, segments and level."""
    return clips.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(_features, SCHEMA)


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored clip with its features, digests taken from the stored bytes."""
    docs = table(spark, sf_dir, "documents")
    clips = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"), wav_of(payload_of(F.col("text"))).alias("media"))
    payload = F.substring(F.col("media"), WAV_HEADER + 1, 1 << 30)
    active = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["end_s"] - s["start_s"])
    feature = F.format_string("frames=%d segments=%d active=%.3fs level=%.3fdB tensors=%s", "frames", F.size("segments"), active, "level_db", F.sha2("tensors", 256))
    return audio_features(clips).select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("media"), -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
