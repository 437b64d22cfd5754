"""Time bases: differences, distance, filling, interpolation, resampling, stitching. All keyed by session.

Every function uses the same window (session; t, seq), so a chain of them needs one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY, ORDER = "session_id", ("t", "seq")


def by_time(key: str = KEY, order=ORDER):
    return W.partitionBy(key).orderBy(*order)


def latest(col: Column, key: str = KEY, order=ORDER) -> Column:
    """The last value up to each row."""
    return F.last(col, ignorenulls=True).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))


def next_one(col: Column, key: str = KEY, order=ORDER) -> Column:
    """The first value from each row on. Read backwards, so that the frame grows: one that shrinks is quadratic in Spark."""
    back = [F.col(c).desc() if isinstance(c, str) else c for c in order]
    return F.last(col, ignorenulls=True).over(W.partitionBy(key).orderBy(*back).rowsBetween(W.unboundedPreceding, W.currentRow))


forward_fill, backward_fill = latest, next_one


def time_steps(samples: DataFrame, key: str = KEY) -> DataFrame:
    """Adds `delta`, the time since the sample before."""
    return samples.withColumn("delta", F.col("t") - F.lag("t").over(by_time(key)))


def infer_frequency(samples: DataFrame, key: str = KEY, default: float = 10.0) -> DataFrame:
    """(session, freq_hz): one over the median positive step, to 3 decimals."""
    steps = time_steps(samples.select(key, *ORDER), key)
    step = F.median(F.when(F.col("delta") > 0, F.col("delta")))
    return steps.groupBy(key).agg(F.coalesce(F.round(1 / step, 3), F.lit(default)).alias("freq_hz"))


def add_distance(samples: DataFrame, speed: str = "gps_speed", key: str = KEY, default_hz: float = 10.0) -> DataFrame:
    """Adds `distance` in metres from a speed in km/h. Steps that are missing or not positive take the median step."""
    rows = time_steps(samples, key)
    positive = F.when(F.col("delta") > 0, F.col("delta"))
    usual = F.coalesce(F.median(positive).over(W.partitionBy(key)), F.lit(1.0 / max(default_hz, 1.0)))
    metres = F.coalesce(F.col(speed), F.lit(0.0)) / 3.6 * F.coalesce("_positive", "_step")
    return rows.withColumns({"_positive": positive, "_step": usual}).withColumn("distance", F.sum(metres).over(by_time(key))).drop("delta", "_positive", "_step")


def fill_distance(samples: DataFrame, column: str = "distance", key: str = KEY) -> DataFrame:
    """A distance channel that exists: carried forward, 0 before its first value."""
    return samples.withColumn(column, F.coalesce(forward_fill(F.col(column), key), F.lit(0.0)))


def synthetic_clock(rows: DataFrame, order: list[str], step: float = 0.1, key: str = KEY) -> DataFrame:
    """t as row number times step, for logs without a clock."""
    return rows.withColumn("t", (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1) * step)


def stitch_laps(rows: DataFrame, key: str = KEY, lap: str = "lap") -> DataFrame:
    """Lap-relative times to session times: laps follow each other in order of first appearance.

    rows: key, seq, lap, t. Rows without a time go; a missing lap takes the one before, else 1.
    """
    rows = rows.where(F.col("t").isNotNull())
    rows = rows.withColumn(lap, F.coalesce(forward_fill(F.col(lap), key, ["seq"]), F.lit(1)))
    laps = rows.groupBy(key, lap).agg(F.max("t").alias("_duration"), F.min("seq").alias("_first"))
    ahead = W.partitionBy(key).orderBy("_first").rowsBetween(W.unboundedPreceding, -1)
    offsets = laps.select(key, lap, F.coalesce(F.sum("_duration").over(ahead), F.lit(0.0)).alias("_offset"))
    return rows.join(offsets, [key, lap], "left").withColumn("t", F.col("t") + F.coalesce("_offset", F.lit(0.0))).drop("_offset")


def _between(value: str, axis: str, key: str, order) -> Column:
    """Linear interpolation of `value` along `axis`, carried on at both ends."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(axis).alias("a"), F.col(value).cast("double").alias("v")))
    before, after = latest(known, key, order), next_one(known, key, order)
    span = after["a"] - before["a"]
    mixed = before["v"] + (after["v"] - before["v"]) * (F.col(axis) - before["a"]) / span
    return F.coalesce(F.col(value).cast("double"), F.when(span > 0, mixed), before["v"], after["v"])


def interpolate(samples: DataFrame, columns: list[str], axis: str = "t", key: str = KEY) -> DataFrame:
    """Fills gaps of columns linearly along axis."""
    order = [axis, *(["seq"] if "seq" in samples.columns and axis != "seq" else [])]
    return samples.withColumns({c: _between(c, axis, key, order) for c in columns})


def interpolate_by_position(samples: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """As interpolate, all rows counting as equally far apart."""
    rows = samples.withColumn("_pos", F.row_number().over(by_time(key)).cast("double"))
    return rows.withColumns({c: _between(c, "_pos", key, ["_pos"]) for c in columns}).drop("_pos")


def one_per_time(samples: DataFrame, key: str = KEY) -> DataFrame:
    """The first row of every time, rows without a time dropped."""
    w = W.partitionBy(key, "t").orderBy("seq")
    return samples.where(F.col("t").isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resample(samples: DataFrame, columns: list[str], fps: float = 10.0, duration: float | None = None, time_shift: float = 0.0, clip_start: float = 0.0, key: str = KEY, lap: str | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Samples on the frame grid of a clip: (session, frame, video_time, t, columns).

    Frame i shows telemetry time clip_start + time_shift + i / fps, held within the session's extent. Without a duration
    the grid covers the session. rates (session, hz) sets a rate for each session in place of fps. Columns are interpolated linearly; `lap`, a step channel, takes the value before.
    Frames come out of the samples, so only samples are shuffled and sorted.
    """
    rows = samples.select(key, *ORDER, *columns, *([lap] if lap else [])).where(F.col("t").isNotNull())
    rows = rows.withColumn("_before", F.lag("t").over(by_time(key))).where("_before IS NULL OR _before <> t")
    if rates is not None:
        rows = rows.join(rates.select(key, F.col("hz").alias("_hz")), key)
    else:
        rows = rows.withColumn("_hz", F.lit(float(fps)))
    w, back, whole = W.partitionBy(key).orderBy("t"), W.partitionBy(key).orderBy(F.desc("t")), W.partitionBy(key)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("t").alias("a"), F.col(c).cast("double").alias("v"))) for c in columns}
    rows = rows.withColumns({f"_next_{c}": F.last(k, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)) for c, k in known.items()})
    rows = rows.withColumns({f"_last_{c}": latest(k, key, ["t"]) for c, k in known.items()} | {"_t1": F.max("t").over(whole), "_t0": F.min("t").over(whole), "_until": F.lead("t").over(w)})
    if lap:
        rows = rows.withColumn(lap, F.coalesce(latest(F.col(lap), key, ["t"]), F.lit(0)))
    length = F.lit(float(duration)) if duration is not None else F.col("_t1") - F.col("_t0")
    origin = F.lit(clip_start + time_shift) if duration is not None else F.col("_t0") + clip_start + time_shift
    rows = rows.withColumns({"_o": origin, "_n": F.greatest(F.lit(1), F.ceil(length * F.col("_hz")).cast("int"))})
    # each sample gives the frames up to the next one: about which they are, then exactly
    at = lambda t, off: F.greatest(F.lit(0.0), F.least(F.col("_n") - F.lit(1.0), F.floor((t - F.col("_o")) * F.col("_hz")) + off)).cast("int")
    first = F.when(F.col("t") == F.col("_t0"), 0).otherwise(at(F.col("t"), F.lit(-1)))
    last = F.when(F.col("_until").isNull(), F.col("_n") - 1).otherwise(at(F.col("_until"), F.lit(1)))
    out = rows.withColumn("frame", F.explode(F.sequence(first, last)))
    video_time = F.col("frame") / F.col("_hz")
    shown = F.least(F.greatest(F.col("_o") + video_time, F.col("_t0")), F.col("_t1"))
    out = out.withColumns({"_from": F.col("t"), "t": shown, "video_time": video_time + clip_start}).where("t >= _from AND (_until IS NULL OR t < _until)")

    def mixed(c: str) -> Column:
        before, after = F.col(f"_last_{c}"), F.col(f"_next_{c}")
        span = after["a"] - before["a"]
        return F.coalesce(F.when(span > 0, before["v"] + (after["v"] - before["v"]) * (F.col("t") - before["a"]) / span), before["v"], after["v"]).alias(c)

    return out.select(key, "frame", "video_time", "t", *(mixed(c) for c in columns), *([lap] if lap else []))
