"""Samples to video frames in one pass: crossings, laps, best lap, delta and frames over one distribution by session.

Every step is a window or a generator over rows that stay where one exchange by session has put them; nothing is joined
with itself and the samples are read once. Line crossings become rows of their own among the samples, so that all that
follows is "the latest row up to here".

The lap and the lap time of a frame are exact: crossings up to the frame's time, and the time since the last one (since the
session's start before the first). Channels are interpolated between the samples on either side; the delta only between
samples of one lap, else it is that of the neighbour on the frame's own side of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.laps import Line
from ..operators.timebase import KEY, by_time

_UP_TO, _BEFORE = (W.unboundedPreceding, W.currentRow), (W.unboundedPreceding, -1)


def _known(col: str | Column, *more: str) -> Column:
    """(t, v, more) where the column has a value."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isNotNull(), F.struct(F.col("t"), col.cast("double").alias("v"), *more))


def by_session(samples: DataFrame, key: str = KEY) -> DataFrame:
    """Samples dealt by session to spark.sql.shuffle.partitions tasks, not fewer: frames are many more than samples, so that
    joining small partitions by the samples' size would leave few tasks with all of them."""
    return samples.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def with_crossings(samples: DataFrame, line: Line, key: str = KEY) -> DataFrame:
    """Samples that have a time, and a row with `mark` 1 for each crossing of the segment `line`, its other columns null.

    Adds mark, lap (crossings so far) and lap_start (time of the last crossing, else of the session's start), and t0 and t1,
    the session's extent. A sample at a crossing's time comes after it.
    """
    place = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("t", "x", "y"))
    last = F.last(place, ignorenulls=True).over(by_time(key).rowsBetween(*_BEFORE))
    rows = samples.where(F.col("t").isNotNull()).withColumn("_p", last)
    share = geo.step_crossing(F.col("_p.x"), F.col("_p.y"), F.col("x"), F.col("y"), line)
    moved = (F.col("_p.x") != F.col("x")) | (F.col("_p.y") != F.col("y"))
    at = F.when(moved & share.isNotNull(), F.col("_p.t") + share * (F.col("t") - F.col("_p.t")))
    kinds = F.when(F.col("_at").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(0)))
    rows = rows.withColumn("_at", at).withColumn("mark", F.explode(kinds))
    values = {c: F.when(F.col("mark") == 0, F.col(c)) for c in samples.columns if c not in (key, "t", "seq")}
    rows = rows.withColumns(values | {"t": F.when(F.col("mark") == 1, F.col("_at")).otherwise(F.col("t")), "seq": F.when(F.col("mark") == 0, F.col("seq"))})
    upto = _order(key).rowsBetween(*_UP_TO)
    rows = rows.withColumns({
        "lap": F.sum("mark").over(upto).cast("int"), "_mark_t": F.last(F.when(F.col("mark") == 1, F.col("t")), ignorenulls=True).over(upto),
        "t0": F.min("t").over(W.partitionBy(key)), "t1": F.max(F.when(F.col("mark") == 0, F.col("t"))).over(W.partitionBy(key))})
    return rows.withColumn("lap_start", F.coalesce("_mark_t", "t0")).drop("_p", "_at", "_mark_t")


def _order(key: str):
    return W.partitionBy(key).orderBy("t", F.desc("mark"), "seq")


def with_best_lap(rows: DataFrame, min_time: float = 20.0, key: str = KEY) -> DataFrame:
    """Adds best_lap, the fastest complete lap of more than min_time, the earlier on ties."""
    before = F.last(F.when(F.col("mark") == 1, F.col("t")), ignorenulls=True).over(_order(key).rowsBetween(*_BEFORE))
    done = F.when((F.col("mark") == 1) & (F.col("t") - F.col("_before") > min_time), F.struct((F.col("t") - F.col("_before")).alias("d"), (F.col("lap") - 1).alias("lap")))
    return rows.withColumn("_before", before).withColumn("best_lap", F.min(done).over(W.partitionBy(key))["lap"]).drop("_before")


def with_delta(rows: DataFrame, distance: str = "distance", key: str = KEY) -> DataFrame:
    """Adds lap_time, along (distance in the lap) and delta to the best lap at the same distance."""
    rows = rows.withColumn("lap_time", F.greatest(F.lit(0.0), F.col("t") - F.col("lap_start")))
    rows = rows.withColumn("along", F.col(distance) - F.min(distance).over(W.partitionBy(key, "lap")))
    best = F.min(F.when((F.col("lap") == F.col("best_lap")) & F.col("along").isNotNull(), F.col("lap_time"))).over(W.partitionBy(key, "along"))
    rows = rows.withColumn("_p", F.when(F.col("along").isNotNull(), best))
    point = F.when(F.col("_p").isNotNull(), F.struct(F.col("along").alias("d"), F.col("_p").alias("t")))
    side = lambda order: F.last(point, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(*_UP_TO))
    rows = rows.withColumns({"_b": side(F.col("along").asc()), "_a": side(F.col("along").desc())})
    span = F.col("_a.d") - F.col("_b.d")
    linear = F.col("_b.t") + (F.col("_a.t") - F.col("_b.t")) * (F.col("along") - F.col("_b.d")) / span
    predicted = F.coalesce("_p", F.when(span > 0, linear), F.col("_b.t"), F.col("_a.t"))
    return rows.withColumn("delta", F.when(F.col("along").isNotNull(), F.col("lap_time") - predicted)).drop("_p", "_b", "_a")


def frames_of(rows: DataFrame, columns: list[str], fps: float, key: str = KEY) -> DataFrame:
    """(session, frame, video_time, t, lap, lap_time, delta, columns) on a grid of fps over each session's extent.

    The frames between a row and the next one come out of that row. Of samples with one time the first counts. Columns of
    rows named min_ or max_ are taken along.
    """
    order = _order(key)
    earlier = F.max(F.when(F.col("mark") == 0, F.col("t"))).over(order.rowsBetween(*_BEFORE))
    rows = rows.withColumn("_earlier", earlier)
    rows = rows.withColumn("_first", (F.col("mark") == 0) & (F.col("_earlier").isNull() | (F.col("_earlier") < F.col("t"))))
    known = {c: F.when(F.col("_first"), _known(c, "lap")) for c in [*columns, "delta"]}
    rows = rows.withColumns({f"_k_{c}": k for c, k in known.items()})
    backwards = W.partitionBy(key).orderBy(F.desc("t"), "mark", F.desc("seq"))
    rows = rows.withColumns({f"_a_{c}": F.last(f"_k_{c}", ignorenulls=True).over(backwards.rowsBetween(*_BEFORE)) for c in known})
    rows = rows.withColumns({f"_b_{c}": F.last(f"_k_{c}", ignorenulls=True).over(order.rowsBetween(*_UP_TO)) for c in known})
    # a line for each column and sample, so that little is left to do for each frame: a generated method of more than 8,000
    # bytes is not compiled by the JVM
    rows = rows.withColumns({f"_l_{c}": _line(F.col(f"_b_{c}"), F.col(f"_a_{c}"), F.col("lap") if c == "delta" else None) for c in known})
    hz = F.lit(float(fps))
    rows = rows.withColumns({"_n": F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) * hz).cast("int")) - 1, "_begin": F.greatest(F.lit(0), F.ceil((F.col("t") - F.col("t0")) * hz).cast("int") - 1)})
    rows = rows.withColumn("_next", F.lead("t").over(order))
    end = F.when(F.col("_next").isNull(), F.col("_n")).otherwise(F.least("_n", F.ceil((F.col("_next") - F.col("t0")) * hz).cast("int")))
    rows = rows.withColumn("_end", end).where("_begin <= _end")
    found = rows.withColumn("frame", F.explode(F.sequence("_begin", "_end")))
    found = found.withColumn("_at", F.least(F.col("t0") + F.col("frame") / hz, F.col("t1"))).where((F.col("_at") >= F.col("t")) & (F.col("_next").isNull() | (F.col("_at") < F.col("_next"))))
    value = lambda c: F.col(f"_l_{c}")["v"] + F.col(f"_l_{c}")["s"] * (F.col("_at") - F.col(f"_l_{c}")["t"])
    kept = [c for c in rows.columns if c.startswith(("min_", "max_"))]
    return found.select(
        key, "frame", (F.col("frame") / hz).alias("video_time"), F.col("_at").alias("t"), "lap", F.greatest(F.lit(0.0), F.col("_at") - F.col("lap_start")).alias("lap_time"),
        *(value(c).alias(c) for c in known), *kept)


def _line(before: Column, after: Column, lap: Column | None) -> Column:
    """(t, v, s): value v at t and its slope between two known values; flat where one is missing, or across laps."""
    span = after["t"] - before["t"]
    slope = F.when(span > 0, (after["v"] - before["v"]) / span)
    held = F.coalesce(before, after)
    if lap is not None:
        slope = F.when(before["lap"] == after["lap"], slope)
        held = F.when((before["lap"] == lap) | (after["lap"] != lap) | after.isNull(), held).otherwise(after)
    return F.when(held.isNotNull(), F.struct(held["t"].alias("t"), held["v"].alias("v"), F.coalesce(slope, F.lit(0.0)).alias("s")))


def session_frames(samples: DataFrame, line: Line, fps: float, columns: list[str], distance: str = "distance", min_time: float = 20.0, key: str = KEY) -> DataFrame:
    """Frames of all sessions, with every column's least and greatest value in the session (min_c, max_c)."""
    whole = W.partitionBy(key)
    rows = with_delta(with_best_lap(with_crossings(samples, line, key), min_time, key), distance, key)
    rows = rows.withColumns({f"{f}_{c}": getattr(F, f)(c).over(whole) for c in columns for f in ("min", "max")})
    return frames_of(rows, columns, fps, key)
