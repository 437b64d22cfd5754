"""Line crossings, laps and lap statistics, for all sessions at once."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from .timebase import KEY, ORDER, by_time

Line = tuple[float, float, float, float]


def crossings_by_segment(samples: DataFrame, line: Line, key: str = KEY) -> DataFrame:
    """(session, k, t_cross): where the path between two samples cuts the segment; times are interpolated."""
    w = by_time(key)
    steps = samples.where("t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select(
        key, *ORDER, "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.lead("t").over(w).alias("t2"))
    moving = steps.where("x2 IS NOT NULL AND (x <> x2 OR y <> y2)")
    share = geo.step_crossing(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), line)
    found = moving.withColumn("_u", share).where("_u IS NOT NULL").select(key, (F.col("t") + F.col("_u") * (F.col("t2") - F.col("t"))).alias("t_cross"))
    return found.select(key, F.row_number().over(W.partitionBy(key).orderBy("t_cross")).alias("k"), "t_cross")


def crossings_by_sign(samples: DataFrame, line: Line, near: float = 20.0, min_gap: float = 30.0, key: str = KEY) -> DataFrame:
    """(session, k, t_cross): where the side of the endless line changes near it (on the line counts as one side),
    at least min_gap after the last one kept."""
    x, y, w = F.col("x"), F.col("y"), by_time(key)
    rows = samples.where("t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select(
        key, *ORDER, geo.line_side(x, y, line).alias("c"), (geo.line_distance(x, y, line) <= near).alias("near"))
    rows = rows.select("*", F.lag("c").over(w).alias("c0"), F.lag("near").over(w).alias("near0"), F.lag("t").over(w).alias("t0"))
    found = rows.where("(c0 >= 0) <> (c >= 0) AND (near OR near0)").select(key, (F.col("t0") + F.col("c0") / (F.col("c0") - F.col("c")) * (F.col("t") - F.col("t0"))).alias("t_cross"))
    return debounce(found, min_gap, key)


def debounce(crossings: DataFrame, min_gap: float, key: str = KEY) -> DataFrame:
    """Keeps a crossing only if it comes min_gap or more after the last one kept. A session has tens of crossings."""
    lists = crossings.groupBy(key).agg(F.sort_array(F.collect_list("t_cross")).alias("all"))
    kept = F.aggregate("all", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) >= min_gap), F.concat(a, F.array(x))).otherwise(a))
    return lists.select(key, F.posexplode(kept).alias("k", "t_cross")).withColumn("k", F.col("k") + 1)


def assign_laps(samples: DataFrame, crossings: DataFrame, mark_end: bool = False, key: str = KEY) -> DataFrame:
    """Adds lap (crossings up to t) and lap_time (since the last crossing, or the session's start).

    Samples and crossings go through one window in order of time: an as-of join without a join. With mark_end samples
    after the last of two or more crossings get lap -1.
    """
    marks = crossings.select(key, F.col("t_cross").alias("t"), F.lit(-1).cast("long").alias("seq"), F.lit(1).alias("_mark"))
    both = samples.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("t", F.desc("_mark"), "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(key)
    start = F.coalesce(F.last(F.when(F.col("_mark") == 1, F.col("t")), ignorenulls=True).over(w), F.min(F.when(F.col("_mark") == 0, F.col("t"))).over(whole))
    out = both.withColumns({"lap": F.sum("_mark").over(w).cast("int"), "lap_time": F.greatest(F.lit(0.0), F.col("t") - start)})
    if mark_end:
        total = F.sum("_mark").over(whole)
        out = out.withColumn("lap", F.when((total >= 2) & (F.col("lap") == total), F.lit(-1)).otherwise(F.col("lap")))
    return out.where("_mark = 0").drop("_mark")


def lap_durations(samples: DataFrame, crossings: DataFrame, key: str = KEY) -> DataFrame:
    """(session, lap, start_t, end_t, duration, completed): lap 0 runs from the session's start, the last one to its end."""
    extent = samples.groupBy(key).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    starts = crossings.select(key, F.col("k").cast("int").alias("lap"), F.col("t_cross").alias("start_t"))
    starts = starts.unionByName(extent.select(key, F.lit(0).alias("lap"), F.col("t0").alias("start_t")))
    follow = F.lead("start_t").over(W.partitionBy(key).orderBy("lap"))
    laps = starts.withColumn("_next", follow).join(extent, key)
    laps = laps.select(key, "lap", "start_t", F.coalesce("_next", "t1").alias("end_t"), ((F.col("lap") >= 1) & F.col("_next").isNotNull()).alias("completed"))
    return laps.withColumn("duration", F.col("end_t") - F.col("start_t"))


def lap_stats(lapped: DataFrame, laps: DataFrame, speed: str = "gps_speed", rpm: str = "rpm", key: str = KEY) -> DataFrame:
    """(session, lap, time, min/max speed, min/max rpm): exact durations, else the greatest lap time seen."""
    stats = lapped.groupBy(key, "lap").agg(
        F.max("lap_time").alias("_seen"), F.min(speed).alias("min_speed"), F.max(speed).alias("max_speed"), F.min(rpm).alias("min_rpm"), F.max(rpm).alias("max_rpm"))
    exact = laps.where("completed OR lap = 0").select(key, "lap", "duration")
    return stats.join(exact, [key, "lap"], "left").select(
        key, "lap", F.coalesce("duration", "_seen").alias("time"), "min_speed", "max_speed", "min_rpm", "max_rpm")


def best_laps(laps: DataFrame, min_time: float = 20.0, include_incomplete: bool = False, key: str = KEY) -> DataFrame:
    """(session, lap, duration) of the fastest valid lap, the earlier one on ties."""
    valid = laps.where(F.col("duration") > min_time)
    if not include_incomplete:
        valid = valid.where("completed AND lap >= 1")
    return valid.groupBy(key).agg(F.min_by("lap", F.struct("duration", "lap")).alias("lap"), F.min("duration").alias("duration"))


def lap_status(stats: DataFrame, best: DataFrame, current: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """Adds status: best, current (as in current: session, lap) or done."""
    out = stats.join(best.select(key, F.col("lap").alias("_best")), key, "left")
    if current is not None:
        out = out.join(current.select(key, F.col("lap").alias("_now")), key, "left")
    else:
        out = out.withColumn("_now", F.lit(None).cast("int"))
    status = F.when(F.col("lap") == F.col("_best"), "best").when(F.col("lap") == F.col("_now"), "current").otherwise("done")
    return out.withColumn("status", status).drop("_best", "_now")


def append_current(stats: DataFrame, current: DataFrame, key: str = KEY) -> DataFrame:
    """Adds the rows of current whose lap stats lacks."""
    return stats.unionByName(current.join(stats, [key, "lap"], "left_anti"), allowMissingColumns=True)


def page(rows: DataFrame, target: DataFrame, size: int, key: str = KEY, order: str = "lap") -> DataFrame:
    """At most `size` rows of each session, centred on the target row (session, order), held within both ends."""
    w = W.partitionBy(key)
    ranked = rows.withColumns({"_rn": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    at = ranked.join(target.select(key, F.col(order).alias("_at")), key, "left")
    rank = F.coalesce(F.max(F.when(F.col(order) == F.col("_at"), F.col("_rn"))).over(w), F.lit(1))
    first = F.greatest(F.lit(1), F.least(rank - size // 2, F.col("_n") - size + 1))
    return at.withColumn("_first", first).where((F.col("_rn") >= F.col("_first")) & (F.col("_rn") < F.col("_first") + size)).drop("_rn", "_n", "_at", "_first")


def align_laps(computed: DataFrame, stated: DataFrame, tolerance: float = 1.0, key: str = KEY) -> DataFrame:
    """Two lists of laps (session, lap, duration) side by side: (session, lap, stated_lap, duration, stated_s, diff, status).

    The alignment keeps both orders and has the least cost: two laps cost the difference of their durations, which may be
    tolerance at most, and a lap that only one list has costs tolerance. Of equal costs a pair comes first, then a lap that
    only the computed list has. status: match, extra (computed only) or missing (stated only). Laps without a duration are
    left out; a session of one list only has all its laps as extra or missing. A session's laps (tens) are one row; tasks go
    through a session's table of costs row by row (`align_seconds`).
    """
    listed = lambda df, name: df.where(F.col("duration").isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("lap").cast("int").alias("lap"), F.col("duration").cast("double").alias("s")))).alias(name))
    empty = F.array().cast("array<struct<lap:int,s:double>>")
    both = listed(computed, "_a").join(listed(stated, "_b"), key, "full").select(key, F.coalesce("_a", empty).alias("_a"), F.coalesce("_b", empty).alias("_b"))
    seconds = both.select(key, "_a", "_b", F.col("_a.s").alias("_as"), F.col("_b.s").alias("_bs"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields) + ", _path array<struct<a:int,b:int>>"
    rows = seconds.mapInArrow(partial(_aligned, float(tolerance)), schema).select(key, "_a", "_b", F.explode("_path").alias("_p"))
    rows = rows.select(key, F.get("_a", F.col("_p.a")).alias("_a"), F.get("_b", F.col("_p.b")).alias("_b"))
    status = F.when(F.col("_b").isNull(), "extra").when(F.col("_a").isNull(), "missing").otherwise("match")
    return rows.select(key, F.col("_a.lap").alias("lap"), F.col("_b.lap").alias("stated_lap"), F.col("_a.s").alias("duration"), F.col("_b.s").alias("stated_s"), (F.col("_a.s") - F.col("_b.s")).alias("diff"), status.alias("status"))


def _aligned(gap: float, batches):
    """Batches with _as and _bs (seconds) as they are without these, and _path."""
    for batch in batches:
        paths = [align_seconds(a, b, gap) for a, b in zip(batch.column("_as").to_pylist(), batch.column("_bs").to_pylist(), strict=True)]
        path = pa.array([[{"a": i, "b": j} for i, j in p] for p in paths], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        kept = [c for c in batch.schema.names if c not in ("_as", "_bs")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), path], [*kept, "_path"])


def align_seconds(a: list[float], b: list[float], gap: float) -> list[tuple[int | None, int | None]]:
    """Places (in a, in b) of the alignment of least cost, see align_laps; a byte for each two laps."""
    above, moves = [0.0], []
    for _ in b:
        above.append(above[-1] + gap)
    for x in a:
        row, taken = [above[0] + gap], bytearray(len(b))  # 0 extra, 1 pair, 2 missing
        for j, y in enumerate(b):
            off, extra, missing = abs(x - y), above[j + 1] + gap, row[j] + gap
            pair = above[j] + off
            if off <= gap and pair <= extra and pair <= missing:
                taken[j] = 1
                row.append(pair)
            elif extra <= missing:
                row.append(extra)
            else:
                taken[j] = 2
                row.append(missing)
        above = row
        moves.append(taken)
    i, j, path = len(a), len(b), []
    while i or j:
        move = 2 if not i else 0 if not j else moves[i - 1][j - 1]
        i, j = i - (move != 2), j - (move != 0)
        path.append((None if move == 2 else i, None if move == 0 else j))
    return path[::-1]
