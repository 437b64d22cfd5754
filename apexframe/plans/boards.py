"""Composite tables that users ask for: frames, lap board, sector board, session report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, geo, values
from ..operators import laps
from . import frames


def frame_table(samples: DataFrame, line: laps.Line, fps: float, speed: str = "gps_speed", rpm: str = "rpm", distance: str = "distance", min_time: float = 20.0) -> DataFrame:
    """One row a video frame: values, gauges, lap labels, delta to best, place in the unit square, clock.

    samples: session_id, seq, t, x, y, speed, rpm, distance. One exchange by session; see plans.frames for the rules.
    """
    f = frames.session_frames(samples, line, fps, [speed, rpm, "x", "y"], distance, min_time)
    ratio = lambda c: values.gauge_ratio(F.col(c), F.col(f"max_{c}"))
    return f.select(
        "session_id", "frame", "video_time", "t", speed, rpm, ratio(speed).alias("speed_ratio"), values.gauge_zone(ratio(speed)).alias("speed_zone"),
        ratio(rpm).alias("rpm_ratio"), values.gauge_zone(ratio(rpm)).alias("rpm_zone"), "lap", clock.lap_label(F.col("lap")).alias("lap_label"),
        "lap_time", clock.duration_label(F.col("lap_time")).alias("lap_clock"),
        values.clamp(F.col("delta"), -2.0, 2.0).alias("delta"), clock.delta_class(F.col("delta")).alias("delta_class"), clock.delta_label(F.col("delta")).alias("delta_label"),
        geo.unit_x(F.col("x"), F.col("min_x"), F.col("max_x"), True).alias("nx"), geo.unit_y(F.col("y"), F.col("min_y"), F.col("max_y"), True).alias("ny"),
        clock.clock_label(F.col("video_time")).alias("clock"))


def lap_board(stats: DataFrame, best: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """All laps with status and labels, in order."""
    out = laps.lap_status(stats, best, current)
    return out.select(
        "session_id", "lap", clock.lap_label(F.col("lap")).alias("lap_label"), "time", clock.duration_label(F.col("time")).alias("time_label"), "status",
        clock.range_label(F.col("min_speed"), F.col("max_speed")).alias("speed_label"), clock.range_label(F.col("min_rpm"), F.col("max_rpm")).alias("rpm_label"))


def sector_board(segments: DataFrame, stats: DataFrame, of: DataFrame) -> DataFrame:
    """Segments of each session's track with the lowest and highest speed of the chosen lap; straights show both.

    segments: track.segments; stats: track.segment_stats; of: (session_id, lap, track_id).
    """
    rows = of.join(segments, "track_id").join(stats, ["session_id", "lap", "segment"], "left")
    shown = F.when(F.col("kind") == "straight", clock.range_label(F.col("min_speed"), F.col("max_speed")))
    return rows.select("session_id", "lap", "track_id", "segment", "label", "kind", "points", "mid_x", "mid_y", "min_speed", "max_speed", F.coalesce(shown, F.lit("")).alias("speed_label"))


def beacon_report(beacons: DataFrame, details: DataFrame) -> DataFrame:
    """(path, total_laps, fastest_lap, fastest_s, agrees) from beacons, held against the file's own details."""
    gap = F.lead("t_cross").over(W.partitionBy("path").orderBy("k")) - F.col("t_cross")
    timed = beacons.withColumn("duration", gap)
    found = timed.groupBy("path").agg((F.count("*") + 1).cast("int").alias("total_laps"), F.min_by("k", "duration").alias("fastest_lap"), F.min("duration").alias("fastest_s"))
    cut = F.floor(F.col("fastest_s") * 1000) / 1000  # whole milliseconds, cut off
    stated = details.select("path", F.col("total_laps").alias("_n"), F.col("fastest_lap").alias("_k"), clock.seconds_of(F.col("fastest_time")).alias("_s"))
    agrees = (F.col("total_laps") == F.col("_n")) & (F.col("fastest_lap") == F.col("_k")) & (F.abs(cut - F.col("_s")) < 1e-6)
    return found.join(stated, "path", "left").select("path", "total_laps", "fastest_lap", "fastest_s", agrees.alias("agrees"))



def session_report(durations: DataFrame, stated: DataFrame, tolerance: float = 1.0, key: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """Computed laps against a device's own (beacons or its lap summary): laps with their status, and a row a session.

    durations: laps.lap_durations; stated: (session, lap, duration). The session's row: numbers of matched, extra and missing
    laps, the computed and the stated best lap, and whether both lists agree (all laps matched and the best ones paired).
    """
    lined = laps.align_laps(durations.where("completed"), stated, tolerance, key)
    count = lambda kind: F.count_if(F.col("status") == kind).cast("int").alias(kind)
    told = lined.groupBy(key).agg(
        count("match"), count("extra"), count("missing"), F.min(F.struct(F.col("duration").isNull(), "duration", "lap")).alias("_c"),
        F.min(F.struct(F.col("stated_s").isNull(), "stated_s", "stated_lap")).alias("_s"), F.max(F.abs("diff")).alias("max_diff"))
    best = lined.where("status = 'match'").select(key, F.col("lap").alias("_lap"), F.col("stated_lap").alias("_stated"), F.lit(True).alias("_paired"))
    told = told.select(key, "match", "extra", "missing", F.col("_c.lap").alias("best_lap"), F.col("_c.duration").alias("best_s"), F.col("_s.stated_lap").alias("stated_best_lap"), F.col("_s.stated_s").alias("stated_best_s"), "max_diff")
    joined = told.join(best.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col("best_lap") == F.col("_lap")) & (F.col("stated_best_lap") == F.col("_stated")), "left")
    agrees = (F.col("extra") == 0) & (F.col("missing") == 0) & F.coalesce("_paired", F.lit(False))
    return lined, joined.withColumn("agrees", agrees).drop("_k", "_lap", "_stated", "_paired")
