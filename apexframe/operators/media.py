"""On-board clips: timestamps by vote, recordings, clock ticks, synchronisation with telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import group_name, noisy_timestamp


def _seconds(col: Column) -> Column:
    return F.make_dt_interval(secs=col.cast("decimal(18,6)"))


def _between(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def vote_timestamp(frames: DataFrame, key: str = "clip_id") -> DataFrame:
    """(clip, ts): frames (clip, frame_offset, ts) moved back by their offset; the commonest date, and of it the upper median.

    Ties of dates go to the one seen first.
    """
    rows = frames.where("ts IS NOT NULL").select(key, "frame_offset", (F.col("ts") - _seconds(F.col("frame_offset"))).alias("ts")).withColumn("_d", F.to_date("ts"))
    days = rows.groupBy(key, "_d").agg(F.count("*").alias("_n"), F.min("frame_offset").alias("_first"), F.sort_array(F.collect_list("ts")).alias("_all"))
    top = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_n"), "_first"))
    return days.withColumn("_r", top).where("_r = 1").select(key, F.element_at("_all", (F.size("_all") / 2).cast("int") + 1).alias("ts"))


def vote_text(frames: DataFrame, key: str = "clip_id") -> DataFrame:
    """As vote_timestamp, from recognised text."""
    return vote_timestamp(frames.select(key, "frame_offset", noisy_timestamp(F.col("text")).alias("ts")), key)


def fill_clip(clips: DataFrame) -> DataFrame:
    """A missing start or end from the other and the duration."""
    return clips.withColumns({
        "start_ts": F.coalesce("start_ts", F.col("end_ts") - _seconds(F.col("duration"))),
        "end_ts": F.coalesce("end_ts", F.col("start_ts") + _seconds(F.col("duration"))),
    })


def _with_year(stamp: Column, year: Column) -> Column:
    """stamp in another year; null where that year lacks the day."""
    return F.try_make_timestamp_ntz(year, F.month(stamp), F.dayofmonth(stamp), F.hour(stamp), F.minute(stamp), F.extract(F.lit("SECOND"), stamp))


def group_clips(clips: DataFrame, tolerance: float = 2.0, camera: str = "camera_id", order: str = "path") -> DataFrame:
    """Adds group_no, start_ts with a repaired year, and group_name: a clip joins the group before it if it starts less than
    `tolerance` seconds from that clip's end as it stands, else if it does so in the year of that end; only then its year (and
    that of its end_ts, if there is one) is repaired. Clips without a start stand alone.

    A repaired start decides on the next clip, so this is a fold over a camera's clips in order; a camera's clips (hundreds)
    are one row meanwhile.
    """
    others = [c for c in clips.columns if c not in (camera, order)]
    lists = clips.groupBy(camera).agg(F.sort_array(F.collect_list(F.struct(order, *others))).alias("_clips"))
    stamp = "timestamp_ntz"
    state = F.struct(F.lit(None).cast(stamp).alias("end"), F.array().cast(f"array<struct<new:int,start:{stamp},year:int>>").alias("out"))

    def step(acc: Column, clip: Column) -> Column:
        start, end = clip["start_ts"].cast(stamp), acc["end"]
        near = lambda s: F.coalesce(F.abs(_between(s, end)) < tolerance, F.lit(False))
        repaired = _with_year(start, F.year(end))
        repair = ~near(start) & near(repaired)
        new = F.when(near(start) | repair, 0).otherwise(1)
        kept = F.when(repair, repaired).otherwise(start)
        told = F.struct(new.alias("new"), kept.alias("start"), F.when(repair, F.year(end)).alias("year"))
        return F.struct((kept + _seconds(clip["duration"])).alias("end"), F.concat(acc["out"], F.array(told)).alias("out"))

    found = lists.select(camera, F.explode(F.arrays_zip(F.col("_clips").alias("clip"), F.aggregate("_clips", state, step)["out"].alias("told"))).alias("_z"))
    rows = found.select(camera, "_z.clip.*", F.col("_z.told").alias("_told")).withColumn("start_ts", F.col("_told.start"))
    if "end_ts" in clips.columns:
        rows = rows.withColumn("end_ts", F.coalesce(F.when(F.col("_told.year").isNotNull(), _with_year(F.col("end_ts"), F.col("_told.year"))), F.col("end_ts")))
    w = W.partitionBy(camera).orderBy(order, "start_ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("group_no", F.sum("_told.new").over(w).cast("int"))
    g = W.partitionBy(camera, "group_no").orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    stem = F.regexp_extract(F.first(order).over(g), r"([^/]*?)(?:\.[^./]*)?$", 1)
    return rows.withColumn("group_name", group_name(F.first("start_ts").over(g), stem)).select(*clips.columns, "group_no", "group_name")


def clock_ticks(frames: DataFrame, fps: float, key: str = "clip_id") -> DataFrame:
    """(clip, frame, clock_s, video_start_s): the first frame whose clock is one second (half a second either way) after
    the last accepted reading. Rejected readings don't become the last accepted one: a fold over each clip's readings.
    """
    rows = frames.where("clock_s IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("frame", "clock_s"))).alias("r"))
    none = F.struct(F.lit(None).cast("double").alias("last"), F.lit(None).cast("long").alias("frame"), F.lit(None).cast("double").alias("tick"))

    def step(acc, x):
        clock, frame = x["clock_s"].cast("double"), x["frame"].cast("long")
        changed = acc["last"].isNotNull() & (clock != acc["last"])
        ticked = changed & (F.abs(clock - acc["last"] - 1.0) <= 0.5)
        return F.when(acc["tick"].isNotNull(), acc).when(ticked, F.struct(clock.alias("last"), frame.alias("frame"), clock.alias("tick"))).when(
            changed, acc).otherwise(F.struct(clock.alias("last"), F.lit(None).cast("long").alias("frame"), F.lit(None).cast("double").alias("tick")))

    out = rows.select(key, F.aggregate("r", none, step).alias("a")).where("a.tick IS NOT NULL")
    return out.select(key, F.col("a.frame").alias("frame"), F.col("a.tick").alias("clock_s"), (F.col("a.tick") - F.col("a.frame") / F.lit(float(fps))).alias("video_start_s"))


def sync_shifts(marks: DataFrame, crossings: DataFrame, key: str = "session_id") -> DataFrame:
    """(session, clip, marks, shift_s, drift_s): mean and spread of telemetry time less video time; unknown laps drop out."""
    joined = marks.join(crossings.select(key, F.col("k").alias("lap_idx"), "t_cross"), [key, "lap_idx"])
    shift = F.col("t_cross") - F.col("video_time")
    return joined.groupBy(key, "clip_id").agg(F.count("*").alias("marks"), F.avg(shift).alias("shift_s"), (F.max(shift) - F.min(shift)).alias("drift_s"))


def use_shift(clips: DataFrame, saved: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Adds shift_s: given, else saved, else 0."""
    out = clips.join(given.select(*keys, F.col("shift_s").alias("_g")), keys, "left").join(saved.select(*keys, F.col("shift_s").alias("_s")), keys, "left")
    return out.withColumn("shift_s", F.coalesce("_g", "_s", F.lit(0.0))).drop("_g", "_s")


def clip_range(duration: Column, start: Column, requested: Column) -> Column:
    """Seconds of a clip to use: what is asked for, within what is left after start, at least 1."""
    return F.greatest(F.lit(1.0), F.least(requested, F.greatest(F.lit(0.0), duration - start)))


def overlap(t_min: Column, t_max: Column, shift: Column, duration: Column) -> tuple[Column, Column]:
    """Telemetry range on the clip's clock, cut to the clip; nulls if nothing is left."""
    start, end = F.greatest(F.lit(0.0), t_min - shift), F.least(duration, t_max - shift)
    return F.when(end > start, start), F.when(end > start, end)


def same_length(log_s: Column, clip_s: Column, tolerance: float = 1250.0) -> Column:
    """Quality flag: log and clip differ by no more than tolerance seconds."""
    return F.abs(log_s - clip_s) <= tolerance
