"""Conversion of all sessions below a folder to canonical samples, and the writers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import number
from ..operators import channels, timebase
from ..sources import logs

KEYS = ["session_id", "seq", "t"]


def snake(name: str) -> str:
    return "_".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


CANONICAL = [snake(name) for name, _, _ in channels.CHANNELS if name != "Time"]


def canonical(long: DataFrame, aliases: DataFrame) -> DataFrame:
    """Long raw samples to one row a sample: t, the dictionary's channels as doubles, everything else in `extra`."""
    named = channels.normalise_long(long, aliases)
    field = F.trim(F.regexp_replace(F.lower("name"), r"[^a-z0-9]+", " "))
    named = named.select("session_id", "seq", F.regexp_replace(field, " ", "_").alias("field"), number(F.col("value")).alias("v"))
    rows = named.groupBy("session_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("m"))
    known = ["time", *CANONICAL]
    extra = F.map_filter("m", lambda k, v: ~k.isin(*known) & v.isNotNull())
    return rows.select("session_id", "seq", F.col("m")["time"].alias("t"), *(F.col("m")[c].alias(c) for c in CANONICAL), extra.alias("extra"))


#: Samples a second that each layout is written with; None is the session's own rate.
RATES = {"aim": 20.0, "alfano": 10.0, "alfano_excel": None}


def of_sessions(rows: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """The rows of the given sessions; all without such a table."""
    return rows if sessions is None else rows.join(sessions.select("session_id"), "session_id", "left_semi")


def convert_aim(spark: SparkSession, paths: str | list[str], aliases: DataFrame, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    long, meta = logs.read_aim(spark, paths)
    long, meta = of_sessions(long, sessions), of_sessions(meta, sessions)
    return with_distance(canonical(long, aliases)), meta


def convert_lap_logs(spark: SparkSession, paths: str | list[str], aliases: DataFrame, rules: list[tuple], step: float = 0.1, sessions: DataFrame | None = None) -> DataFrame:
    """Device integers are scaled before distance is integrated."""
    wide = of_sessions(logs.read_lap_logs(spark, paths), sessions)
    wide = channels.rescale(wide, rules)
    wide = timebase.synthetic_clock(wide, ["file_lap", "row"], step).withColumn("seq", F.round(F.col("t") / step).cast("long"))
    raw = [c for c in wide.columns if c not in ("session_id", "file_lap", "row", "t", "seq")]
    cells = F.array(F.struct(F.lit("Time").alias("channel"), F.col("t").cast("string").alias("value")), *(F.struct(F.lit(c).alias("channel"), F.col(f"`{c}`").cast("string").alias("value")) for c in raw))
    long = wide.select("session_id", "seq", F.posexplode(cells).alias("col_idx", "c")).select("session_id", "seq", "col_idx", "c.channel", "c.value")
    return with_distance(canonical(long, aliases))


def convert_excel(spark: SparkSession, paths: str | list[str], aliases: DataFrame, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    long, clocks = logs.read_excel_export(spark, paths)
    long, clocks = of_sessions(long, sessions), of_sessions(clocks, sessions)
    rows = canonical(long, aliases)
    lap = F.coalesce(F.col("lap_number"), F.col("extra")["lap"]).cast("int")
    return with_distance(timebase.stitch_laps(rows.withColumn("lap", lap)).drop("lap")), clocks


def with_distance(samples: DataFrame) -> DataFrame:
    """A distance that a session has is carried forward; other sessions get it from their speed."""
    made = timebase.add_distance(samples.withColumn("_own", F.col("distance")).withColumn("_v", F.coalesce("gps_speed", "wheel_speed")), "_v")
    has = F.count("_own").over(W.partitionBy("session_id")) > 0
    own = F.coalesce(timebase.forward_fill(F.col("_own")), F.lit(0.0))
    return made.withColumn("distance", F.when(has, own).otherwise(F.col("distance"))).drop("_own", "_v")


#: The files of each layout, as a glob and as a pattern.
LAYOUTS = {"aim": ("aim.csv", r"/aim\.csv$"), "alfano": ("LAP_*.csv", r"/LAP_[^/]*\.csv$"), "alfano_excel": ("Excel_*.csv", r"/Excel_[^/]*\.csv$")}


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, session_id) of the files that lie directly in the folders of root."""
    scheme = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?|/+$"
    depth = re.sub(scheme, "", root).count("/")
    parts_of = F.length(F.regexp_replace(F.regexp_replace("path", scheme, ""), "[^/]", ""))
    return logs.list_files(spark, root).where(parts_of == depth + 2).withColumn("session_id", logs.folder_of(F.col("path")))


def convert_all(spark: SparkSession, root: str, aliases: DataFrame | None = None, transforms: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Samples of all session folders of root, with their device; with `changed` (session_id) only of those, and no file of
    another folder is read.

    A folder has one layout, the first that its files match (aim, alfano, alfano_excel); files of the other layouts in it are
    not read as samples. Folders below session folders don't count. A root without sessions gives no rows. Paths of changed
    folders go through the driver, as the paths of all files that Spark reads do.
    """
    aliases = channels.alias_table(spark) if aliases is None else aliases
    transforms = channels.transform_table(spark) if transforms is None else transforms
    files = session_files(spark, root)
    sessions = of_sessions(logs.classify_sessions(files), changed)
    found = {r["device"] for r in sessions.select("device").distinct().collect()}
    rules = [(r["raw"], r["scale"], r["offset"], r["auto_center"]) for r in transforms.where("device = 'alfano'").collect()]
    mine = lambda device: sessions.where(F.col("device") == device)

    def paths(device: str) -> str | list[str]:
        glob, pattern = LAYOUTS[device]
        if changed is None:
            return f"{root}/*/{glob}"
        own = of_sessions(files.where(F.col("path").rlike(pattern)), mine(device))
        return [re.sub(r"[\[\]{}*?\\]", r"\\\g<0>", r["path"]) for r in own.orderBy("path").select("path").collect()]

    parts = [canonical(spark.createDataFrame([], "session_id string, seq long, col_idx int, channel string, value string"), aliases).withColumn("device", F.lit(None).cast("string"))]
    if "aim" in found:
        parts.append(convert_aim(spark, paths("aim"), aliases, mine("aim"))[0].withColumn("device", F.lit("aim")))
    if "alfano" in found:
        parts.append(convert_lap_logs(spark, paths("alfano"), aliases, rules, sessions=mine("alfano")).withColumn("device", F.lit("alfano")))
    if "alfano_excel" in found:
        parts.append(convert_excel(spark, paths("alfano_excel"), aliases, mine("alfano_excel"))[0].withColumn("device", F.lit("alfano_excel")))
    out = parts[-1]
    for p in parts[:-1]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _digest(*columns: str):
    """Of a group's rows in any order; repeated rows count."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")


def _manifests(spark: SparkSession, out: str) -> list[int]:
    """Versions of the manifest that were written to their end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest/version=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(int(re.search(r"version=(\d+)/_SUCCESS$", f.getPath().toString())[1]) for f in found or [])


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    """(session_id, digest, run) of the converted sessions; no rows before the first conversion."""
    versions = _manifests(spark, out)
    schema = "session_id string, digest string, run string"
    return spark.read.schema(schema).parquet(f"{out}/manifest/version={versions[-1]}") if versions else spark.createDataFrame([], schema)


def convert_changed(spark: SparkSession, root: str, out: str, aliases: DataFrame | None = None, transforms: DataFrame | None = None) -> DataFrame:
    """Convert the session folders of root that are new or changed since the last conversion to `out`; their session_ids.

    A folder is changed if names, lengths or times of its files, or the aliases or transforms, differ from those it was
    converted with. Sessions whose folders are gone leave the output. The samples of a run go to a folder of their own; the
    manifest, written last, says which run holds a session. So a run that dies leaves the earlier output as it was, readers
    never see half a run, and a second run at the same time fails at the manifest. Run folders that the manifest doesn't name
    can be deleted.
    """
    aliases = channels.alias_table(spark) if aliases is None else aliases
    transforms = channels.transform_table(spark) if transforms is None else transforms
    rules = "-".join(str(t.agg(_digest(*t.columns)).first()[0]) for t in (aliases, transforms))
    files = session_files(spark, root)
    found = of_sessions(files, logs.classify_sessions(files)).groupBy("session_id").agg(F.concat_ws("-", _digest("path", "length", "modified"), F.lit(rules)).alias("digest"))
    known = read_manifest(spark, out)
    versions, run = _manifests(spark, out), f"r{uuid.uuid4().hex}"
    state = known.withColumnRenamed("digest", "_old").join(found, "session_id", "full_outer").select(
        "session_id", "digest", F.when(F.col("digest").eqNullSafe(F.col("_old")), F.col("run")).otherwise(F.lit(run)).alias("run"), F.col("_old").isNotNull().alias("was"))
    # written once, so that conversion and manifest agree on what the folders held
    state.write.parquet(f"{out}/runs/state={run}")
    state = spark.read.schema(state.schema).parquet(f"{out}/runs/state={run}")
    changed = state.where((F.col("run") == run) & F.col("digest").isNotNull()).select("session_id")
    fresh, gone = changed.count(), state.where("digest IS NULL").count()
    if fresh:
        samples = convert_all(spark, root, aliases, transforms, changed)
        samples.repartition("session_id").sortWithinPartitions("session_id", "t").write.parquet(f"{out}/samples/run={run}")
    if fresh or gone or not versions:
        manifest = state.where("digest IS NOT NULL").select("session_id", "digest", "run")
        manifest.write.parquet(f"{out}/manifest/version={versions[-1] + 1 if versions else 1}")
    return changed


def read_converted(spark: SparkSession, out: str) -> DataFrame:
    """Samples of all sessions, each from the run that converted it last; none before the first conversion."""
    manifest = read_manifest(spark, out).select("session_id", "run")
    runs = [r["run"] for r in manifest.select("run").distinct().collect()]  # one for each rerun that still counts
    if not runs:
        return canonical(spark.createDataFrame([], "session_id string, seq long, col_idx int, channel string, value string"), channels.alias_table(spark)).withColumn("device", F.lit(None).cast("string"))
    samples = spark.read.option("basePath", f"{out}/samples").option("mergeSchema", "true").parquet(*(f"{out}/samples/run={r}" for r in runs))
    return samples.withColumn("run", F.col("run").cast("string")).join(manifest, ["session_id", "run"], "left_semi").drop("run")


def at_fixed_rates(samples: DataFrame, columns: list[str], rates: dict[str, float | None] = RATES) -> DataFrame:
    """Samples of convert_all on the grid of their layout's rate (of their own, as infer_frequency has it, where that is None),
    with `hz`."""
    hz = F.lit(None).cast("double")
    for device, rate in rates.items():
        hz = F.when(F.col("device") == device, F.lit(rate).cast("double")).otherwise(hz)
    devices = samples.groupBy("session_id").agg(F.first("device").alias("device")).withColumn("hz", hz)
    own = timebase.infer_frequency(samples)
    devices = devices.join(own, "session_id").select("session_id", "device", F.coalesce("hz", "freq_hz").alias("hz"))
    return timebase.resample(samples, columns, rates=devices.select("session_id", "hz")).join(devices, "session_id").drop("video_time")


def write_csv(samples: DataFrame, path: str) -> None:
    """One folder a session, time and distance first, sorted by time; sessions written again replace their folders."""
    rest = [c for c in samples.columns if c not in ("session_id", "t", "distance", "extra")]
    rows = samples.select("session_id", "t", "distance", *rest).repartition("session_id").sortWithinPartitions("session_id", "t")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("session_id").csv(path)


def write_fixed_rate(samples: DataFrame, sessions: DataFrame, hz: float, path: str, columns: list[str]) -> None:
    """Samples on a grid of hz with the sessions' labels, one Parquet folder a session; rerun sessions are replaced."""
    grid = timebase.resample(samples, columns, hz).drop("video_time")
    rows = grid.join(F.broadcast(sessions.limit(100_000)) if sessions.limit(100_001).count() <= 100_000 else sessions, "session_id", "left")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def save_shifts(shifts: DataFrame, path: str) -> None:
    """Time shifts by session; sessions written again replace theirs."""
    shifts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)
