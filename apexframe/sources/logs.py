"""Readers of logger exports. Each reads any number of session folders at once; a folder's name is its session_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.values import number, rate
from ..session import kept

MEDIA_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "m4v")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def plain_path(address: Column) -> Column:
    """A file's path as list_files has it, from an address in which blanks and other characters are escaped."""
    return F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of all files below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def classify_sessions(files: DataFrame) -> DataFrame:
    """(session_id, device): aim before alfano before alfano_excel, by the files in each folder."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    has = files.groupBy(folder_of(F.col("path")).alias("session_id")).agg(
        F.bool_or(name == "aim.csv").alias("aim"), F.bool_or(name.rlike(r"^LAP_.*\.csv$")).alias("lap"), F.bool_or(name.rlike(r"^Excel_.*\.csv$")).alias("excel"))
    device = F.when(F.col("aim"), "aim").when(F.col("lap"), "alfano").when(F.col("excel"), "alfano_excel")
    return has.select("session_id", device.alias("device")).where("device IS NOT NULL")


def media_files(files: DataFrame, extensions: tuple[str, ...] = MEDIA_EXTENSIONS) -> DataFrame:
    """Clips among files: extension compared without case, one row a path, sorted."""
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).dropDuplicates(["path"]).orderBy("path")


def media_properties(probes: DataFrame) -> DataFrame:
    """(path, json of a probe) to (path, width, height, fps, duration)."""
    schema = "struct<streams: array<struct<codec_type: string, width: int, height: int, r_frame_rate: string>>, format: struct<duration: string>>"
    p = probes.withColumn("_p", F.from_json("json", schema)).withColumn("_v", F.get(F.filter("_p.streams", lambda s: F.coalesce(s["codec_type"], F.lit("video")) == "video"), F.lit(0)))
    return p.select("path", F.col("_v.width").alias("width"), F.col("_v.height").alias("height"), rate(F.col("_v.r_frame_rate")).alias("fps"), F.coalesce(number(F.col("_p.format.duration")), F.lit(0.0)).alias("duration"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(session_id, path, line_no from 0, line) of text files of any size, which many tasks read by blocks.

    A task reads the rows of a block in order, so a row's place in its block is its id less the block's first id. Line counts
    of blocks, a row a block, are summed up to where each block begins. Lines end at line feeds; carriage returns go.
    Files are listed and read once, when this is called: lines are kept as Parquet, as readers go over them many times.
    """
    raw = spark.read.text(paths, lineSep="\n", recursiveFileLookup=True)
    raw = raw.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), "value")
    raw = kept(raw, "lines")
    blocks = raw.groupBy("path", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return raw.join(blocks, ["path", "block"]).select(
        folder_of(F.col("path")).alias("session_id"), "path", (F.col("_id") + F.col("_shift")).alias("line_no"), F.regexp_replace("value", "\r", "").alias("line"))


def _cells(line: Column, sep: str = ",") -> Column:
    """Cells of a CSV line, quotes removed."""
    cell = rf'(?:^|{sep})(?:"([^"]*)"|([^{sep}]*))'
    quoted, bare = F.regexp_extract_all(line, F.lit(cell), F.lit(1)), F.regexp_extract_all(line, F.lit(cell), F.lit(2))
    return F.zip_with(quoted, bare, lambda q, b: F.trim(F.when(q != "", q).otherwise(b)))


def read_aim(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Samples in long form (session_id, seq, col_idx, channel, value) and metadata (session_id, meta map).

    The header is the first line that starts with Time and names GPS; a units row below it goes; metadata are the lines up
    to the first blank one or the header, without Format. Files without a header have no samples.
    """
    lines = numbered_lines(spark, paths)
    is_header = F.ltrim(F.regexp_replace(F.trim("line"), '^"', "")).startswith("Time") & F.col("line").contains("GPS")
    marks = lines.groupBy("path").agg(
        F.min(F.when(is_header, F.struct("line_no", "line"))).alias("_h"), F.min(F.when(F.trim("line") == "", F.col("line_no"))).alias("blank_no"))
    marks = marks.select("path", F.col("_h.line_no").alias("header_no"), _cells(F.col("_h.line")).alias("names"), F.least("_h.line_no", "blank_no").alias("meta_end"))
    lines = lines.join(marks, "path")
    info = lines.where("meta_end IS NULL OR line_no < meta_end").select("session_id", _cells(F.col("line")).alias("c")).where("c[0] <> '' AND c[0] <> 'Format'")
    info = info.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c")[0], F.array_join(F.slice("c", F.lit(2), F.lit(1 << 20)), ",")))).alias("meta"))
    body = lines.where((F.col("line_no") > F.col("header_no")) & (F.trim("line") != "")).select("session_id", "names", "line_no", "header_no", _cells(F.col("line")).alias("cells"))
    digits = F.regexp_replace(F.col("cells")[0], r"[.\-]", "")
    body = body.where(~((F.col("line_no") == F.col("header_no") + 1) & ~digits.rlike(r"^\d+$")))
    rows = body.select("session_id", (F.col("line_no") - F.col("header_no")).cast("long").alias("seq"), F.posexplode(F.arrays_zip("names", "cells")).alias("col_idx", "c"))
    return rows.select("session_id", "seq", "col_idx", F.col("c.names").alias("channel"), F.col("c.cells").alias("value")), info


def read_lap_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Wide samples of LAP_* files (all text) with session_id, file_lap and row; laps order by number.

    Every file has its own header: columns are matched by name, and those that a file lacks are null there.
    """
    lines = numbered_lines(spark, paths)
    header = lines.where("line_no = 0").select("path", _cells(F.col("line")).alias("names"))
    places = header.select(F.posexplode("names").alias("place", "name")).where("name <> ''").groupBy("name").agg(F.min("place").alias("place"))
    names = [r["name"] for r in places.orderBy("place", "name").collect()]  # as many as devices have channels
    rows = lines.where("line_no > 0 AND trim(line) <> ''").select("session_id", "path", F.col("line_no").cast("int").alias("row"), _cells(F.col("line")).alias("cells")).join(header, "path")
    at = lambda n: F.array_position("names", F.lit(n)).cast("int")
    columns = [F.nullif(F.get("cells", at(n) - 1), F.lit("")).alias(n) for n in names]
    return rows.select(*columns, "session_id", F.regexp_extract("path", r"LAP_(\d+)_[^/]*$", 1).try_cast("int").alias("file_lap"), "row")


def read_excel_export(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Samples in long form of the first Excel_* file of each folder, and (session_id, utc_clock) from its first line."""
    lines = numbered_lines(spark, paths)
    first = lines.groupBy("session_id").agg(F.min("path").alias("_p"))
    lines = lines.join(first, "session_id").where("path = _p").drop("_p")
    top = lines.where("line_no = 0").select("session_id", F.transform(F.split("line", ";"), clock.clean_header).alias("names"), F.get(F.filter(F.split("line", ";"), lambda c: c.contains("UTC")), F.lit(0)).alias("utc"))
    clocks = top.select("session_id", clock.utc_clock(F.regexp_extract("utc", r"([^:]*)$", 1)).alias("utc_clock"))
    body = lines.where((F.col("line_no") > 0) & (F.regexp_replace("line", r"[;\s]", "") != "")).join(top.select("session_id", "names"), "session_id")
    rows = body.select("session_id", F.col("line_no").cast("long").alias("seq"), F.posexplode(F.arrays_zip("names", F.transform(F.split("line", ";"), lambda x: F.trim(x)).alias("cells"))).alias("col_idx", "c"))
    rows = rows.select("session_id", "seq", "col_idx", F.col("c.names").alias("channel"), F.nullif(F.col("c.cells"), F.lit("")).alias("value"))
    full = rows.groupBy("session_id", "col_idx").agg(F.count("value").alias("_n")).where("_n > 0").drop("_n")
    return rows.join(full, ["session_id", "col_idx"], "left_semi"), clocks


def read_beacons(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """Beacons (path, k, t_cross in seconds) and stated details (path, total_laps, fastest_time, fastest_lap) of XML files."""
    source = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(paths).select("*", F.col("_metadata.file_path").alias("path"))
    marks = source("Marker", "_Name string, _Time double")
    beacons = marks.select("path", F.row_number().over(W.partitionBy("path").orderBy("_Time")).alias("k"), (F.col("_Time") / 1e6).alias("t_cross"))
    details = source("Details", "String array<struct<_Id: string, _Value: string>>").select("path", F.map_from_entries(F.transform("String", lambda s: F.struct(s["_Id"], s["_Value"]))).alias("d"))
    return beacons, details.select("path", F.col("d")["Total Laps"].cast("int").alias("total_laps"), F.col("d")["Fastest Time"].alias("fastest_time"), F.col("d")["Fastest Lap"].cast("int").alias("fastest_lap"))


def read_lap_summary(spark: SparkSession, paths: str) -> DataFrame:
    """(session_id, lap, time_s, min/max rpm, min/max speed km/h) of device lap summaries (line 1 metadata, line 2 names)."""
    c = _cells(F.col("line"))
    rows = numbered_lines(spark, paths).where("line_no >= 2 AND trim(line) <> ''").select("session_id", c.alias("c"))
    v = lambda i: number(F.get("c", F.lit(i)))
    return rows.select("session_id", v(0).cast("int").alias("lap"), (v(1) / 1000).alias("time_s"), v(8).alias("min_rpm"), v(9).alias("max_rpm"), (v(10) / 10).alias("min_speed"), (v(11) / 10).alias("max_speed"))


def session_metadata(sessions: DataFrame) -> DataFrame:
    """Fills driver, venue, vehicle, session, event_date, event_time by precedence: header, then folder, then file tokens.

    sessions: session_id, device, meta map, file_name, utc_clock.
    """
    folder, file = clock.name_tokens(F.col("session_id")), clock.name_tokens(F.coalesce("file_name", F.lit("")))
    at = lambda i: F.coalesce(F.get(folder, i if isinstance(i, Column) else F.lit(i)), F.lit(""))
    end = lambda i: at(F.size(folder) - i)
    aim = F.col("device") == "aim"
    meta = lambda k: F.coalesce(F.col("meta")[k], F.lit(""))
    export = F.col("device") == "alfano_excel"  # only there file names count
    dates = [F.when(export, clock.first_decoded(file, clock.compact_date)), clock.first_decoded(folder, clock.compact_date)]
    times = [F.when(export, clock.first_decoded(file, clock.time_token)), clock.first_decoded(folder, clock.time_token)]
    return sessions.select(
        "session_id", "device",
        clock.first_filled(F.when(aim, meta("Racer")), F.when(aim, at(5)).otherwise(end(2))).alias("driver"),
        clock.first_filled(F.when(aim, at(3)).otherwise(end(1))).alias("venue"),
        clock.first_filled(F.when(aim, meta("Vehicle")), F.when(aim, at(4))).alias("vehicle"),
        clock.first_filled(F.when(aim, meta("Session")), F.when(aim, end(1))).alias("session"),
        clock.first_filled(F.when(aim, clock.header_date(meta("Date"))), *dates).alias("event_date"),
        clock.first_filled(F.when(aim, clock.header_time(meta("Time"))), F.col("utc_clock"), *times).alias("event_time"),
        "meta")
