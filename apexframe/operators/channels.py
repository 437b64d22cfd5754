"""Channel names, units and device scales."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import number

#: Standard channel, unit, raw names that loggers give it.
CHANNELS = [
    ("Time", "s", ["Time"]),
    ("GPS Speed", "km/h", ["GPS Speed", "Speed GPS"]),
    ("Wheel Speed", "km/h", ["Speed rear"]),
    ("RPM", "rpm", ["RPM"]),
    ("GPS Latitude", "deg", ["GPS Latitude", "Lat."]),
    ("GPS Longitude", "deg", ["GPS Longitude", "Lon."]),
    ("Altitude", "m", ["GPS Altitude", "Altitude"]),
    ("GPS Accel Lat", "g", ["GPS LatAcc", "Gf. X"]),
    ("GPS Accel Long", "g", ["GPS LonAcc", "Gf. Y"]),
    ("IMU Accel Long", "g", ["InlineAcc", "AccelerometerX"]),
    ("IMU Accel Lat", "g", ["LateralAcc", "AccelerometerY"]),
    ("IMU Accel Vert", "g", ["VerticalAcc", "AccelerometerZ"]),
    ("Accel Lat Smoothed", "g", ["G Lat Smth"]),
    ("Accel Long Smoothed", "g", ["G Long Smth"]),
    ("IMU Accel Lat Filtered", "g", ["G Lat imu f"]),
    ("IMU Accel Long Filtered", "g", ["G Long imu f"]),
    ("GyroX", "deg/s", ["GyroX"]),
    ("GyroY", "deg/s", ["GyroY"]),
    ("GyroZ", "deg/s", ["GyroZ", "GPS Gyro"]),
    ("Heading", "deg", ["GPS Heading", "Orientation"]),
    ("Slope", "deg", ["GPS Slope"]),
    ("GPS Nsat", "", ["GPS Nsat"]),
    ("GPS PosAccuracy", "mm", ["GPS PosAccuracy"]),
    ("GPS SpdAccuracy", "km/h", ["GPS SpdAccuracy"]),
    ("GPS Radius", "m", ["GPS Radius"]),
    ("Accel Sum", "g", ["G sum smth"]),
    ("Temperature", "°C", ["Logger Temperature", "T1", "T2"]),
    ("Battery Voltage", "V", ["Int Batt Voltage"]),
    ("Distance", "m", ["Distance on GPS Speed", "Distance"]),
    ("Lap Number", "", ["Partiel"]),
]

#: Device, raw channel, scale, offset, whether the session's mean is taken off.
TRANSFORMS = [
    ("alfano", "Speed GPS", 0.1, 0.0, False),
    ("alfano", "Speed rear", 0.1, 0.0, False),
    ("alfano", "Altitude", 0.1, 0.0, False),
    ("alfano", "Lat.", 0.000001, 0.0, False),
    ("alfano", "Lon.", 0.000001, 0.0, False),
    ("alfano", "Gf. X", 0.01, -10.0, True),
    ("alfano", "Gf. Y", -0.01, 10.0, True),
    ("alfano", "Orientation", 0.01, 0.0, False),
]


def alias_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(raw_lower, standard_name, unit); from a user's JSON mapping (standard_channels) where path is given.

    One row an alias, without case: where a mapping names an alias more than once, its last place counts.
    """
    if path is None:
        rows = [(a.lower(), name, unit) for name, unit, aliases in CHANNELS for a in aliases]
        return spark.createDataFrame(rows, "raw_lower string, standard_name string, unit string").dropDuplicates(["raw_lower"])
    doc = spark.read.text(path, wholetext=True)
    channels = F.from_json(F.get_json_object("value", "$.standard_channels"), "map<string, struct<standard_name: string, unit: string, aliases: array<string>>>")
    one = doc.select(F.posexplode(F.map_entries(channels)).alias("place", "e")).select("place", "e.value.*")
    rows = one.select("place", F.explode("aliases").alias("raw"), "standard_name", F.coalesce("unit", F.lit("")).alias("unit")).where("raw IS NOT NULL")
    last = F.max_by(F.struct("standard_name", "unit"), "place").alias("s")
    return rows.groupBy(F.lower("raw").alias("raw_lower")).agg(last).select("raw_lower", "s.*")


def transform_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(device, raw, scale, offset, auto_center); from a user's JSON mapping (transformations) where path is given."""
    schema = "device string, raw string, scale double, offset double, auto_center boolean"
    if path is None:
        return spark.createDataFrame(TRANSFORMS, schema)
    text = spark.read.text(path, wholetext=True).first()[0]
    found = json.loads(text).get("transformations", {})
    rows = [(d, c, float(v.get("scale", 1)), float(v.get("offset", 0)), bool(v.get("auto_center", False))) for d, cs in found.items() if isinstance(cs, dict) for c, v in cs.items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, schema)


def list_channels(aliases: DataFrame) -> DataFrame:
    """(standard_name, unit, aliases) sorted by name."""
    return aliases.groupBy("standard_name", "unit").agg(F.concat_ws(", ", F.sort_array(F.collect_list("raw_lower"))).alias("aliases")).orderBy("standard_name")


def normalise_long(raw: DataFrame, aliases: DataFrame, key: str = "session_id") -> DataFrame:
    """(session, seq, col_idx, channel, value) with standard name, unit and ordinal suffix.

    The suffix of a name that several raw columns share goes by column order; it is found on the columns of each session,
    not on its samples. Unknown channels keep their name, unit empty.
    """
    columns = raw.select(key, "col_idx", "channel").distinct()
    named = columns.join(aliases, F.lower("channel") == F.col("raw_lower"), "left")
    named = named.select(key, "col_idx", "channel", F.coalesce("standard_name", "channel").alias("name"), F.coalesce("unit", F.lit("")).alias("unit"))
    nth = F.row_number().over(W.partitionBy(key, "name").orderBy("col_idx"))
    named = named.withColumn("_n", nth).withColumn("name", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("_n").cast("string")))).drop("_n")
    return raw.join(named.drop("channel"), [key, "col_idx"])


def rename_columns(df: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """Wide form: raw column names to standard ones by (raw_lower, standard_name), repeated names numbered in column order."""
    known, seen, out = dict(aliases), {}, []
    for c in df.columns:
        name = known.get(c.lower(), c)
        seen[name] = seen.get(name, 0) + 1
        out.append(F.col(f"`{c}`").alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return df.select(out)


def rescale(df: DataFrame, rules: list[tuple[str, float, float, bool]], key: str = "session_id") -> DataFrame:
    """value * scale + offset for each rule (column, scale, offset, centre); missing values count as 0 before scaling."""
    whole = W.partitionBy(key)
    for column, scale, offset, centre in rules:
        if column in df.columns:
            value = F.coalesce(number(F.col(f"`{column}`")), F.lit(0.0)) * scale + offset
            df = df.withColumn(column, value - F.avg(value).over(whole) if centre else value)
    return df
