"""Track geometry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..session import ship
from .shapefile import ShapefileSource

SCHEMA = "track_id string, layer string, part_id int, pt_idx int, x double, y double, crs string"


def read_track_points(spark: SparkSession, paths: str, form: str = "csv") -> DataFrame:
    """track_points from CSV (with header), Parquet or a folder of shapefiles (form "shapefile")."""
    if form == "shapefile":
        ship(spark)  # the tasks import the data source
        spark.dataSource.register(ShapefileSource)
        return number_parts(spark.read.format("shapefile").load(paths))
    reader = spark.read.schema(SCHEMA)
    return reader.option("header", True).csv(paths) if form == "csv" else reader.parquet(paths)


def number_parts(points: DataFrame) -> DataFrame:
    """(track_id, layer, record, part, ...) to track_points: the parts of a layer count on through its records.

    Only the first point of each part passes the window.
    """
    key = ["track_id", "layer", "record", "part"]
    order = W.partitionBy("track_id", "layer").orderBy("record", "part")
    ids = points.where("pt_idx = 0").select(*key, (F.row_number().over(order) - 1).alias("part_id"))
    return points.join(ids, key).select("track_id", "layer", "part_id", "pt_idx", "x", "y", "crs")


def parse_linestrings(rows: DataFrame) -> DataFrame:
    """(track_id, layer, crs, wkt) with LINESTRING or MULTILINESTRING text to track_points."""
    parts = rows.select("track_id", "layer", "crs", F.posexplode(F.regexp_extract_all("wkt", F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("part_id", "part"))
    pts = parts.select("track_id", "layer", "crs", "part_id", F.posexplode(F.split("part", r"\s*,\s*")).alias("pt_idx", "p"))
    xy = F.split(F.trim("p"), r"\s+")
    return pts.select("track_id", "layer", "part_id", "pt_idx", xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"), "crs")


def to_mercator(points: DataFrame) -> DataFrame:
    """All points in Web Mercator metres; a missing crs is told by range per track and layer."""
    far = points.groupBy("track_id", "layer").agg(geo.looks_projected(F.max(F.abs("x")), F.max(F.abs("y"))).alias("_m"))
    rows = points.join(far, ["track_id", "layer"])
    degrees = F.when(F.col("crs").isNull(), ~F.col("_m")).otherwise(F.upper("crs").isin("WGS84", "EPSG:4326"))
    return rows.select("track_id", "layer", "part_id", "pt_idx", F.when(degrees, geo.mercator_x(F.col("x"))).otherwise(F.col("x")).alias("x"), F.when(degrees, geo.mercator_y(F.col("y"))).otherwise(F.col("y")).alias("y"), F.lit("EPSG:3857").alias("crs"))


def start_finish(points: DataFrame) -> DataFrame:
    """The first part of the start/finish layer."""
    line = points.where("layer = 'start-finish-line'")
    first = line.groupBy("track_id").agg(F.min("part_id").alias("part_id"))
    return line.join(first, ["track_id", "part_id"], "left_semi")
