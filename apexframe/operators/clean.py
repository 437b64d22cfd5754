"""Cleaning of raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drop_empty(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns without any value go, then rows without any value (columns in keep don't count)."""
    rest = [c for c in df.columns if c not in keep]
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in rest)).first() if rest else {}
    full = [c for c in rest if counts[c]]
    return df.select(*(f"`{c}`" for c in df.columns if c in keep or c in full)).dropna("all", subset=[f"`{c}`" for c in full] or None)


def strip_units_row(df: DataFrame, first: str, row_no: str = "seq", key: str = "session_id") -> DataFrame:
    """The first row of a session goes if its first cell is no number without points and hyphens."""
    n = F.row_number().over(W.partitionBy(key).orderBy(row_no))
    digits = F.regexp_replace(F.coalesce(F.col(first).cast("string"), F.lit("")), r"[.\-]", "")
    return df.withColumn("_n", n).where(~((F.col("_n") == 1) & ~digits.rlike(r"^\d+$"))).drop("_n")


def with_position(df: DataFrame, columns: tuple[str, ...] = ("t", "x", "y"), least: int = 2, key: str = "session_id") -> DataFrame:
    """Rows with all of columns, of sessions with `least` such rows or more."""
    rows = df.dropna(subset=list(columns))
    return rows.withColumn("_n", F.count("*").over(W.partitionBy(key))).where(F.col("_n") >= least).drop("_n")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def drop_standing(samples: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows at the same place as the row before go."""
    w = W.partitionBy(key).orderBy("t", "seq")
    same = (F.col("x") == F.lag("x").over(w)) & (F.col("y") == F.lag("y").over(w))
    return samples.withColumn("_same", F.coalesce(same, F.lit(False))).where("NOT _same").drop("_same")


def line_ends(points: DataFrame, key: str = "track_id", order: str = "pt_idx") -> DataFrame:
    """(track, x1, y1, x2, y2): first and last of a line's distinct points."""
    pts = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(order, "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    out = points.groupBy(key).agg(pts.alias("_p")).where(F.size("_p") >= 2)
    return out.select(key, F.element_at("_p", 1)["x"].alias("x1"), F.element_at("_p", 1)["y"].alias("y1"), F.element_at("_p", -1)["x"].alias("x2"), F.element_at("_p", -1)["y"].alias("y2"))


def gaps_as_null(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Positions written as 0, 0 are gaps."""
    gap = (lat == 0) & (lon == 0)
    return F.when(~gap, lat), F.when(~gap, lon)
