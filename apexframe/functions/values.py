"""Numeric column helpers: coercing casts, first available channel, indicators, gauges, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def number(col: Column) -> Column:
    """Text to double; anything that is not a plain decimal number, and NaN, becomes null."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def no_nan(col: Column) -> Column:
    """NaN as null, as missing samples are kept."""
    return F.nanvl(col, F.lit(None).cast("double"))


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that df has, compared without case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def first_value(df: DataFrame, candidates: list[str]) -> Column:
    """Row by row the first candidate channel with a value; null if df has none of them."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[c.lower()]}`") for c in candidates if c.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def clamp(col: Column, low, high) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def gauge_ratio(value: Column, full: Column) -> Column:
    """Share of the full scale, within 0 and 1; 0 without a scale or value."""
    return F.coalesce(F.when(full > 0, clamp(value / full, 0.0, 1.0)), F.lit(0.0))


def gauge_zone(ratio: Column) -> Column:
    return F.when(ratio > 0.9, "red").when(ratio > 0.75, "amber").otherwise("normal")


def rate(text: Column, default: float = 30.0) -> Column:
    """Frames per second from `num/den` or a number; the default where it is missing, zero or no number."""
    parts = F.split(text, "/")
    value = F.when(F.size(parts) == 2, F.try_divide(number(parts[0]), number(parts[1]))).otherwise(number(text))
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(default))


#: Thresholds of the indicator channels, in g.
BRAKING, CORNERING, THROTTLE = -0.15, 0.2, 0.05

INDICATORS = {
    "brk_ind": f"int(gps_accel_long <= {BRAKING})",
    "crn_ind": f"int(abs(gps_accel_lat) >= {CORNERING})",
    "tps_ind": f"int(gps_accel_long >= {THROTTLE})",
    "cst_ind": "int(brk_ind = 0 AND tps_ind = 0 AND crn_ind = 0)",
}


def math_channels(df: DataFrame, expressions: dict[str, str], constants: dict[str, float] | None = None) -> DataFrame:
    """User-defined channels in order: Spark SQL expressions over channels, earlier ones among them, and constants."""
    for name, value in (constants or {}).items():
        df = df.withColumn(name, F.lit(value))
    for name, sql in expressions.items():
        df = df.withColumn(name, F.expr(sql))
    return df.drop(*(constants or {}))
