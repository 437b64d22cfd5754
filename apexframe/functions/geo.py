"""Plane geometry and projections as Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * EARTH


def longitude(x: Column) -> Column:
    return F.degrees(x / EARTH)


def latitude(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / EARTH)) * 2 - math.pi / 2)


def looks_projected(max_abs_x: Column, max_abs_y: Column) -> Column:
    """True if coordinates cannot be degrees."""
    return (max_abs_x > 180) | (max_abs_y > 90)


def heading(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def wrap_angle(a: Column) -> Column:
    """Into [-180, 180]; +180 stays."""
    return F.when((a >= -180) & (a <= 180), a).otherwise(F.pmod(a + 180, F.lit(360.0)) - 180)


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def line_side(x: Column, y: Column, line: tuple[float, float, float, float]) -> Column:
    """Cross product with the line: its sign is the side, its size over the line's length the distance."""
    x1, y1, x2, y2 = line
    return cross(x - x1, y - y1, F.lit(x2 - x1), F.lit(y2 - y1))


def line_distance(x: Column, y: Column, line: tuple[float, float, float, float]) -> Column:
    x1, y1, x2, y2 = line
    return F.abs(line_side(x, y, line)) / math.hypot(x2 - x1, y2 - y1)


def step_crossing(x: Column, y: Column, x2: Column, y2: Column, line: tuple[float, float, float, float]) -> Column:
    """Share of the step at which it crosses the segment `line`, in [0, 1); null if it doesn't or is parallel."""
    ax, ay, bx, by = line
    dx, dy = x2 - x, y2 - y
    sx, sy = F.lit(bx - ax), F.lit(by - ay)
    denominator = cross(dx, dy, sx, sy)
    t = F.try_divide(cross(F.lit(ax) - x, F.lit(ay) - y, sx, sy), denominator)
    u = F.try_divide(cross(F.lit(ax) - x, F.lit(ay) - y, dx, dy), denominator)
    parallel = F.abs(denominator) <= F.hypot(dx, dy) * math.hypot(bx - ax, by - ay) * 1e-12
    return F.when(~parallel & (t >= 0) & (t < 1) & (u >= 0) & (u <= 1), t)


def unit_x(x: Column, low: Column, high: Column, clip: bool = False) -> Column:
    """Into [0, 1] over a span of at least 1."""
    out = (x - low) / F.greatest(high - low, F.lit(1.0))
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)) if clip else out


def unit_y(y: Column, low: Column, high: Column, clip: bool = False) -> Column:
    """As unit_x, upside down."""
    return 1 - unit_x(y, low, high, clip)


def fit_to_canvas(x: Column, y: Column, bounds: tuple[Column, Column, Column, Column], width: float, height: float, margin: float = 0.0) -> tuple[Column, Column]:
    """Uniform scale into a canvas, centred, y down. bounds: min x, min y, max x, max y."""
    x0, y0, x1, y1 = bounds
    scale = F.least((width - 2 * margin) / F.greatest(x1 - x0, F.lit(1e-9)), (height - 2 * margin) / F.greatest(y1 - y0, F.lit(1e-9)))
    return (x - (x0 + x1) / 2) * scale + width / 2, height / 2 - (y - (y0 + y1) / 2) * scale
