"""Track geometry: lengths, bounds, curvature, turns and straights, projection and nearest segments. Keyed by track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..session import kept

TRACK, POINT = "track_id", "pt_idx"
#: A side of a join is sent to all executors only up to this many rows; beyond, both sides are sorted by the key.
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if df is within the bound, checked by counting no further than it; else a hint for a merge join.

    Without the second one Spark may still send df through the driver: it judges kept files by their compressed size, and
    an index of millions of cells is a file of a few MB.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def track_pieces(points: DataFrame) -> DataFrame:
    """Points to pieces between neighbours: (track, seg_idx, x0, y0, dx, dy, len, cum_dist)."""
    w = W.partitionBy(TRACK).orderBy(POINT)
    rows = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND abs(x) < double('infinity') AND abs(y) < double('infinity')")
    rows = rows.select(TRACK, F.row_number().over(w).alias("seg_idx"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.lead("x").over(w) - F.col("x")).alias("dx"), (F.lead("y").over(w) - F.col("y")).alias("dy"))
    rows = rows.where("dx IS NOT NULL").withColumn("len", F.hypot("dx", "dy"))
    ahead = W.partitionBy(TRACK).orderBy("seg_idx").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("cum_dist", F.coalesce(F.sum("len").over(ahead), F.lit(0.0)))


def track_length(points: DataFrame) -> DataFrame:
    return track_pieces(points).groupBy(TRACK).agg(F.sum("len").alias("length"))


def track_bounds(points: DataFrame) -> DataFrame:
    """(track, min_x, min_y, max_x, max_y, projected)."""
    out = points.groupBy(TRACK).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    far = lambda a, b: F.greatest(F.abs(a), F.abs(b))
    return out.withColumn("projected", geo.looks_projected(far("min_x", "max_x"), far("min_y", "max_y")))


def turns_and_straights(points: DataFrame, threshold: float = 0.8, half_window: int = 12, min_points: int = 10) -> DataFrame:
    """Points with segment number and kind: turns where the smoothed change of heading per point exceeds threshold degrees.

    Runs of fewer than min_points points join the run before; neighbours of one kind are one segment.
    """
    w = W.partitionBy(TRACK).orderBy(POINT)
    rows = points.select(TRACK, POINT, "x", "y", F.lead("x").over(w).alias("_x2"), F.lead("y").over(w).alias("_y2"))
    rows = rows.withColumn("heading", F.when(F.col("_x2").isNotNull(), geo.heading(F.col("_x2") - F.col("x"), F.col("_y2") - F.col("y"))))
    turn = F.abs(geo.wrap_angle(F.col("heading") - F.lag("heading").over(w)))
    rows = rows.withColumn("curvature", F.coalesce(turn, F.lit(0.0)))
    smooth = F.avg("curvature").over(w.rowsBetween(-half_window, half_window))
    last = F.col("_x2").isNull()
    rows = rows.withColumn("_kind", F.when(smooth > threshold, "turn").otherwise("straight"))
    rows = rows.withColumn("_kind", F.when(last, F.coalesce(F.lag("_kind").over(w), F.col("_kind"))).otherwise(F.col("_kind")))

    def runs(df: DataFrame, kind: str, run: str) -> DataFrame:
        changed = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1))
        return df.withColumn("_new", changed).withColumn(run, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")

    rows = runs(rows, "_kind", "_run")
    rows = rows.withColumn("_n", F.count("*").over(W.partitionBy(TRACK, "_run")))
    kept = F.when((F.col("_run") == 1) | (F.col("_n") >= min_points), F.col("_kind"))
    rows = rows.withColumn("kind", F.last(kept, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs(rows, "kind", "segment").select(TRACK, POINT, "x", "y", "heading", "curvature", "kind", "segment")


def segments(classed: DataFrame) -> DataFrame:
    """(track, segment, kind, points, label, mid_x, mid_y): label T or S and the number; the middle is its middle point."""
    pts = F.sort_array(F.collect_list(F.struct(POINT, "x", "y")))
    out = classed.groupBy(TRACK, "segment").agg(F.first("kind").alias("kind"), F.count("*").alias("points"), pts.alias("_p"))
    mid = F.element_at("_p", (F.size("_p") / 2).cast("int") + 1)
    label = F.concat(F.when(F.col("kind") == "turn", "T").otherwise("S"), F.col("segment").cast("string"))
    return out.select(TRACK, "segment", "kind", "points", label.alias("label"), mid["x"].alias("mid_x"), mid["y"].alias("mid_y"))


#: Samples meet all pieces of their track where no track has more than so many and BROADCAST_ROWS holds all; beyond, only those that a grid finds near.
DIRECT_PIECES = 256
#: Grids have 2^level cells a side, at most this level; a piece is kept in about so many cells at the finest at most.
MAX_LEVEL, CELLS_PER_PIECE = 14, 8
#: A place looks at most about so many cells far along the longer side of what its bound reaches.
CELLS_LONG = 16
_CELL = ("_level", "_cx", "_cy")


def _grids(side: DataFrame) -> DataFrame:
    """(track, _gx, _gy, _x1, _y1, _gs, _gl): bounds of each track's pieces, side and finest level of a square grid from the lower corner.

    The finest cells are about as many as the pieces on a side of their square, but not much finer than the pieces are long.
    """
    x1, y1 = F.col("x0") + F.col("dx"), F.col("y0") + F.col("dy")
    g = side.groupBy(TRACK).agg(
        F.min(F.least("x0", x1)).alias("_gx"), F.min(F.least("y0", y1)).alias("_gy"), F.max(F.greatest("x0", x1)).alias("_x1"), F.max(F.greatest("y0", y1)).alias("_y1"),
        F.count("*").alias("_n"), F.avg(F.hypot("dx", "dy")).alias("_len"))
    wide = F.greatest(F.col("_x1") - F.col("_gx"), F.col("_y1") - F.col("_gy"))
    level = F.least(F.log2(2 * F.sqrt("_n")), F.log2(F.try_divide(CELLS_PER_PIECE * F.col("_gs"), F.col("_len"))), F.lit(float(MAX_LEVEL)))
    return g.withColumn("_gs", F.when(wide > 0, wide * (1 + 1e-9)).otherwise(1.0)).select(TRACK, "_gx", "_gy", "_x1", "_y1", "_gs", F.greatest(F.lit(0), F.ceil(level).cast("int")).alias("_gl"))


def _cells_of(low: Column, high: Column, level: Column, origin: str) -> Column:
    """Cell coordinates of an interval, held within the grid."""
    n = F.pow(F.lit(2.0), level)
    at = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(n - 1, (v - F.col(origin)) / F.col("_gs") * n))).cast("int")
    return F.sequence(at(low), at(high))


def _index(side: DataFrame, grids: DataFrame) -> DataFrame:
    """Pieces with the cells that they touch, at every level: column by column, and the rows the piece has in a column."""
    rows = side.join(grids, TRACK).withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_gl"))))
    x1, y1, edge = F.col("x0") + F.col("dx"), F.col("y0") + F.col("dy"), F.col("_gs") * 1e-9
    rows = rows.withColumn("_cx", F.explode(_cells_of(F.least("x0", x1) - edge, F.greatest("x0", x1) + edge, F.col("_level"), "_gx")))
    width = F.col("_gs") / F.pow(F.lit(2.0), F.col("_level"))
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - F.col("x0"), F.col("dx"))))
    left, right = F.col("_gx") + F.col("_cx") * width - edge, F.col("_gx") + (F.col("_cx") + 1) * width + edge
    ya = F.when(F.abs("dx") > edge, F.col("y0") + share(left) * F.col("dy")).otherwise(F.col("y0"))
    yb = F.when(F.abs("dx") > edge, F.col("y0") + share(right) * F.col("dy")).otherwise(y1)
    rows = rows.withColumn("_cy", F.explode(_cells_of(F.least(ya, yb) - edge, F.greatest(ya, yb) + edge, F.col("_level"), "_gy")))
    return rows.drop("_gx", "_gy", "_x1", "_y1", "_gs", "_gl")


def _distinct(side: DataFrame, first: str) -> DataFrame:
    """Pieces with one row for all that lie on each other exactly: that with the lowest value of `first`."""
    place = [TRACK, "x0", "y0", "dx", "dy"]
    rest = [c for c in side.columns if c not in place]
    if rest == [first]:
        return side.groupBy(*place).agg(F.min(first).alias(first))
    return side.groupBy(*place).agg(F.min_by(F.struct(*rest), first).alias("_rest")).select(*place, "_rest.*")


def _closest(samples: DataFrame, side: DataFrame, square: Column, first: str, **picks: Column) -> DataFrame:
    """samples with aggregates over the pieces of side (x0, y0, dx, dy, more) at the least squared distance, exactly.

    On ties picks take the lowest value of `first`, so pieces that lie on each other are one (`_distinct`), and samples at one
    place of a track are looked up once. Pieces are indexed by the cells of a pyramid of grids. The cells that hold a place,
    from coarse to fine, each name a few pieces, and the nearest of these bounds the distance; then only pieces in the few
    cells that the bound reaches can be nearer. All joins are by (track, level, cell) or (track, x, y). Samples without
    a position or a track get nulls. Counts the pieces when it is called.
    """
    spark = samples.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = [TRACK, "x", "y"]
    places = samples.select(*keys).where(F.col(TRACK).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).repartition(n, *keys).distinct()
    side = _distinct(side, first)
    most, total = side.groupBy(TRACK).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    direct = most <= DIRECT_PIECES and total <= BROADCAST_ROWS
    rows, pieces, on = (places, F.broadcast(side), [TRACK]) if direct else _near(places, side, square, keys)
    # pairs never leave their task: first the least distance, then what lies at it; tables of places are never sent to the driver
    least = rows.join(pieces, on).groupBy(*keys).agg(F.min(square).alias("_m"))
    at_least = rows.join(least.hint("merge"), keys).join(pieces, on).where(square == F.col("_m"))
    found = at_least.groupBy(*keys).agg(*(c.alias(k) for k, c in picks.items()))
    return samples.join(found.hint("merge"), keys, "left").select(*samples.columns, *picks)


def _near(places: DataFrame, side: DataFrame, square: Column, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Places by the cells in which their nearest piece can lie, pieces by cells, and the columns that join them."""
    side = kept(side, "track")
    grids = small(_grids(side))
    located = places.join(grids, TRACK)
    index = kept(_index(side, grids), "track")
    cell = [TRACK, *_CELL]
    piece = F.struct("x0", "y0", "dx", "dy")
    x1, y1 = F.col("x0") + F.col("dx"), F.col("y0") + F.col("dy")
    ends = (F.min_by(piece, F.least("x0", x1)), F.max_by(piece, F.greatest("x0", x1)), F.min_by(piece, F.least("y0", y1)), F.max_by(piece, F.greatest("y0", y1)))
    named = small(kept(index.groupBy(*cell).agg(F.array(*ends).alias("_pieces")), "track"))
    own = located.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_gl"))))
    own = own.withColumn("_cx", _cells_of(F.col("x"), F.col("x"), F.col("_level"), "_gx")[0]).withColumn("_cy", _cells_of(F.col("y"), F.col("y"), F.col("_level"), "_gy")[0])
    bounds = own.join(named, cell).select(*keys, F.explode("_pieces").alias("_piece")).select(*keys, "_piece.*").groupBy(*keys).agg(F.min(square).alias("_bound"))
    near = located.join(bounds.hint("merge"), keys).withColumn("_reach", F.sqrt("_bound") * (1 + 1e-9) + F.col("_gs") * 1e-9)
    # the part of the circle within the pieces' bounds: for a place far outside it is thin, and its cells are small
    off = lambda v, low, high: F.greatest(F.col(low) - F.col(v), F.col(v) - F.col(high), F.lit(0.0))
    half = lambda d: F.sqrt(F.greatest(F.lit(0.0), (F.col("_reach") - d) * (F.col("_reach") + d)))
    for c, v, low, high, across in (("x", "x", "_gx", "_x1", off("y", "_gy", "_y1")), ("y", "y", "_gy", "_y1", off("x", "_gx", "_x1"))):
        inside = lambda e: F.greatest(F.col(low), F.least(F.col(high), e))  # noqa: B023, E731
        near = near.withColumn(f"_a{c}", inside(F.col(v) - half(across))).withColumn(f"_b{c}", inside(F.col(v) + half(across)))
    wide, high = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
    width = F.greatest(F.sqrt(wide * high) / 3, wide / CELLS_LONG, high / CELLS_LONG)
    level = F.least(F.col("_gl"), F.floor(F.log2(F.col("_gs") / width)).cast("int"))
    near = near.withColumn("_level", F.when(width > 0, F.greatest(F.lit(0), level)).otherwise(F.col("_gl"))).withColumn("_w", F.col("_gs") / F.pow(F.lit(2.0), "_level"))
    edge = F.col("_gs") * 1e-9
    gap = lambda v, c, origin: F.greatest(F.col(origin) + F.col(c) * F.col("_w") - edge - F.col(v), F.col(v) - F.col(origin) - (F.col(c) + 1) * F.col("_w") - edge, F.lit(0.0))
    for c, v, origin in (("_cx", "x", "_gx"), ("_cy", "y", "_gy")):
        near = near.withColumn(c, F.explode(_cells_of(F.col(f"_a{v}") - edge, F.col(f"_b{v}") + edge, F.col("_level"), origin)))
    near = near.where(F.hypot(gap("x", "_cx", "_gx"), gap("y", "_cy", "_gy")) <= F.col("_reach"))
    return kept(near.select(*keys, *cell[1:]), "track"), small(index), cell


def nearest_segment(samples: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Samples (keys, track, x, y) with the segment of the nearest track point; ties go to the lowest segment."""
    placed = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    near = placed.select(TRACK, F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), "segment")
    square = (F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2
    return _closest(samples, near, square, "segment", segment=F.min("segment"))


def project(samples: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Samples (keys, track, x, y) with `along`, the distance along the track of the nearest place on it (of the first
    piece on ties), and `off`, the distance to it."""
    length = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    share = F.when(length > 0, ((F.col("x") - F.col("x0")) * F.col("dx") + (F.col("y") - F.col("y0")) * F.col("dy")) / length).otherwise(0.0)
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    square = (F.col("x0") + share * F.col("dx") - F.col("x")) ** 2 + (F.col("y0") + share * F.col("dy") - F.col("y")) ** 2
    return _closest(samples, pieces, square, "seg_idx", along=F.min_by(F.col("cum_dist") + share * F.col("len"), "seg_idx"), off=F.sqrt(F.min(square)))


def segment_stats(placed: DataFrame, speed: str = "gps_speed", key: str = "session_id") -> DataFrame:
    """(session, lap, segment, min_speed, max_speed) over samples with a lap, a speed and a segment."""
    rows = placed.where(F.col("lap").isNotNull() & F.col(speed).isNotNull() & F.col("segment").isNotNull())
    return rows.groupBy(key, "lap", "segment").agg(F.min(speed).alias("min_speed"), F.max(speed).alias("max_speed"))
