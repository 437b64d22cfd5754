"""Registered queries over the driver's tables, with the same results in DuckDB SQL.

`events` stands in for telemetry: a user is a session, `value` is x (or a speed), the number in `props` is y (or rpm), t is
the time in seconds since 2024. `part` stands in for track points: a brand is a track.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import clock, geo, values
from .operators import channels, clean, compare, laps, media, timebase, track
from .plans import boards, convert, frames
from .session import shared_dir
from .sources import logs

LINE = (50.0, -1.0, 50.0, 101.0)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ev(spark: SparkSession, sf: str, *more) -> DataFrame:
    """events as samples."""
    micros = F.expr("bigint(datediff(ts, DATE'2024-01-01')) * 86400000000 + bigint(hour(ts)) * 3600000000 + bigint(minute(ts)) * 60000000 + bigint(extract(SECOND FROM ts) * 1000000)")
    k = F.get_json_object("props", "$.k").cast("double")
    return _read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (micros / 1e6).alias("t"), F.col("value").alias("x"), k.alias("y"), *more)


EV = "ev AS (SELECT user_id AS session_id, event_id AS seq, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value AS x, (props->>'$.k')::DOUBLE AS y, event_type, ts FROM events)"
CROSS = EV + """, st AS (
  SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(t) OVER w AS t2 FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY t, seq)
), cr0 AS (
  SELECT session_id, t + ((50.0 - x) * 102.0 - (-1.0 - y) * 0.0) / ((x2 - x) * 102.0 - (y2 - y) * 0.0) * (t2 - t) AS t_cross,
         ((50.0 - x) * 102.0) / ((x2 - x) * 102.0) AS tt, ((50.0 - x) * (y2 - y) - (-1.0 - y) * (x2 - x)) / ((x2 - x) * 102.0) AS uu
  FROM st WHERE x2 IS NOT NULL AND x2 <> x
), cr AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t_cross) AS k, t_cross FROM cr0 WHERE tt >= 0 AND tt < 1 AND uu >= 0 AND uu <= 1
)"""
LAPPED = CROSS + """, lp AS (
  SELECT e.session_id, e.seq, e.t, e.x, e.y, count(c.t_cross)::INT AS lap, greatest(0, e.t - coalesce(max(c.t_cross), any_value(e.t0))) AS lap_time
  FROM (SELECT *, min(t) OVER (PARTITION BY session_id) AS t0 FROM ev) e LEFT JOIN cr c ON c.session_id = e.session_id AND c.t_cross <= e.t
  GROUP BY e.session_id, e.seq, e.t, e.x, e.y
), ex AS (SELECT session_id, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY 1), sl AS (
  SELECT session_id, k::INT AS lap, t_cross AS start_t FROM cr UNION ALL SELECT session_id, 0, t0 FROM ex
), ld AS (
  SELECT session_id, lap, start_t, coalesce(nx, t1) AS end_t, lap >= 1 AND nx IS NOT NULL AS completed, coalesce(nx, t1) - start_t AS duration
  FROM (SELECT *, lead(start_t) OVER (PARTITION BY session_id ORDER BY lap) AS nx FROM sl) JOIN ex USING (session_id)
), ls AS (
  SELECT session_id, lap, coalesce(any_value(d.duration), max(lap_time)) AS time, min(x) AS min_speed, max(x) AS max_speed, min(y) AS min_rpm, max(y) AS max_rpm
  FROM lp LEFT JOIN (SELECT session_id, lap, duration FROM ld WHERE completed OR lap = 0) d USING (session_id, lap) GROUP BY 1, 2
), bl AS (
  SELECT session_id, arg_min(lap, (duration, lap)) AS lap, min(duration) AS duration FROM ld WHERE completed AND lap >= 1 AND duration > 20 GROUP BY 1
)"""


def _crossed(spark: SparkSession, sf: str, *more) -> tuple[DataFrame, DataFrame]:
    samples = ev(spark, sf, *more)
    return samples, laps.crossings_by_segment(samples, LINE)


def _stats(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lapped samples, laps and lap statistics."""
    samples, crossings = _crossed(spark, sf)
    lapped, durations = laps.assign_laps(samples, crossings), laps.lap_durations(samples, crossings)
    return lapped, durations, laps.lap_stats(lapped, durations, "x", "y")


@query(f"WITH {CROSS} SELECT session_id, k, round(t_cross, 3) AS t_cross FROM cr")
def crossings_segment(spark, sf):
    return _crossed(spark, sf)[1].select("session_id", F.col("k").cast("long").alias("k"), F.round("t_cross", 3).alias("t_cross"))


@query(f"""WITH RECURSIVE {EV}, s AS (
  SELECT *, lag(x) OVER w AS x0, lag(t) OVER w AS t0 FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY t, seq)
), c AS (
  SELECT session_id, t0 + (0 - 102 * (x0 - 50)) / ((0 - 102 * (x0 - 50)) - (0 - 102 * (x - 50))) * (t - t0) AS t_cross FROM s
  WHERE (x0 - 50 >= 0) <> (x - 50 >= 0) AND (abs(x0 - 50) <= 20 OR abs(x - 50) <= 20)
), a AS (
  SELECT session_id, min(t_cross) AS t_cross FROM c GROUP BY 1
  UNION ALL SELECT a.session_id, min(c.t_cross) FROM a JOIN c ON c.session_id = a.session_id AND c.t_cross - a.t_cross >= 21600 GROUP BY a.session_id, a.t_cross
) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t_cross) AS k, round(t_cross, 3) AS t_cross FROM a""")
def crossings_signed_debounced(spark, sf):
    found = laps.crossings_by_sign(ev(spark, sf), LINE, 20.0, 21600.0)
    return found.select("session_id", F.col("k").cast("long").alias("k"), F.round("t_cross", 3).alias("t_cross"))


@query(f"WITH {LAPPED} SELECT session_id, seq, lap, round(lap_time, 3) AS lap_time FROM lp")
def lap_assignment(spark, sf):
    return laps.assign_laps(*_crossed(spark, sf)).select("session_id", "seq", "lap", F.round("lap_time", 3).alias("lap_time"))


@query(f"WITH {LAPPED} SELECT session_id, seq, CASE WHEN n >= 2 AND lap = n THEN -1 ELSE lap END::INT AS lap FROM lp LEFT JOIN (SELECT session_id, count(*) AS n FROM cr GROUP BY 1) USING (session_id)")
def lap_assignment_marked_end(spark, sf):
    return laps.assign_laps(*_crossed(spark, sf), mark_end=True).select("session_id", "seq", "lap")


@query(f"WITH {LAPPED} SELECT session_id, lap, round(start_t, 3) AS start_t, round(end_t, 3) AS end_t, completed, round(duration, 3) AS duration FROM ld")
def lap_durations(spark, sf):
    out = laps.lap_durations(*_crossed(spark, sf))
    return out.select("session_id", "lap", F.round("start_t", 3).alias("start_t"), F.round("end_t", 3).alias("end_t"), "completed", F.round("duration", 3).alias("duration"))


@query(f"WITH {LAPPED} SELECT session_id, lap, round(time, 3) AS time, min_speed, max_speed, min_rpm, max_rpm FROM ls")
def lap_stats(spark, sf):
    return _stats(spark, sf)[2].withColumn("time", F.round("time", 3))


@query(f"WITH {LAPPED} SELECT session_id, lap, round(duration, 3) AS duration FROM bl")
def best_lap(spark, sf):
    return laps.best_laps(_stats(spark, sf)[1]).withColumn("duration", F.round("duration", 3))


@query(f"""WITH {LAPPED}, c AS (SELECT session_id, max(lap) AS now FROM lp GROUP BY 1)
SELECT ls.session_id, ls.lap, CASE WHEN ls.lap = 0 THEN 'OUT' ELSE ls.lap::VARCHAR END AS lap_label,
  CASE WHEN ls.lap = bl.lap THEN 'best' WHEN ls.lap = now THEN 'current' ELSE 'done' END AS status,
  trunc(min_speed)::INT || '/' || trunc(max_speed)::INT AS speed_label, trunc(min_rpm)::INT || '/' || trunc(max_rpm)::INT AS rpm_label
FROM ls LEFT JOIN bl USING (session_id) JOIN c USING (session_id)""")
def lap_board(spark, sf):
    lapped, durations, stats = _stats(spark, sf)
    current = lapped.groupBy("session_id").agg(F.max("lap").alias("lap"))
    return boards.lap_board(stats, laps.best_laps(durations), current).select("session_id", "lap", "lap_label", "status", "speed_label", "rpm_label")


@query(f"""WITH {LAPPED}, r AS (
  SELECT session_id, ls.lap, row_number() OVER (PARTITION BY session_id ORDER BY ls.lap) AS rn, count(*) OVER (PARTITION BY session_id) AS n, bl.lap AS b FROM ls LEFT JOIN bl USING (session_id)
), f AS (SELECT *, coalesce(max(CASE WHEN lap = b THEN rn END) OVER (PARTITION BY session_id), 1) AS rk FROM r)
SELECT session_id, lap FROM f WHERE rn >= greatest(1, least(rk - 2, n - 4)) AND rn < greatest(1, least(rk - 2, n - 4)) + 5""")
def lap_page(spark, sf):
    _, durations, stats = _stats(spark, sf)
    return laps.page(stats.select("session_id", "lap"), laps.best_laps(durations), 5)


@query("""WITH h AS (SELECT o_custkey AS session_id, year(o_orderdate)::INT AS lap, max(o_totalprice) AS time FROM orders GROUP BY 1, 2),
d AS (SELECT * FROM h WHERE lap < 1997), c AS (SELECT * FROM h WHERE lap >= 1996)
SELECT session_id, lap, time FROM d UNION ALL SELECT c.* FROM c ANTI JOIN d USING (session_id, lap)""")
def append_current_lap(spark, sf):
    orders = _read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("session_id"), F.year("o_orderdate").alias("lap")).agg(F.max("o_totalprice").alias("time"))
    return laps.append_current(orders.where("lap < 1997"), orders.where("lap >= 1996"))


@query(f"""WITH {EV}, s AS (SELECT *, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, seq) AS dt FROM ev),
m AS (SELECT session_id, coalesce(median(CASE WHEN dt > 0 THEN dt END), 0.1) AS md FROM s GROUP BY 1)
SELECT session_id, seq, round(sum(x / 3.6 * CASE WHEN dt > 0 THEN dt ELSE md END) OVER (PARTITION BY session_id ORDER BY t, seq), 2) AS distance FROM s JOIN m USING (session_id)""")
def distance_integral(spark, sf):
    return timebase.add_distance(ev(spark, sf), "x").select("session_id", "seq", F.round("distance", 2).alias("distance"))


@query(f"""WITH {EV}, g AS (SELECT session_id, seq, t, CASE WHEN seq % 3 = 0 THEN NULL ELSE x END AS v FROM ev)
SELECT session_id, seq, last_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward,
  first_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM g""")
def fill_forward_backward(spark, sf):
    gaps = ev(spark, sf).withColumn("v", F.when(F.col("seq") % 3 != 0, F.col("x")))
    return gaps.select("session_id", "seq", timebase.forward_fill(F.col("v")).alias("forward"), timebase.backward_fill(F.col("v")).alias("backward"))


INTERPOLATED = """, b AS (
  SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {a} END IGNORE NULLS) OVER p AS a0, last_value(v IGNORE NULLS) OVER p AS v0,
    first_value(CASE WHEN v IS NOT NULL THEN {a} END IGNORE NULLS) OVER q AS a1, first_value(v IGNORE NULLS) OVER q AS v1 FROM g
  WINDOW p AS (PARTITION BY session_id ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY session_id ORDER BY {o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) SELECT session_id, seq, round(coalesce(v, CASE WHEN a1 > a0 THEN v0 + (v1 - v0) * ({a} - a0) / (a1 - a0) END, v0, v1), 3) AS v FROM b"""


@query(f"WITH {EV}, g AS (SELECT session_id, seq, t, CASE WHEN seq % 3 <> 0 THEN x END AS v FROM ev)" + INTERPOLATED.format(a="t", o="t, seq"))
def interpolate_time(spark, sf):
    gaps = ev(spark, sf).withColumn("v", F.when(F.col("seq") % 3 != 0, F.col("x")))
    return timebase.interpolate(gaps, ["v"]).select("session_id", "seq", F.round("v", 3).alias("v"))


@query(f"WITH {EV}, g AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS n, CASE WHEN seq % 3 <> 0 THEN x END AS v FROM ev)" + INTERPOLATED.format(a="n", o="n"))
def interpolate_position(spark, sf):
    gaps = ev(spark, sf).withColumn("v", F.when(F.col("seq") % 3 != 0, F.col("x")))
    return timebase.interpolate_by_position(gaps, ["v"]).select("session_id", "seq", F.round("v", 3).alias("v"))


GRID = EV + """, u AS (SELECT session_id, t, arg_min(x, seq) AS x, arg_min(y, seq) AS y FROM ev GROUP BY 1, 2),
e AS (SELECT session_id, min(t) AS t0, max(t) AS t1 FROM u GROUP BY 1),
g AS (SELECT session_id, i::INT AS frame, i * 3600.0 AS video_time, least(greatest(t0 + i * 3600.0, t0), t1) AS gt
  FROM e, LATERAL (SELECT unnest(generate_series(0, greatest(1, ceil((t1 - t0) / 3600.0)::INT) - 1)) AS i))"""


@query(f"""WITH {GRID}, j AS (
  SELECT g.session_id, frame, video_time, gt, a.t AS a0, a.x AS v0 FROM g ASOF LEFT JOIN u a ON g.session_id = a.session_id AND g.gt >= a.t
), k AS (SELECT j.*, b.t AS a1, b.x AS v1 FROM j ASOF LEFT JOIN u b ON j.session_id = b.session_id AND j.gt <= b.t)
SELECT session_id, frame, video_time, round(coalesce(CASE WHEN a1 > a0 THEN v0 + (v1 - v0) * (gt - a0) / (a1 - a0) END, v0, v1), 3) AS x FROM k""")
def resample_grid(spark, sf):
    out = timebase.resample(ev(spark, sf), ["x"], 1 / 3600)
    return out.select("session_id", "frame", F.round("video_time", 3).alias("video_time"), F.round("x", 3).alias("x"))


@query("""WITH r AS (SELECT o_custkey AS session_id, o_orderkey AS seq, year(o_orderdate) AS lap, (hour(o_orderdate) * 3600 + dayofyear(o_orderdate))::DOUBLE AS t FROM orders),
l AS (SELECT session_id, lap, max(t) AS d, min(seq) AS f FROM r GROUP BY 1, 2),
o AS (SELECT session_id, lap, coalesce(sum(d) OVER (PARTITION BY session_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l)
SELECT session_id, seq, t + off AS t FROM r JOIN o USING (session_id, lap)""")
def stitch_time(spark, sf):
    rows = _read(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), F.year("o_orderdate").alias("lap"), (F.hour("o_orderdate") * 3600 + F.dayofyear("o_orderdate")).cast("double").alias("t"))
    return timebase.stitch_laps(rows).select("session_id", "seq", "t")


@query("""WITH p AS (SELECT l_orderkey AS session_id, l_linenumber AS seq, (coalesce(l_extendedprice, 0) * 0.01 - 10.0) AS v FROM lineitem)
SELECT session_id, seq, round(v - avg(v) OVER (PARTITION BY session_id), 8) AS v FROM p""")
def channel_scale_center(spark, sf):
    rows = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("seq"), F.col("l_extendedprice").alias("v"))
    return channels.rescale(rows, [("v", 0.01, -10.0, True)]).select("session_id", "seq", F.round("v", 8).alias("v"))


@query("""WITH a(raw_lower, standard_name, unit) AS (VALUES ('click', 'Action', 'n'), ('view', 'Action', 'n'), ('purchase', 'Sale', 'eur')),
r AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT user_id, event_type, coalesce(standard_name, event_type) AS nm, coalesce(unit, '') AS unit FROM r LEFT JOIN a ON lower(event_type) = raw_lower),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, nm ORDER BY event_type) AS k FROM n)
SELECT user_id AS session_id, nm || CASE WHEN k = 1 THEN '' ELSE '_' || k END AS name, unit, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events JOIN o USING (user_id, event_type) GROUP BY 1, 2, 3""")
def channel_alias_join(spark, sf):
    alias = spark.createDataFrame([("click", "Action", "n"), ("view", "Action", "n"), ("purchase", "Sale", "eur")], "raw_lower string, standard_name string, unit string")
    raw = _read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("col_idx"), F.col("event_type").alias("channel"), "value")
    return channels.normalise_long(raw, alias).groupBy("session_id", "name", "unit").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@query(f"WITH {EV}, s AS (SELECT session_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, seq) AS d FROM ev) SELECT session_id, round(coalesce(round(1 / median(CASE WHEN d > 0 THEN d END), 3), 10.0), 3) AS freq_hz FROM s GROUP BY 1")
def infer_frequency(spark, sf):
    return timebase.infer_frequency(ev(spark, sf))


@query(f"""WITH {EV}, q AS (SELECT session_id, quantile_cont(x, 0.995) AS f FROM ev GROUP BY 1), r AS (SELECT session_id, seq, least(greatest(x / f, 0), 1) AS r FROM ev JOIN q USING (session_id))
SELECT session_id, seq, round(r, 6) AS ratio, CASE WHEN r > 0.9 THEN 'red' WHEN r > 0.75 THEN 'amber' ELSE 'normal' END AS zone FROM r""")
def robust_scale(spark, sf):
    samples = ev(spark, sf)
    ratio = values.gauge_ratio(F.col("x"), F.col("full"))
    return samples.join(compare.gauge_scale(samples, "x"), "session_id").select("session_id", "seq", F.round(ratio, 6).alias("ratio"), values.gauge_zone(ratio).alias("zone"))


def _track(spark, sf):
    return _read(spark, sf, "part").select(F.col("p_brand").alias("track_id"), F.col("p_partkey").alias("pt_idx"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))


TRACK = "tk AS (SELECT p_brand AS track_id, p_partkey AS pt_idx, p_retailprice AS x, p_size::DOUBLE AS y FROM part)"
PIECES = TRACK + """, pc0 AS (SELECT track_id, row_number() OVER w AS seg_idx, x AS x0, y AS y0, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM tk WINDOW w AS (PARTITION BY track_id ORDER BY pt_idx)),
pc AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, coalesce(sum(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM pc0 WHERE dx IS NOT NULL)"""


@query(f"WITH {PIECES} SELECT track_id, round(sum(len), 4) AS length FROM pc GROUP BY 1")
def polyline_length(spark, sf):
    return track.track_length(_track(spark, sf)).withColumn("length", F.round("length", 4))


@query(f"WITH {TRACK} SELECT track_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, max(abs(x)) > 180 OR max(abs(y)) > 90 AS projected FROM tk GROUP BY 1")
def track_bounds(spark, sf):
    return track.track_bounds(_track(spark, sf))


CLASSED = TRACK + """, hd AS (SELECT *, degrees(atan2(lead(y) OVER w - y, lead(x) OVER w - x)) AS hdg, lead(x) OVER w IS NULL AS fin, row_number() OVER w AS i FROM tk WINDOW w AS (PARTITION BY track_id ORDER BY pt_idx)),
cv AS (SELECT *, hdg - lag(hdg) OVER (PARTITION BY track_id ORDER BY i) AS d FROM hd),
cu AS (SELECT *, coalesce(abs(CASE WHEN d >= -180 AND d <= 180 THEN d ELSE (((d + 180) % 360) + 360) % 360 - 180 END), 0) AS c FROM cv),
kd AS (SELECT *, CASE WHEN avg(c) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) > 40 THEN 'turn' ELSE 'straight' END AS k0 FROM cu),
kf AS (SELECT *, CASE WHEN fin THEN coalesce(lag(k0) OVER (PARTITION BY track_id ORDER BY i), k0) ELSE k0 END AS k1 FROM kd),
rn AS (SELECT *, CASE WHEN k1 = lag(k1) OVER (PARTITION BY track_id ORDER BY i) THEN 0 ELSE 1 END AS nw FROM kf),
ru AS (SELECT *, sum(nw) OVER (PARTITION BY track_id ORDER BY i) AS run FROM rn),
rc AS (SELECT *, count(*) OVER (PARTITION BY track_id, run) AS n FROM ru),
ke AS (SELECT *, last_value(CASE WHEN run = 1 OR n >= 10 THEN k1 END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind FROM rc),
sg AS (SELECT *, sum(CASE WHEN kind = pk THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY i)::BIGINT AS segment FROM (SELECT *, lag(kind) OVER (PARTITION BY track_id ORDER BY i) AS pk FROM ke))"""


@query(f"WITH {CLASSED} SELECT track_id, segment, any_value(kind) AS kind, count(*) AS points, CASE WHEN any_value(kind) = 'turn' THEN 'T' ELSE 'S' END || segment AS label FROM sg GROUP BY 1, 2")
def turn_straight_segments(spark, sf):
    return track.segments(track.turns_and_straights(_track(spark, sf), 40.0)).select("track_id", "segment", "kind", "points", "label")


def _segment_points(spark, sf):
    """All suppliers as points of five tracks."""
    return _read(spark, sf, "supplier").select(F.pmod(F.col("s_suppkey"), F.lit(5)).alias("track_id"), F.pmod(F.floor(F.col("s_suppkey") / 5), F.lit(10)).alias("segment"), (F.pmod(F.col("s_suppkey") * 37, F.lit(101))).cast("double").alias("x"), F.pmod(F.col("s_suppkey") * 53, F.lit(101)).cast("double").alias("y"))


NEAREST = """, sp AS (SELECT s_suppkey % 5 AS track_id, s_suppkey // 5 % 10 AS segment, ((s_suppkey * 37) % 101)::DOUBLE AS px, ((s_suppkey * 53) % 101)::DOUBLE AS py FROM supplier),
nr AS (SELECT lp.session_id, lp.seq, lp.lap, lp.x, arg_min(segment, (pow(lp.x - px, 2) + pow(lp.y - py, 2), segment)) AS segment FROM lp JOIN sp ON sp.track_id = lp.session_id % 5 GROUP BY ALL)"""


@query(f"WITH {LAPPED}{NEAREST} SELECT session_id, lap, segment, min(x) AS min_speed, max(x) AS max_speed FROM nr GROUP BY 1, 2, 3")
def nearest_segment_stats(spark, sf):
    lapped = laps.assign_laps(*_crossed(spark, sf)).withColumn("track_id", F.pmod(F.col("session_id"), F.lit(5)))
    placed = track.nearest_segment(lapped, _segment_points(spark, sf), ["session_id", "seq"])
    return track.segment_stats(placed, "x")


NEAREST_BY_TRACK = """, sp AS (SELECT s_nationkey::BIGINT AS track_id, s_suppkey % 10 AS segment, ((s_suppkey * 37) % 101)::DOUBLE AS px, ((s_suppkey * 53) % 101)::DOUBLE AS py FROM supplier),
nr AS (SELECT lp.session_id, lp.seq, lp.lap, lp.x, arg_min(segment, (pow(lp.x - px, 2) + pow(lp.y - py, 2), segment)) AS segment FROM lp JOIN sp ON sp.track_id = lp.session_id % 25 GROUP BY ALL)"""


@query(f"WITH {LAPPED}{NEAREST_BY_TRACK} SELECT session_id, lap, segment, min(x) AS min_speed, max(x) AS max_speed FROM nr GROUP BY 1, 2, 3")
def nearest_segment_stats_by_track(spark, sf):
    """All suppliers as track points; a nation is a track, a session runs on one of the 25."""
    points = _read(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("track_id"), F.pmod(F.col("s_suppkey"), F.lit(10)).alias("segment"), F.pmod(F.col("s_suppkey") * 37, F.lit(101)).cast("double").alias("x"), F.pmod(F.col("s_suppkey") * 53, F.lit(101)).cast("double").alias("y"))
    lapped = laps.assign_laps(*_crossed(spark, sf)).withColumn("track_id", F.pmod(F.col("session_id"), F.lit(25)).cast("long"))
    return track.segment_stats(track.nearest_segment(lapped, points, ["session_id", "seq"]), "x")


PROJECTED = EV + """, """ + PIECES + """, pj AS (
  SELECT session_id, seq, seg_idx, cum + u * len AS along, pow(x0 + u * dx - x, 2) + pow(y0 + u * dy - y, 2) AS d
  FROM (SELECT ev.session_id, ev.seq, ev.x * 10 + 900 AS x, ev.y / 2 AS y, pc.*, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest(((ev.x * 10 + 900 - x0) * dx + (ev.y / 2 - y0) * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS u
    FROM ev, pc WHERE pc.track_id = 'Brand#11'))"""
PROJECTED_BY_MAKER = PROJECTED.replace("p_brand AS track_id", "p_brand[7:7] AS track_id").replace("pc.track_id = 'Brand#11'", "pc.track_id = (1 + ev.session_id % 5)::VARCHAR")


@query(f"WITH {PROJECTED_BY_MAKER} SELECT session_id, seq, round(arg_min(along, (d, seg_idx)), 3) AS along, round(sqrt(min(d)), 3) AS off FROM pj GROUP BY 1, 2")
def project_to_polyline(spark, sf):
    """All makers of part (the first digit of a brand) as tracks of many pieces; a session runs on one of the five."""
    maker = (F.pmod(F.col("session_id"), F.lit(5)) + 1).cast("string")
    samples = ev(spark, sf).select("session_id", "seq", (F.col("x") * 10 + 900).alias("x"), (F.col("y") / 2).alias("y"), maker.alias("track_id"))
    points = _read(spark, sf, "part").select(F.substring("p_brand", 7, 1).alias("track_id"), F.col("p_partkey").alias("pt_idx"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return track.project(samples, track.track_pieces(points), ["session_id", "seq"]).select("session_id", "seq", F.round("along", 3).alias("along"), F.round("off", 3).alias("off"))


PROJECTED_BY_TRACK = PROJECTED.replace("pc.track_id = 'Brand#11'", "pc.track_id = 'Brand#' || (1 + ev.session_id % 5) || (1 + (ev.session_id // 5) % 5)")


@query(f"WITH {PROJECTED_BY_TRACK} SELECT session_id, seq, round(arg_min(along, (d, seg_idx)), 3) AS along, round(sqrt(min(d)), 3) AS off FROM pj GROUP BY 1, 2")
def project_to_polyline_by_track(spark, sf):
    """All brands of part as tracks; a session runs on one of the 25."""
    number = lambda x: (F.pmod(F.floor(x), F.lit(5)) + 1).cast("string")
    brand = F.concat(F.lit("Brand#"), number(F.col("session_id")), number(F.col("session_id") / 5))
    samples = ev(spark, sf).select("session_id", "seq", (F.col("x") * 10 + 900).alias("x"), (F.col("y") / 2).alias("y"), brand.alias("track_id"))
    placed = track.project(samples, track.track_pieces(_track(spark, sf)), ["session_id", "seq"]).where("off IS NOT NULL")  # a brand of one part is no track
    return placed.select("session_id", "seq", F.round("along", 3).alias("along"), F.round("off", 3).alias("off"))


@query(f"""WITH {LAPPED}, al AS (SELECT *, sum(x::DECIMAL(18,4)) OVER (PARTITION BY session_id, lap ORDER BY t, seq)::DOUBLE AS along FROM lp),
pf AS (SELECT al.session_id, along AS dist, min(lap_time) AS bt FROM al JOIN bl USING (session_id, lap) GROUP BY 1, 2),
j AS (SELECT al.session_id, seq, lap_time, along, a.dist AS a0, a.bt AS v0 FROM al ASOF LEFT JOIN pf a ON al.session_id = a.session_id AND al.along >= a.dist),
k AS (SELECT j.*, b.dist AS a1, b.bt AS v1 FROM j ASOF LEFT JOIN pf b ON j.session_id = b.session_id AND j.along <= b.dist)
SELECT session_id, seq, round(lap_time - coalesce(CASE WHEN a1 > a0 THEN v0 + (v1 - v0) * (along - a0) / (a1 - a0) END, v0, v1), 2) AS delta FROM k""")
def delta_to_best(spark, sf):
    lapped, durations, _ = _stats(spark, sf)
    w = W.partitionBy("session_id", "lap").orderBy("t", "seq")
    lapped = lapped.withColumn("along", F.sum(F.col("x").cast("decimal(18,4)")).over(w).cast("double"))
    return compare.delta_to_best(lapped, laps.best_laps(durations)).select("session_id", "seq", F.round("delta", 2).alias("delta"))


@query("""WITH m AS (SELECT l_returnflag AS g, avg(l_quantity) AS m FROM lineitem GROUP BY 1), c AS (SELECT g, m, l_quantity - m AS u, l_extendedprice AS v FROM lineitem JOIN m ON g = l_returnflag),
s AS (SELECT g, any_value(m) AS m, count(*) AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(v) AS t0, sum(u*v) AS t1, sum(u*u*v) AS t2, sum(v*v) AS vv FROM c GROUP BY 1),
d AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS dd FROM s),
e AS (SELECT *, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2))/dd AS c0, (n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2))/dd AS c1, (n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2))/dd AS c2 FROM d)
SELECT g, n, round(c0 - c1*m + c2*m*m, 2) AS c, round(c1 - 2*c2*m, 3) AS b, round(c2, 4) AS a, round(1 - (vv - c0*t0 - c1*t1 - c2*t2)/(vv - t0*t0/n), 5) AS r2 FROM e""")
def quadratic_fit(spark, sf):
    rows = _read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    out = compare.quadratic_fit(rows, "l_quantity", "l_extendedprice", ["g"])
    return out.select("g", "n", F.round("c", 2).alias("c"), F.round("b", 3).alias("b"), F.round("a", 4).alias("a"), F.round("r2", 5).alias("r2"))


@query("""WITH m AS (SELECT l_suppkey AS g, avg(l_extendedprice) AS mx, avg(l_quantity) AS my, stddev_pop(l_extendedprice) AS sx FROM lineitem GROUP BY 1),
u AS (SELECT g, mx, sx, (l_extendedprice - mx) / sx AS p1, l_quantity - my AS v FROM lineitem JOIN m ON g = l_suppkey),
a2 AS (SELECT g, avg(p1 ** 2) AS b0, sum(p1 ** 3) / sum(p1 ** 2) AS b1 FROM u GROUP BY 1),
w AS (SELECT u.*, p1 ** 2 - b0 - b1 * p1 AS p2 FROM u JOIN a2 USING (g)),
a3 AS (SELECT g, avg(p1 ** 3) AS c0, sum(p1 ** 4) / sum(p1 ** 2) AS c1, sum(p1 ** 3 * p2) / sum(p2 ** 2) AS c2 FROM w GROUP BY 1),
q AS (SELECT w.*, p1 ** 3 - c0 - c1 * p1 - c2 * p2 AS p3 FROM w JOIN a3 USING (g)),
f AS (SELECT g, count(*) AS n, sum(v * v) AS vv, sum(v * p1) ** 2 / sum(p1 ** 2) AS e1, sum(v * p2) ** 2 / sum(p2 ** 2) AS e2, sum(v * p3) ** 2 / sum(p3 ** 2) AS e3, sum(v * p3) / sum(p3 ** 2) / any_value(sx) ** 3 AS top FROM q GROUP BY 1)
SELECT g, n, round(e1 / vv, 6) AS r2_1, round((e1 + e2) / vv, 6) AS r2_2, round((e1 + e2 + e3) / vv, 6) AS r2_3, round(top * 1e18, 1) AS top FROM f""")
def polynomial_orders(spark, sf):
    """How much of the quantity straight, quadratic and cubic fits on the price explain, per supplier."""
    rows = _read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), "l_extendedprice", "l_quantity")
    fits = [compare.polynomial_fit(rows, "l_extendedprice", "l_quantity", ["g"], k) for k in (1, 2, 3)]
    one, two, three = (f.select("g", "n", F.round("r2", 6).alias(f"r2_{k}"), F.round(F.col("coefs")[k] * 1e18, 1).alias("top")) for k, f in enumerate(fits, 1))
    return three.join(one.select("g", "r2_1"), "g").join(two.select("g", "r2_2"), "g").select("g", "n", "r2_1", "r2_2", "r2_3", "top")


IND = EV + ", ic AS (SELECT session_id, seq, t, ((x - 50) / 100 <= -0.15)::INT AS brk_ind, (abs((y - 50) / 100) >= 0.2)::INT AS crn_ind, ((x - 50) / 100 >= 0.05)::INT AS tps_ind FROM ev)"


@query(f"WITH {IND} SELECT session_id, seq, brk_ind, crn_ind, tps_ind, (brk_ind = 0 AND tps_ind = 0 AND crn_ind = 0)::INT AS cst_ind FROM ic")
def indicators(spark, sf):
    rows = ev(spark, sf).withColumns({"gps_accel_long": (F.col("x") - 50) / 100, "gps_accel_lat": (F.col("y") - 50) / 100})
    return values.math_channels(rows, values.INDICATORS, {"pi": 3.14159265}).select("session_id", "seq", *values.INDICATORS)


@query(f"WITH {IND} SELECT session_id, round(sum(brk_ind * dt), 3) AS integral FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY session_id ORDER BY t, seq), 0) AS dt FROM ic) GROUP BY 1")
def brake_integral(spark, sf):
    rows = ev(spark, sf).withColumn("brk_ind", ((F.col("x") - 50) / 100 <= values.BRAKING).cast("int"))
    return compare.integrate(rows, "brk_ind", ["session_id"]).withColumn("integral", F.round("integral", 3))


@query("""WITH p AS (SELECT c_custkey, c_acctbal / 100 AS lon, (c_custkey % 1600) / 10.0 - 80 AS lat FROM customer),
m AS (SELECT *, radians(lon) * 6378137.0 AS x, ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0 AS y FROM p)
SELECT c_custkey, round(x, 2) AS x, round(y, 2) + 0.0 AS y, round(degrees(x / 6378137.0), 6) AS lon, round(degrees(atan(exp(y / 6378137.0)) * 2 - pi() / 2), 6) AS lat, abs(x) > 180 OR abs(y) > 90 AS projected FROM m""")
def mercator_roundtrip(spark, sf):
    p = _read(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("lon"), (F.pmod("c_custkey", F.lit(1600)) / 10.0 - 80).alias("lat"))
    m = p.select("c_custkey", geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"))
    return m.select("c_custkey", F.round("x", 2).alias("x"), (F.round("y", 2) + 0.0).alias("y"), F.round(geo.longitude(F.col("x")), 6).alias("lon"), F.round(geo.latitude(F.col("y")), 6).alias("lat"), geo.looks_projected(F.abs("x"), F.abs("y")).alias("projected"))


@query("""SELECT l_orderkey, l_linenumber, strftime(date_trunc('day', l_shipdate) + INTERVAL (l_orderkey % 24) HOUR + INTERVAL (l_linenumber * 7) MINUTE + INTERVAL 5 SECOND, '%Y-%m-%d %H:%M:%S') AS ts,
  (l_orderkey % 24) * 3600 + l_linenumber * 420 + 5.25 AS seconds, lpad((l_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((l_linenumber * 7)::VARCHAR, 2, '0') || ':05' AS hms FROM lineitem""")
def parse_noisy_timestamp(spark, sf):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = two(F.pmod("l_orderkey", F.lit(24))), two(F.col("l_linenumber") * 7)
    y, mo, d = F.year("l_shipdate").cast("string"), two(F.month("l_shipdate")), two(F.dayofmonth("l_shipdate"))
    ymd, dmy = F.concat_ws("-", y, mo, d), F.concat_ws("/", d, mo, y)
    times = [F.concat_ws(":", h, m, F.lit("05")), F.concat(h, F.lit(":"), m, F.lit("'05")), F.concat_ws(".", h, m, F.lit("05"))]
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("REC "), ymd, F.lit(" "), times[0])).when(F.col("l_linenumber") % 3 == 1, F.concat(dmy, F.lit("  "), times[1], F.lit(" x"))).otherwise(F.concat(F.lit("~"), dmy, F.lit(" "), times[0]))
    rows = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"), F.concat(h, F.lit(":"), m, F.lit(":05.25")).alias("clock"), F.concat(h, F.lit(" : "), m, F.lit("05 z")).alias("noisy"))
    return rows.select("l_orderkey", "l_linenumber", F.date_format(clock.noisy_timestamp(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("ts"), clock.seconds_of(F.col("clock")).alias("seconds"), clock.noisy_clock(F.col("noisy")).alias("hms"))


@query("""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%d%m%y') AS dt, lpad((o_orderkey % 24)::VARCHAR, 2, '0') AS h FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS event_date, h || ':07' AS event_time, h || ':07:00' AS utc, 6 AS n FROM o JOIN orders USING (o_orderkey)""")
def decode_tokens(spark, sf):
    h = F.lpad(F.pmod("o_orderkey", F.lit(24)).cast("string"), 2, "0")
    name = F.concat(F.lit("ALFANO6-LAP_SN84 "), F.date_format("o_orderdate", "ddMMyy"), F.lit("_"), h, F.lit("H07__X"))
    rows = _read(spark, sf, "orders").select("o_orderkey", clock.name_tokens(name).alias("t"), F.concat(h, F.lit("h07m00")).alias("u"))
    return rows.select("o_orderkey", clock.first_decoded(F.col("t"), clock.compact_date).alias("event_date"), clock.first_decoded(F.col("t"), clock.time_token).alias("event_time"), clock.utc_clock(F.col("u")).alias("utc"), F.size("t").alias("n"))


@query("""WITH d AS (SELECT user_id AS clip_id, ts::DATE AS dy, count(*) AS n, min(event_id) AS f, list_sort(list(date_trunc('second', ts))) AS l FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, f) AS k FROM d)
SELECT clip_id, strftime(l[len(l) // 2 + 1], '%Y-%m-%d %H:%M:%S') AS ts FROM r WHERE k = 1""")
def timestamp_vote(spark, sf):
    rows = _read(spark, sf, "events").select(F.col("user_id").alias("clip_id"), F.col("event_id").cast("double").alias("frame_offset"), (F.date_trunc("second", "ts").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("event_id").cast("decimal(18,6)"))).alias("ts"))
    return media.vote_timestamp(rows).select("clip_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("""WITH c AS (SELECT user_id AS camera_id, event_id AS path, date_trunc('second', ts) AS st, round(value * 1000) AS duration FROM events),
l AS (SELECT *, lag(st + to_seconds(duration::BIGINT)) OVER (PARTITION BY camera_id ORDER BY path) AS ex FROM c),
g AS (SELECT *, sum(CASE WHEN abs(epoch_us(st) - epoch_us(ex)) / 1e6 < 40000 THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id ORDER BY path)::INT AS group_no FROM l)
SELECT camera_id, path, group_no, strftime(first_value(st) OVER (PARTITION BY camera_id, group_no ORDER BY path), '%Y-%m-%d_%H-%M-%S') || '.mp4' AS group_name FROM g""")
def clip_groups(spark, sf):
    clips = _read(spark, sf, "events").select(F.col("user_id").alias("camera_id"), F.col("event_id").alias("path"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("start_ts"), F.round(F.col("value") * 1000).alias("duration"))
    return media.group_clips(clips, 40000.0).select("camera_id", "path", "group_no", "group_name")


@query("""SELECT event_id AS path, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - to_seconds(round(value)::BIGINT) END::VARCHAR AS start_ts,
  CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) + to_seconds(round(value)::BIGINT) ELSE date_trunc('second', ts) END::VARCHAR AS end_ts FROM events""")
def clip_fill(spark, sf):
    at = F.date_trunc("second", "ts").cast("timestamp_ntz")
    clips = _read(spark, sf, "events").select(F.col("event_id").alias("path"), F.when(F.col("event_id") % 2 == 0, at).alias("start_ts"), F.when(F.col("event_id") % 2 == 1, at).alias("end_ts"), F.round("value").alias("duration"))
    return media.fill_clip(clips).select("path", F.col("start_ts").cast("string").alias("start_ts"), F.col("end_ts").cast("string").alias("end_ts"))


@query("""WITH RECURSIVE f AS (SELECT user_id AS clip_id, event_id AS frame, floor(value) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT clip_id, i, c AS last, NULL::BIGINT AS frame, NULL::DOUBLE AS tick FROM f WHERE i = 1
  UNION ALL SELECT r.clip_id, f.i, CASE WHEN f.c <> r.last AND abs(f.c - r.last - 1) <= 0.5 THEN f.c ELSE r.last END,
    CASE WHEN f.c <> r.last AND abs(f.c - r.last - 1) <= 0.5 THEN f.frame END, CASE WHEN f.c <> r.last AND abs(f.c - r.last - 1) <= 0.5 THEN f.c END
  FROM r JOIN f ON f.clip_id = r.clip_id AND f.i = r.i + 1 WHERE r.tick IS NULL)
SELECT clip_id, frame, tick AS clock_s, round(tick - frame / 30.0, 6) AS video_start_s FROM r WHERE tick IS NOT NULL""")
def clock_tick(spark, sf):
    frames = _read(spark, sf, "events").select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("frame"), F.floor("value").cast("double").alias("clock_s"))
    return media.clock_ticks(frames, 30.0).withColumn("video_start_s", F.round("video_start_s", 6))


@query(f"""WITH {CROSS}, m AS (SELECT o_custkey AS session_id, o_custkey % 3 AS clip_id, o_orderkey % 9 AS k, o_totalprice / 100 AS v FROM orders),
s AS (SELECT session_id, clip_id, t_cross - v AS d FROM m JOIN cr USING (session_id, k))
SELECT session_id, clip_id, count(*) AS marks, round(avg(d), 3) AS shift_s, round(max(d) - min(d), 3) AS drift_s FROM s GROUP BY 1, 2""")
def sync_shift(spark, sf):
    marks = _read(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), (F.col("o_custkey") % 3).alias("clip_id"), (F.col("o_orderkey") % 9).alias("lap_idx"), (F.col("o_totalprice") / 100).alias("video_time"))
    out = media.sync_shifts(marks, _crossed(spark, sf)[1])
    return out.select("session_id", "clip_id", "marks", F.round("shift_s", 3).alias("shift_s"), F.round("drift_s", 3).alias("drift_s"))


@query("""WITH a AS (SELECT c_custkey, c_acctbal AS s FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT c_custkey, c_acctbal / 2 AS s FROM customer WHERE c_custkey % 2 = 0)
SELECT c.c_custkey, coalesce(b.s, a.s, 0) AS shift_s FROM customer c LEFT JOIN a USING (c_custkey) LEFT JOIN b USING (c_custkey)""")
def saved_shift(spark, sf):
    c = _read(spark, sf, "customer")
    saved = c.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_acctbal").alias("shift_s"))
    given = c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") / 2).alias("shift_s"))
    return media.use_shift(c.select("c_custkey"), saved, given, ["c_custkey"])


@query(f"""WITH {EV}, e AS (SELECT session_id, min(t) AS a, max(t) AS b, min(t) + session_id * 1000.0 AS s, session_id * 3000.0 AS d FROM ev GROUP BY 1),
o AS (SELECT *, greatest(0, a - s) AS st, least(d, b - s) AS en FROM e)
SELECT session_id, round(CASE WHEN en > st THEN st END, 3) AS start_s, round(CASE WHEN en > st THEN en END, 3) AS end_s, greatest(1.0, least(150.0, greatest(0.0, d - 60.0))) AS clip_s, abs((b - a) - d) <= 1250 AS same_length FROM o""")
def clip_overlap(spark, sf):
    e = ev(spark, sf).groupBy("session_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    d = F.col("session_id") * 3000.0
    start, end = media.overlap(F.col("a"), F.col("b"), F.col("a") + F.col("session_id") * 1000.0, d)
    return e.select("session_id", F.round(start, 3).alias("start_s"), F.round(end, 3).alias("end_s"), media.clip_range(d, F.lit(60.0), F.lit(150.0)).alias("clip_s"), media.same_length(F.col("b") - F.col("a"), d).alias("same_length"))


@query(f"""WITH {EV}, s AS (SELECT *, (floor(t * 1000) % 86400000)::BIGINT AS ms FROM ev)
SELECT session_id, seq, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS clock,
  strftime(TIMESTAMP '2024-03-01 10:30:00' - INTERVAL 4 HOUR + to_microseconds(ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS utc,
  CASE WHEN ms < 600000 THEN '0' ELSE '' END || (ms // 60000) || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS mmss, (25 + session_id % 10) / (1 + session_id % 3)::DOUBLE AS fps FROM s""")
def abs_time_labels(spark, sf):
    s = (F.pmod(F.floor(F.col("t") * 1000), F.lit(86400000)) / 1000).alias("s")
    rows = ev(spark, sf).select("session_id", "seq", s, F.concat_ws("/", (25 + F.col("session_id") % 10).cast("string"), (1 + F.col("session_id") % 3).cast("string")).alias("r"))
    utc = clock.absolute_time(F.lit("2024-03-01"), F.lit("10:30"), F.col("s"))
    return rows.select("session_id", "seq", clock.clock_label(F.col("s")).alias("clock"), F.date_format(utc, "yyyy-MM-dd HH:mm:ss.SSS").alias("utc"), clock.duration_label(F.col("s")).alias("mmss"), values.rate(F.col("r")).alias("fps"))


@query(f"""WITH {EV}, j AS (SELECT session_id, seq, CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 7 = 1 THEN floor(t / 86400) ELSE t END AS t, CASE WHEN seq % 7 = 2 THEN NULL ELSE x END AS x, CASE WHEN seq % 7 = 3 THEN 0 ELSE y END AS y FROM ev),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, t ORDER BY seq) AS n FROM j WHERE t IS NOT NULL),
v AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS c FROM k WHERE n = 1 AND x IS NOT NULL), w AS (SELECT * FROM v WHERE c >= 2)
SELECT session_id, seq, round(t, 6) AS t, x, y FROM (SELECT *, lag(x) OVER q AS x0, lag(y) OVER q AS y0 FROM w WINDOW q AS (PARTITION BY session_id ORDER BY t, seq)) WHERE coalesce(NOT (x = x0 AND y = y0), true)""")
def clean_samples(spark, sf):
    k = F.col("seq") % 7
    text = F.when(k == 0, "n/a").when(k == 1, F.floor(F.col("t") / 86400).cast("string")).otherwise(F.col("t").cast("string"))
    junk = ev(spark, sf).select("session_id", "seq", values.number(text).alias("t"), F.when(k == 2, F.lit(float("nan"))).otherwise(F.col("x")).alias("x"), F.when(k == 3, 0.0).otherwise(F.col("y")).alias("y"), F.lit(None).cast("double").alias("void"))
    rows = clean.drop_empty(junk.withColumn("x", values.no_nan(F.col("x"))))
    rows = clean.drop_standing(clean.with_position(timebase.one_per_time(rows)))
    return rows.select("session_id", "seq", F.round("t", 6).alias("t"), "x", "y")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS event_date, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30' AS event_time, 'Speed GPS' AS header FROM orders""")
def header_datetime(spark, sf):
    hour = F.pmod("o_orderkey", F.lit(24)).cast("int")
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("Monday, ")).otherwise(F.lit("")), F.date_format("o_orderdate", "MMMM d, yyyy"))
    time = F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.lit(":30 "), F.when(hour < 12, "AM").otherwise("PM"))
    return _read(spark, sf, "orders").select("o_orderkey", clock.header_date(text).alias("event_date"), clock.header_time(time).alias("event_time"), clock.clean_header(F.concat(F.lit("  Speed   GPS : km/h "), F.col("o_orderstatus"))).alias("header"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS sessions, count(DISTINCT ts::DATE) AS days, count(value) > 0 AS has_value FROM events GROUP BY 1""")
def union_sessions(spark, sf):
    e = _read(spark, sf, "events")
    parts = e.where("event_type < 'm'").unionByName(e.where("event_type >= 'm'").drop("props"), allowMissingColumns=True)
    return parts.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("sessions"), F.countDistinct(F.to_date("ts")).alias("days"), (F.count("value") > 0).alias("has_value"))


@query(f"""WITH {EV}, g AS (SELECT session_id, floor(t / 3600) AS h FROM ev WHERE seq % 2 = 0 UNION SELECT session_id, floor(t / 3600) + 1 FROM ev WHERE seq % 2 = 1) SELECT session_id, count(*) AS hours FROM g GROUP BY 1""")
def timeline_union(spark, sf):
    e = ev(spark, sf)
    even, odd = e.where("seq % 2 = 0").select("session_id", F.floor(F.col("t") / 3600).alias("h")), e.where("seq % 2 = 1").select("session_id", (F.floor(F.col("t") / 3600) + 1).alias("h"))
    return even.union(odd).distinct().groupBy("session_id").agg(F.count("*").alias("hours"))


@query(f"""WITH {TRACK}, b AS (SELECT track_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM tk GROUP BY 1), s AS (SELECT tk.*, x0, y0, x1, y1, least(1880 / greatest(x1 - x0, 1e-9), 1040 / greatest(y1 - y0, 1e-9)) AS sc FROM tk JOIN b USING (track_id))
SELECT track_id, pt_idx, round((x - (x0 + x1) / 2) * sc + 960, 3) AS cx, round(540 - (y - (y0 + y1) / 2) * sc, 3) AS cy FROM s""")
def canvas_fit(spark, sf):
    points = _track(spark, sf)
    b = track.track_bounds(points)
    cx, cy = geo.fit_to_canvas(F.col("x"), F.col("y"), (F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y")), 1920, 1080, 20)
    return points.join(b, "track_id").select("track_id", "pt_idx", F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, coalesce(nullif(o_totalprice, 0), o_custkey) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, v, k::INT AS k FROM r WHERE k <= 3""")
def resolve_columns(spark, sf):
    o = _read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.nullif("o_totalprice", F.lit(0.0)).alias("Speed GPS"), F.col("o_custkey").cast("double").alias("GPS Speed"))
    v = values.first_value(o, ["speed gps", "gps speed"])
    top = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("Speed GPS"), "o_orderkey"))
    return o.select("o_custkey", "o_orderkey", v.alias("v"), top.alias("k")).where("k <= 3")


@query(f"""WITH {EV} SELECT session_id, seq, CASE WHEN d < 0 THEN 'faster' WHEN d > 0 THEN 'slower' ELSE 'even' END AS cls, CASE WHEN d < 0 THEN '-' ELSE '+' END || (abs(c) // 100) || '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0') AS label, greatest(-2.0, least(2.0, d)) AS held
FROM (SELECT *, (floor(x) - 50) / 4 AS d, ((floor(x) - 50) * 25)::BIGINT AS c FROM ev)""")
def delta_labels(spark, sf):
    d = (F.floor("x") - 50) / 4
    return ev(spark, sf).select("session_id", "seq", clock.delta_class(d).alias("cls"), clock.delta_label(d).alias("label"), values.clamp(d, -2.0, 2.0).alias("held"))


@query(f"""WITH {CLASSED}, b AS (SELECT track_id, segment, any_value(kind) AS kind, count(*) AS points FROM sg GROUP BY 1, 2),
st AS (SELECT p_brand AS track_id, (p_partkey % 4)::BIGINT AS segment, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1, 2)
SELECT b.track_id AS session_id, 1 AS lap, segment, kind, points, lo AS min_speed, hi AS max_speed, CASE WHEN kind = 'straight' THEN coalesce(trunc(lo)::INT || '/' || trunc(hi)::INT, '') ELSE '' END AS speed_label FROM b LEFT JOIN st USING (track_id, segment)""")
def sector_board(spark, sf):
    segs = track.segments(track.turns_and_straights(_track(spark, sf), 40.0))
    stats = _read(spark, sf, "part").groupBy(F.col("p_brand").alias("session_id"), F.lit(1).alias("lap"), (F.col("p_partkey") % 4).alias("segment")).agg(F.min("p_retailprice").alias("min_speed"), F.max("p_retailprice").alias("max_speed"))
    of = segs.select(F.col("track_id").alias("session_id"), F.lit(1).alias("lap"), "track_id").distinct()
    return boards.sector_board(segs, stats, of).select("session_id", "lap", "segment", "kind", "points", "min_speed", "max_speed", "speed_label")


@query("""WITH r AS (SELECT user_id AS session_id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'km/h' WHEN 1 THEN '-1.5' ELSE event_id::VARCHAR END AS cell, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT session_id, seq, cell FROM r WHERE n > 1 OR cell <> 'km/h'""")
def units_row(spark, sf):
    """Rows without a session's row of units."""
    cell = F.when(F.col("seq") % 3 == 0, "km/h").when(F.col("seq") % 3 == 1, "-1.5").otherwise(F.col("seq").cast("string"))
    return clean.strip_units_row(_read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq")).withColumn("cell", cell), "cell")


@query(f"""WITH {TRACK}, d AS (SELECT track_id, floor(x / 20) * 20 AS x, floor(y / 5) * 5 AS y, min(pt_idx) AS k FROM tk GROUP BY 1, 2, 3)
SELECT track_id, arg_min(x, k) AS x1, arg_min(y, k) AS y1, arg_max(x, k) AS x2, arg_max(y, k) AS y2 FROM d GROUP BY 1 HAVING count(*) >= 2""")
def line_ends(spark, sf):
    """First and last of the distinct points of every track, its points on a grid so that some repeat."""
    points = _track(spark, sf).withColumns({"x": (F.floor(F.col("x") / 20) * 20).cast("double"), "y": (F.floor(F.col("y") / 5) * 5).cast("double")})
    return clean.line_ends(points)


@query("""WITH o AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'aim' WHEN 1 THEN 'alfano' ELSE 'alfano_excel' END AS device, lpad((o_orderkey % 24)::VARCHAR, 2, '0') AS h FROM orders),
s AS (SELECT *, 'k' || o_orderkey || '-' || strftime(o_orderdate, '%d%m%y') || '_' || h || 'H30 v' || (o_custkey % 9) || '-c' || (o_custkey % 7) || '-d' || (o_custkey % 11) AS session_id,
  device = 'aim' AND o_orderkey % 2 = 0 AS headed, device = 'alfano_excel' AND o_custkey % 2 = 0 AS dated FROM o)
SELECT session_id, device, CASE WHEN headed THEN 'R' || o_custkey WHEN device = 'aim' THEN 'd' || (o_custkey % 11) ELSE 'c' || (o_custkey % 7) END AS driver,
  CASE WHEN device = 'aim' THEN 'v' || (o_custkey % 9) ELSE 'd' || (o_custkey % 11) END AS venue, CASE WHEN device = 'aim' THEN 'c' || (o_custkey % 7) ELSE '' END AS vehicle,
  CASE WHEN device = 'aim' THEN 'd' || (o_custkey % 11) ELSE '' END AS session,
  CASE WHEN headed THEN '2024-03-04' WHEN dated THEN '2003-02-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS event_date,
  CASE WHEN headed THEN '15:30' WHEN o_orderkey % 5 = 0 THEN '12:00:01' WHEN dated THEN '05:15' ELSE h || ':30' END AS event_time FROM s""")
def metadata_precedence(spark, sf):
    """Orders as sessions: header before clock, file name and folder name."""
    o = _read(spark, sf, "orders").withColumn("device", F.when(F.col("o_orderkey") % 3 == 0, "aim").when(F.col("o_orderkey") % 3 == 1, "alfano").otherwise("alfano_excel"))
    part = lambda letter, n: F.concat(F.lit(letter), (F.col("o_custkey") % n).cast("string"))
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    folder = F.concat(F.lit("k"), F.col("o_orderkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "ddMMyy"), F.lit("_"), hour, F.lit("H30 "), part("v", 9), F.lit("-"), part("c", 7), F.lit("-"), part("d", 11))
    header = F.create_map(F.lit("Racer"), F.concat(F.lit("R"), F.col("o_custkey").cast("string")), F.lit("Date"), F.lit("Monday, March 4, 2024"), F.lit("Time"), F.lit("3:30 PM"))
    sessions = o.select(
        folder.alias("session_id"), "device", F.when((F.col("device") == "aim") & (F.col("o_orderkey") % 2 == 0), header).alias("meta"),
        F.when(F.col("o_custkey") % 2 == 0, "LAP_010203_05H15").otherwise("LAP").alias("file_name"),
        F.when(F.col("o_orderkey") % 5 == 0, "12:00:01").otherwise("").alias("utc_clock"))
    return logs.session_metadata(sessions).drop("meta")


@query(f"""WITH {TRACK}, b AS (SELECT track_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM tk GROUP BY 1)
SELECT track_id, pt_idx, round((x - x0) / greatest(x1 - x0, 1), 6) AS nx, round(1 - (y - y0) / greatest(y1 - y0, 1), 6) AS ny, round(least(greatest((x - 1000) / 200, 0), 1), 6) AS held FROM tk JOIN b USING (track_id)""")
def unit_square(spark, sf):
    """Track points in the unit square of their track, and held within given bounds."""
    points = _track(spark, sf)
    x, y = geo.unit_x(F.col("x"), F.col("min_x"), F.col("max_x")), geo.unit_y(F.col("y"), F.col("min_y"), F.col("max_y"))
    held = geo.unit_x(F.col("x"), F.lit(1000.0), F.lit(1200.0), clip=True)
    return points.join(track.track_bounds(points), "track_id").select("track_id", "pt_idx", F.round(x, 6).alias("nx"), F.round(y, 6).alias("ny"), F.round(held, 6).alias("held"))


@query("""SELECT user_id AS session_id, event_id AS seq, round((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 0.1::DOUBLE, 6) AS t FROM events""")
def synthetic_clock(spark, sf):
    rows = _read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"))
    return timebase.synthetic_clock(rows, ["seq"]).withColumn("t", F.round("t", 6))


@query(f"""WITH {EV} SELECT session_id, seq, coalesce(last_value(CASE WHEN seq % 4 = 0 THEN x END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 0) AS distance FROM ev""")
def distance_channel(spark, sf):
    """A distance channel with gaps."""
    gaps = ev(spark, sf).withColumn("distance", F.when(F.col("seq") % 4 == 0, F.col("x")))
    return timebase.fill_distance(gaps).select("session_id", "seq", "distance")


@query(f"""WITH {LAPPED}, st2 AS (SELECT *, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, seq) AS d FROM lp),
us AS (SELECT session_id, coalesce(median(CASE WHEN d > 0 THEN d END), 0.1) AS u FROM st2 GROUP BY 1),
ds AS (SELECT s.*, sum(coalesce(x, 0) / 3.6 * CASE WHEN d > 0 THEN d ELSE u END) OVER (PARTITION BY session_id ORDER BY t, seq) AS dist FROM st2 s JOIN us USING (session_id)),
al AS (SELECT *, dist - min(dist) OVER (PARTITION BY session_id, lap) AS along FROM ds),
pf AS (SELECT al.session_id, along AS dist, min(lap_time) AS bt FROM al JOIN bl USING (session_id, lap) GROUP BY 1, 2),
j AS (SELECT al.*, a.dist AS a0, a.bt AS v0 FROM al ASOF LEFT JOIN pf a ON al.session_id = a.session_id AND al.along >= a.dist),
k AS (SELECT j.*, b.dist AS a1, b.bt AS v1 FROM j ASOF LEFT JOIN pf b ON j.session_id = b.session_id AND j.along <= b.dist),
dl AS (SELECT session_id, seq, t, x, y, lap, lap_time - coalesce(CASE WHEN a1 > a0 THEN v0 + (v1 - v0) * (along - a0) / (a1 - a0) END, v0, v1) AS delta FROM k
  QUALIFY row_number() OVER (PARTITION BY session_id, t ORDER BY seq) = 1),
gr AS (SELECT session_id, i::INT AS frame, i * 3600.0 AS video_time, t0, least(t0 + i * 3600.0, t1) AS gt FROM ex, LATERAL (SELECT unnest(generate_series(0, greatest(1, ceil((t1 - t0) / 3600.0)::INT) - 1)) AS i)),
gl AS (SELECT gr.session_id, frame, video_time, gt, coalesce(k, 0)::INT AS lap, gt - coalesce(t_cross, t0) AS lap_time FROM gr ASOF LEFT JOIN cr ON gr.session_id = cr.session_id AND gt >= t_cross),
gb AS (SELECT gl.*, b.t AS tb, b.x AS xb, b.y AS yb, b.lap AS lb, b.delta AS db FROM gl ASOF LEFT JOIN dl b ON gl.session_id = b.session_id AND gt >= b.t),
ga AS (SELECT gb.*, a.t AS ta, a.x AS xa, a.y AS ya, a.lap AS la, a.delta AS da FROM gb ASOF LEFT JOIN dl a ON gb.session_id = a.session_id AND gt < a.t),
mx AS (SELECT ga.*, coalesce((gt - tb) / (ta - tb), 0) AS w FROM ga),
vl AS (SELECT *, xb + (coalesce(xa, xb) - xb) * w AS x, yb + (coalesce(ya, yb) - yb) * w AS y, CASE WHEN lb = la THEN db + (da - db) * w WHEN lb = lap THEN db WHEN la = lap THEN da ELSE coalesce(db, da) END AS delta FROM mx),
bd AS (SELECT session_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ev GROUP BY 1)
SELECT session_id, frame, round(gt, 6) AS t, lap, CASE WHEN lap = 0 THEN 'OUT' ELSE lap::VARCHAR END AS lap_label, round(lap_time, 2) AS lap_time, round(greatest(-2.0, least(2.0, delta)), 1) AS delta,
  CASE WHEN delta < -0.005 THEN 'faster' WHEN delta > 0.005 THEN 'slower' ELSE 'even' END AS delta_class, round(x, 3) AS gps_speed, round(y, 3) AS rpm,
  round(CASE WHEN x1 > 0 THEN greatest(0, least(1, x / x1)) ELSE 0 END, 4) AS speed_ratio, CASE WHEN x1 > 0 AND x / x1 > 0.9 THEN 'red' WHEN x1 > 0 AND x / x1 > 0.75 THEN 'amber' ELSE 'normal' END AS speed_zone,
  round(least(1, greatest(0, (x - x0) / greatest(x1 - x0, 1.0))), 4) AS nx, round(1 - least(1, greatest(0, (y - y0) / greatest(y1 - y0, 1.0))), 4) AS ny
FROM vl JOIN bd USING (session_id)""")
def frame_table(spark, sf):
    """One row an hour of every session. A delta within 5 ms counts as even here, as sums of distances differ in their last bits."""
    samples = frames.by_session(ev(spark, sf)).withColumns({"gps_speed": F.col("x"), "rpm": F.col("y")})
    out = boards.frame_table(timebase.add_distance(samples, "gps_speed"), LINE, 1 / 3600)
    return out.select(
        "session_id", "frame", F.round("t", 6).alias("t"), "lap", "lap_label", F.round("lap_time", 2).alias("lap_time"), F.round("delta", 1).alias("delta"),
        F.when(F.abs("delta") <= 0.005, "even").otherwise(F.col("delta_class")).alias("delta_class"), F.round("gps_speed", 3).alias("gps_speed"), F.round("rpm", 3).alias("rpm"),
        F.round("speed_ratio", 4).alias("speed_ratio"), "speed_zone", F.round("nx", 4).alias("nx"), F.round("ny", 4).alias("ny"))


@query(f"""WITH {LAPPED} SELECT session_id, lap, CASE WHEN lap % 7 <> 3 THEN lap ELSE -1 END::INT AS stated_lap, round(duration, 2) AS duration, CASE WHEN lap % 7 = 3 THEN 'extra' ELSE 'match' END AS status FROM ld WHERE completed
UNION ALL SELECT DISTINCT session_id, -1, 9999, NULL, 'missing' FROM ld WHERE completed""")
def lap_reconciliation(spark, sf):
    """Laps against a device's list that lacks every seventh lap, states times a millisecond short and has a lap of its own."""
    durations = laps.lap_durations(*_crossed(spark, sf))
    done = durations.where("completed")
    stated = done.where("lap % 7 <> 3").select("session_id", "lap", (F.col("duration") - 0.001).alias("duration"))
    stated = stated.unionByName(done.select("session_id", F.lit(9999).alias("lap"), F.lit(1e7).alias("duration")).distinct())
    of = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return boards.session_report(durations, stated, 0.5)[0].select("session_id", of("lap"), of("stated_lap"), F.round("duration", 2).alias("duration"), "status")


def _write_logs(spark: SparkSession, sf: str) -> str:
    """Every session of events as a log file in a folder of its own, in the layout with metadata and units; the folder of all."""
    samples, quoted = ev(spark, sf), lambda *c: F.concat(F.lit('"'), F.concat_ws('","', *(F.coalesce(x.cast("string"), F.lit("")) for x in c)), F.lit('"'))
    data = samples.select(F.col("session_id").alias("session"), "t", "seq", quoted(F.col("t"), F.col("x"), F.col("y")).alias("value"))
    top = ['"Format","log"', None, '"Venue","Rim, north"', "", '"Time","GPS Speed","RPM"', '"s","km/h","rpm"']
    head = samples.select(F.col("session_id").alias("session")).distinct()
    lines = F.array(*(F.concat(F.lit('"Racer","driver '), F.col("session").cast("string"), F.lit('"')) if line is None else F.lit(line) for line in top))
    head = head.select("session", F.lit(float("-inf")).alias("t"), F.posexplode(lines).alias("seq", "value"))
    folder = shared_dir(spark, "logs")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # files, not bytes, take the time
    rows = data.unionByName(head.withColumn("seq", F.col("seq").cast("long"))).repartition(n, "session").sortWithinPartitions("session", "t", "seq")
    rows.select("session", "value").write.partitionBy("session").text(folder)
    return folder


@query(f"""WITH {EV} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) + 1 AS seq, t, x AS gps_speed, y AS rpm, 'driver ' || session_id AS driver, 'Rim, north' AS venue FROM ev""")
def logs_read_back(spark, sf):
    """Sessions written as log files, read by blocks and converted to canonical samples, with two of their metadata."""
    samples, meta = convert.convert_aim(spark, _write_logs(spark, sf), channels.alias_table(spark))
    session = F.regexp_extract("session_id", r"session=(\d+)$", 1).cast("long").alias("session_id")
    return samples.join(meta, "session_id").select(session, "seq", "t", "gps_speed", "rpm", F.col("meta")["Racer"].alias("driver"), F.col("meta")["Venue"].alias("venue"))
