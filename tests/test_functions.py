"""Scalar functions on hand-written values, quirks included."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from apexframe.functions import clock, geo, values


def run(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[1] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(("function", "cases"), [
    (clock.compact_date, {"301025": "2025-10-30", "010170": "1970-01-01", "310225": "", "3010255": "", "ab1025": ""}),
    (clock.time_token, {"17H02": "17:02", "17h02": "", "7H02": ""}),
    (clock.utc_clock, {" 12:34:56": "12:34:56", "3456": "00:34:56", "123": "", "12345678": "12:34:56"}),
    (clock.header_date, {"Saturday, November 8, 2025": "2025-11-08", "November 8, 2025": "2025-11-08", "8.11.2025": ""}),
    (clock.header_time, {"2:05 PM": "14:05", "12:00 AM": "00:00", "3 PM": "15:00", "x": ""}),
    (clock.clean_header, {"  Speed  GPS : km/h": "Speed GPS", "UTC time : 120000": "UTC time : 120000", "": ""}),
    (clock.seconds_of, {"90.5": 90.5, "1:30": 90.0, "1:00:01.5": 3601.5, "a:b": None, "1:2:3:4": None}),
    (clock.noisy_clock, {"12 : 34 : 56": "12:34:56", "12.3456": "12:34:56", "99:00:00": None, "": None}),
    (clock.overlay_date, {"at 4/18/2025 x": "4/18/2025", "2025-04-18": None}),
    (values.number, {" 1.5 ": 1.5, "1d": None, "nan": None, "-2e3": -2000.0, ".5": 0.5, "": None}),
    (values.rate, {"30000/1001": 30000 / 1001, "25": 25.0, "0/0": 30.0, "x": 30.0}),
])
def test_text_functions(spark, function, cases):
    assert run(spark, function, list(cases)) == pytest.approx(list(cases.values())) if all(isinstance(v, float) for v in cases.values()) else run(spark, function, list(cases)) == list(cases.values())


def test_null_text_gives_defined_results(spark):
    assert run(spark, clock.compact_date, [None]) == [""] and run(spark, clock.utc_clock, [None]) == [""]
    assert run(spark, values.rate, [None]) == [30.0] and run(spark, clock.seconds_of, [None]) == [None]


def test_noisy_timestamp_prefers_day_first(spark):
    got = run(spark, clock.noisy_timestamp, ["08/11/2025 17:25:01", "2025-11-08 17.25.01", "11/30/2025 17:25'01", "8/11/25 01:02:03", "30/30/2025 10:00:00", "17:25:01"])
    day = datetime(2025, 11, 8)
    assert got == [day.replace(hour=17, minute=25, second=1), day.replace(hour=17, minute=25, second=1), datetime(2025, 11, 30, 17, 25, 1), day.replace(hour=1, minute=2, second=3), None, None]


def test_labels(spark):
    assert run(spark, clock.duration_label, [61.2346, -1.0, float("nan"), None], "double") == ["01:01.235", "00:00.000", "--:--", "--:--"]
    assert run(spark, clock.lap_label, [-1, 0, 7], "int") == ["PIT", "OUT", "7"]
    assert run(spark, clock.delta_label, [-0.256, 0.0, 1.5, None], "double") == ["-0.26", "+0.00", "+1.50", ""]
    assert run(spark, lambda x: clock.group_name(F.lit(None).cast("timestamp"), x), ["clip1"]) == ["unknown_clip1.mp4"]


def test_absolute_time_to_the_microsecond(spark):
    got = run(spark, lambda s: clock.absolute_time(F.lit("2025-11-08"), F.lit("17:02"), s), [0.000001, 3600.5], "double")
    assert got == [datetime(2025, 11, 8, 13, 2, 0, 1), datetime(2025, 11, 8, 14, 2, 0, 500000)]


def test_geometry(spark):
    assert run(spark, geo.wrap_angle, [-181.0, 180.0, 190.0, -180.0, 540.0], "double") == [179.0, 180.0, -170.0, -180.0, -180.0]
    x = run(spark, geo.mercator_x, [44.94943356], "double")[0]
    y = run(spark, geo.mercator_y, [41.56628808], "double")[0]
    assert run(spark, geo.longitude, [x], "double")[0] == pytest.approx(44.94943356)
    assert run(spark, geo.latitude, [y], "double")[0] == pytest.approx(41.56628808)
    line = (0.0, -1.0, 0.0, 1.0)
    cross = lambda x2, y2: run(spark, lambda x: geo.step_crossing(x, F.lit(0.0), F.lit(x2), F.lit(y2), line), [-1.0, 0.0], "double")
    assert cross(1.0, 0.0) == [0.5, 0.0]  # a sample on the line starts the next step
    assert cross(0.0, 0.0) == [None, None]  # half open: an end on the line doesn't count; standing still neither
    assert run(spark, values.gauge_zone, [0.95, 0.9, 0.75, 0.76], "double") == ["red", "amber", "normal", "amber"]
