"""Every registered telemetry query against its SQL on the smallest tables."""

import pytest

from oracle import SF, assert_same

from apexframe.operators import track
from apexframe.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, SF, QUERIES[name], SQL[name])


def test_frame_table_is_one_scan_and_one_exchange(spark):
    plan = QUERIES["frame_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_core_plans_do_not_gather_in_one_task(spark):
    for name in ("crossings_segment", "lap_stats", "resample_grid", "delta_to_best", "distance_integral"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


def test_all_tracks_take_part(spark):
    tracks = {r[0] for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_nationkey").distinct().collect()}
    sessions = {r[0] for r in QUERIES["nearest_segment_stats_by_track"](spark, SF).select("session_id").distinct().collect()}
    assert {s % 25 for s in sessions} <= tracks and len({s % 25 for s in sessions}) > 1
    sessions = {r[0] for r in QUERIES["project_to_polyline_by_track"](spark, SF).select("session_id").distinct().collect()}
    assert len({s % 25 for s in sessions}) > 1


def test_an_index_of_tracks_is_not_sent_through_the_driver(spark, monkeypatch):
    """Brands of some pieces each by an index that is over the bound: it is merged, and the result stays that of the SQL."""
    monkeypatch.setattr(track, "DIRECT_PIECES", 5)
    monkeypatch.setattr(track, "BROADCAST_ROWS", 30)
    out = QUERIES["project_to_polyline_by_track"](spark, SF)
    assert out.count() > 0 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert_same(spark, SF, QUERIES["project_to_polyline_by_track"], SQL["project_to_polyline_by_track"])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
