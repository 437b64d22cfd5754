"""Live laps agree with the batch operators, however the rows are cut into micro-batches."""

import math

import pandas as pd

from apexframe.operators import laps
from apexframe.session import ship
from apexframe.streaming.live import _advance, live_crossings

LINE = (0.0, -5.0, 0.0, 5.0)


def test_live_crossings_equal_batch(spark, tmp_path):
    ship(spark)
    rows = [(s, i, i / 5, (100 + k) * math.sin(2 * math.pi * i / 200 - 1), (100 + k) * math.cos(2 * math.pi * i / 200 - 1) - 100 - k) for k, s in enumerate("ab") for i in range(900)]
    df = spark.createDataFrame(rows, "session_id string, seq long, t double, x double, y double")
    for n, (lo, hi) in enumerate(((0, 37), (37, 500), (500, 900))):
        df.where(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = live_crossings(stream, LINE).writeStream.format("memory").queryName("live_laps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted((r["session_id"], r["lap"], round(r["t_cross"], 6)) for r in spark.table("live_laps").collect())
    want = sorted((r["session_id"], r["k"], round(r["t_cross"], 6)) for r in laps.crossings_by_segment(df, LINE).collect())
    assert got == want and len(got) > 4


class _State:
    """One session's state between micro-batches."""

    hasTimedOut = False

    def __init__(self):
        self.get, self.exists, self.timeout = None, False, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def _advanced(state, rows):
    parts = [pd.DataFrame(rows, columns=["seq", "t", "x", "y"])] if rows else []
    return [tuple(r) for df in _advance(LINE, 30.0, 1000, ("a",), iter(parts), state) for r in df[["lap", "t_cross"]].itertuples(index=False)]


def test_rows_of_one_time_are_told_apart_by_seq():
    state = _State()
    assert _advanced(state, [(0, 0.0, -2.0, 0.0), (1, 1.0, -1.0, 0.0)]) == []
    assert _advanced(state, [(1, 1.0, 1.0, 0.0), (0, 0.5, 1.0, 0.0)]) == []  # seen already, late
    assert _advanced(state, [(2, 1.0, 1.0, 0.0), (3, 2.0, 2.0, 0.0)]) == [(1, 1.0)]
    assert _advanced(state, [(None, 3.0, 2.5, 0.0)]) == []
    assert _advanced(state, [(5, 3.0, -2.0, 0.0), (6, None, 0.0, 0.0)]) == []  # after a row without seq
    assert state.get[2] == 2.5 and state.timeout == 1000


def test_silent_sessions_are_forgotten():
    state = _State()
    assert _advanced(state, [(None, None, 1.0, 0.0)]) == [] and not state.exists and state.timeout is None
    _advanced(state, [(0, 0.0, -1.0, 0.0), (1, 1.0, 1.0, 0.0)])
    state.hasTimedOut = True
    assert _advanced(state, []) == [] and not state.exists
