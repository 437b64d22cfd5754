"""Laps over an endless stream of samples.

State per session: the last sample, the last crossing and the lap number. A micro-batch's rows of a session are put in order
of time and seq; rows that don't come after the last sample seen in that order are late and dropped (they could only change
laps already reported), as are rows without t, x or y. Rows of one time are told apart by seq; without seq, only those in one
micro-batch count. The state of a session is kept for good, or with idle_ms until it is silent that long; should it speak
again, it begins anew. idle_ms is for streams without end: under the trigger availableNow Spark runs on to wait for timeouts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LAPS = "session_id string, lap int, t_cross double, duration double"
STATE = "t double, seq double, x double, y double, lap int, crossed double"


def _advance(line: tuple[float, float, float, float], min_gap: float, idle_ms: int | None, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    t, seq, x, y, lap, crossed = state.get if state.exists else (None, None, None, None, 0, None)
    rows = pd.concat(list(parts)).dropna(subset=["t", "x", "y"]).astype({"seq": float}).sort_values(["t", "seq"])
    if t is not None:
        rows = rows[(rows.t > t) | ((rows.t == t) & (rows.seq > (np.nan if seq is None else seq)))]
    if len(rows):
        ts, xs, ys = (rows[c].to_numpy(float) for c in ("t", "x", "y"))
        if t is not None:
            ts, xs, ys = np.append(t, ts), np.append(x, xs), np.append(y, ys)
        ax, ay, bx, by = line
        dx, dy, sx, sy = np.diff(xs), np.diff(ys), bx - ax, by - ay
        with np.errstate(divide="ignore", invalid="ignore"):
            d = dx * sy - dy * sx
            share = ((ax - xs[:-1]) * sy - (ay - ys[:-1]) * sx) / d
            along = ((ax - xs[:-1]) * dy - (ay - ys[:-1]) * dx) / d
        hit = np.flatnonzero((share >= 0) & (share < 1) & (along >= 0) & (along <= 1))
        out = []
        for at in ts[hit] + share[hit] * np.diff(ts)[hit]:
            if crossed is None or at - crossed >= min_gap:
                lap += 1
                out.append((key[0], lap, float(at), float(at - crossed) if crossed is not None else None))
                crossed = float(at)
        state.update((float(ts[-1]), float(rows.seq.iloc[-1]), float(xs[-1]), float(ys[-1]), int(lap), crossed))
    if idle_ms is not None and state.exists:
        state.setTimeoutDuration(idle_ms)
    if len(rows) and out:
        yield pd.DataFrame(out, columns=["session_id", "lap", "t_cross", "duration"])


def live_crossings(stream: DataFrame, line: tuple[float, float, float, float], min_gap: float = 30.0, idle_ms: int | None = None) -> DataFrame:
    """A stream of (session_id string, seq, t, x, y) to one row a crossing: the lap it begins and how long the one before took."""
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("session_id").applyInPandasWithState(partial(_advance, line, min_gap, idle_ms), LAPS, STATE, "append", timeout)
