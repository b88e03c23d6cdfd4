"""The tracker as a streaming operator: the same fold as in batch, one state for each (node, c)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.calibrate import Tracker

OUT = "node string, c int, origin int, threshold double"


def track(stream: DataFrame, level: float, rate: float) -> DataFrame:
    """(node, c, origin, threshold) of issues (node, c, last_step, origin, point, target, score) that arrive in order of origin.

    A target misses if it is outside the point's bounds as issued.  State holds theta and the issues that wait for their score.  An origin not after the last one is an error.
    """

    def update(key, batches, state):
        theta, last, waiting = (json.loads(state.get[0]) if state.exists else (0.0, None, []))
        method, rows = Tracker(level, rate, theta), []
        for pdf in [pd.concat(list(batches)).sort_values("origin")]:
            for r in pdf.itertuples():
                if last is not None and r.origin <= last:
                    raise ValueError(f"origin {r.origin} is not after {last}")
                while waiting and waiting[0][0] + r.last_step <= r.origin:
                    _, score, target, lower, upper = waiting.pop(0)
                    if score is not None:
                        method.update(score, not lower <= target <= upper)
                rows.append((key[0], key[1], int(r.origin), method.theta))
                waiting.append((int(r.origin), None if pd.isna(r.score) else float(r.score), None if pd.isna(r.target) else float(r.target), r.point - method.theta, r.point + method.theta))
                last = int(r.origin)
        state.update((json.dumps((method.theta, last, waiting)),))
        yield pd.DataFrame(rows, columns=["node", "c", "origin", "threshold"])

    return stream.groupBy("node", "c").applyInPandasWithState(update, OUT, "kept string", "append", GroupStateTimeout.NoTimeout)
