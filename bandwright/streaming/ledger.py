"""One origin at a time: learn from the targets now known, issue bounds, and keep the state as a table.

State is one row a node: (node, last, kept, issues).  A node's row holds the points that wait for their periods, at most as
many origins as the last covered step, and what each column's method keeps.  A call joins the state with the origin's points
and the new periods on the node, runs each row by itself, and writes the new state as Parquet: that table is the saved state,
and any later session goes on from it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import PLAIN

ISSUE = "array<struct<c:int,origin:int,point:double,t_lo:double,threshold:double,lower:double,upper:double,ready:boolean>>"
_NEW = "array<struct<t:int,y:double,censored:boolean>>"
STATE = f"node string, last int, kept string, issues {ISSUE}"

def per_step(horizon: int) -> list[list[int]]:
    """One column a step."""
    return [[h] for h in range(1, horizon + 1)]


def lead_time(steps: int, horizon: int) -> list[list[int]]:
    """One column: the sum of the first steps."""
    if not 1 <= steps <= horizon:
        raise ValueError("the lead time must be within the horizon")
    return [list(range(1, steps + 1))]


def initial_state(nodes: DataFrame, cover: list[list[int]], make: Callable) -> DataFrame:
    """State of nodes (node) that have issued nothing; make(c) gives the method of a column."""
    kept = json.dumps({"cover": cover, "waiting": [], "cells": [_kept(make(c)) for c in range(len(cover))]})
    return nodes.select("node", F.lit(-1).alias("last"), F.lit(kept).alias("kept"), F.array().cast(ISSUE).alias("issues"))


def seeded_state(seeds: DataFrame, cover: list[list[int]], make: Callable) -> DataFrame:
    """As initial_state, each method taught by its scores: seeds (node, c, k, score), c from 1, in order of k."""
    ordered = seeds.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "k", "score"))).alias("seeds"))

    def start(batches):
        for pdf in batches:
            rows = []
            for node, given in zip(pdf["node"], pdf["seeds"]):
                methods = [make(c) for c in range(len(cover))]
                for c, method in enumerate(methods):
                    method.seed([math.nan if s["score"] is None else float(s["score"]) for s in given if s["c"] == c + 1])
                rows.append((node, -1, json.dumps({"cover": cover, "waiting": [], "cells": [_kept(m) for m in methods]}), []))
            yield pd.DataFrame(rows, columns=["node", "last", "kept", "issues"])

    return ordered.mapInPandas(start, STATE)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(path)


def issues(state: DataFrame) -> DataFrame:
    """(node, c, origin, point, t_lo, threshold, lower, upper, ready) that the last call issued."""
    return state.select("node", F.inline("issues"))


def _new(actuals: DataFrame) -> DataFrame:
    flag = F.col("censored") if "censored" in actuals.columns else F.lit(False)
    cell = F.struct(F.col("t").cast("int").alias("t"), F.col("value").cast("double").alias("y"), F.coalesce(flag, F.lit(False)).alias("censored"))
    return actuals.groupBy("node").agg(F.array_sort(F.collect_list(cell)).cast(_NEW).alias("actuals"))


def _value(score: str) -> F.Column:
    pair = F.array(F.least("q_lo", "q_hi"), F.greatest("q_lo", "q_hi")) if score == "cqr" else F.array("point")
    return pair.cast("array<double>")


def _reach(cover: list[list[int]], score: str) -> int:
    if score == "cqr" and any(len(c) != 1 for c in cover):
        raise ValueError("native quantiles need columns of one step")
    return max(map(max, cover))


def step(state: DataFrame, origin: int, points: DataFrame, actuals: DataFrame, path: str, *, cover: list[list[int]], make: Callable, score: str = "absolute") -> DataFrame:
    """The state after one origin, written to path; `issues` reads the bounds from it.

    points: (node, h, point), or (node, h, q_lo, q_hi) for "cqr"; every node has steps 1 up to the last covered one.
    actuals: (node, t, value), the periods after the last origin up to this one, with `censored` where a value is a lower
    bound only; on the first call they may be any.  A missing value leaves its targets missing; a target is censored if a
    covered value is, and is told so to methods with `update_censored`.  Other periods, an origin not after the last
    one, missing points, or a state of other columns are errors.  Bounds without a threshold are NULL, not ready.
    """
    reach = _reach(cover, score)
    ahead = points.filter(F.col("h") <= reach).groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("h").cast("int").alias("h"), _value(score).alias("p")))).alias("points"))
    met = state.select("node", "last", "kept").join(ahead, "node", "left").join(_new(actuals), "node", "left")

    def run(batches):
        for pdf in batches:
            rows = [_one(r.node, r.last, r.kept, r.points, r.actuals, origin, cover, reach, make, score) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["node", "last", "kept", "issues"])

    met.mapInPandas(run, STATE).write.parquet(path)
    return load_state(state.sparkSession, path)


def replay(state: DataFrame, origins: list[int], points: DataFrame, actuals: DataFrame, path: str, *, cover: list[list[int]], make: Callable, score: str = "absolute") -> DataFrame:
    """The state after many origins in order, as `step` would leave it, in one pass: `issues` has the bounds of all of them.

    points has `origin` too.  A node's points and periods meet in one row; the state may be one that an earlier call saved.
    """
    if not origins or list(origins) != sorted(set(origins)):
        raise ValueError("origins must be strictly increasing")
    reach = _reach(cover, score)
    ahead = points.filter((F.col("h") <= reach) & F.col("origin").isin(*origins))
    ahead = ahead.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("origin").cast("int").alias("origin"), F.col("h").cast("int").alias("h"), _value(score).alias("p")))).alias("points"))
    met = state.select("node", "last", "kept").join(ahead, "node", "left").join(_new(actuals), "node", "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                last, kept, issued = r.last, r.kept, []
                given, seen = {}, {}
                for p in r.points if r.points is not None else []:
                    given.setdefault(p["origin"], []).append(p)
                for o in origins:
                    seen[o] = [a for a in (r.actuals if r.actuals is not None else []) if last < a["t"] <= o]
                    _, last, kept, out = _one(r.node, last, kept, given.get(o), seen[o], o, cover, reach, make, score)
                    issued += out
                rows.append((r.node, last, kept, issued))
            yield pd.DataFrame(rows, columns=["node", "last", "kept", "issues"])

    met.mapInPandas(run, STATE).write.parquet(path)
    return load_state(state.sparkSession, path)


def realised(issued: DataFrame, actuals: DataFrame, cover: list[list[int]]) -> DataFrame:
    """issued (node, c, origin...) with `target`, the sum of the covered values where all are known, and `censored`, whether any of them is."""
    spans = issued.sparkSession.createDataFrame([(c + 1, h) for c, steps in enumerate(cover) for h in steps], "c int, h int")
    flag = F.coalesce(F.col("censored"), F.lit(False)) if "censored" in actuals.columns else F.lit(False)
    cells = issued.select("node", "c", "origin").join(spans, "c").select("node", "c", "origin", (F.col("origin") + F.col("h")).alias("t"))
    cells = cells.join(actuals.select("node", "t", "value", flag.alias("censored")), ["node", "t"], "left")
    whole = cells.groupBy("node", "c", "origin").agg(
        F.when(F.count("value") == F.count(F.lit(1)), F.sum("value")).alias("target"), F.coalesce(F.bool_or("censored"), F.lit(False)).alias("censored")
    )
    return issued.join(whole, ["node", "c", "origin"])


def _kept(method) -> dict:
    return {name: getattr(method, name) for name in method.STATE}


def _method(make: Callable, c: int, kept: dict):
    method = make(c)
    for name, value in kept.items():
        setattr(method, name, value)
    return method


def _point(p: list, steps: list[int], native: bool):
    return p[steps[0] - 1] if native else sum(p[h - 1] for h in steps)


def _finite(x: float) -> float | None:
    return x if math.isfinite(x) else None


def _one(node, last: int, kept: str, points, actuals, origin: int, cover: list, reach: int, make: Callable, score: str) -> tuple:
    """A node's call: periods go to the waiting origins, columns whose last step is known teach, then bounds are issued."""
    kept, native, (score_of, bound_of) = json.loads(kept), score == "cqr", PLAIN[score]
    if kept["cover"] != cover:
        raise ValueError("the target does not match the saved state")
    actuals = [] if actuals is None else actuals
    seen = {a["t"]: (a["y"], bool(a["censored"])) for a in actuals}
    if last >= 0 and (origin <= last or sorted(seen) != list(range(last + 1, origin + 1)) or len(actuals) != len(seen)):
        raise ValueError(f"origin {origin} after {last} needs the {max(origin - last, 0)} periods between")
    given = [] if points is None else [list(p["p"]) if native else float(p["p"][0]) for p in points]
    flat = [x for p in given for x in (p if native else [p])]
    if len(given) != reach or [p["h"] for p in points] != list(range(1, reach + 1)) or not all(x is not None and math.isfinite(x) for x in flat):
        raise ValueError(f"node {node} needs finite points of steps 1 to {reach}")
    methods = [_method(make, c, k) for c, k in enumerate(kept["cells"])]
    still = []
    for wait in kept["waiting"]:
        for t, (y, flag) in seen.items():
            if 1 <= t - wait["origin"] <= reach:
                wait["y"][t - wait["origin"] - 1] = None if y is None or not math.isfinite(y) else float(y)
                wait["censored"][t - wait["origin"] - 1] = flag
        for c, steps in enumerate(cover):
            if wait["issued"][c] is None or wait["origin"] + max(steps) > origin:
                continue
            known = [wait["y"][h - 1] for h in steps]
            if None not in known:
                flag = any(wait["censored"][h - 1] for h in steps)
                _teach(methods[c], sum(known), _point(wait["p"], steps, native), wait["issued"][c], score_of, bound_of, flag)
            wait["issued"][c] = None
        if any(x is not None for x in wait["issued"]):
            still.append(wait)
    issued, out = [], []
    for c, steps in enumerate(cover):
        t, p = methods[c].threshold(), _point(given, steps, native)
        pair = t if isinstance(t, tuple) else (None, t)
        ready = all(math.isfinite(x) for x in pair if x is not None)
        lower, upper = bound_of(p, t)
        issued.append(t)
        out.append({"c": c + 1, "origin": origin, "point": None if native else p, "t_lo": None if pair[0] is None else _finite(pair[0]), "threshold": _finite(pair[1]), "lower": _finite(lower) if ready else None, "upper": _finite(upper) if ready else None, "ready": ready})
    still.append({"origin": origin, "p": given, "y": [None] * reach, "censored": [False] * reach, "issued": issued})
    return node, origin, json.dumps({"cover": cover, "waiting": still, "cells": [_kept(m) for m in methods]}), out


def _teach(method, target: float, point, issued, score_of: Callable, bound_of: Callable, censored: bool) -> None:
    if getattr(method, "by_target", False):
        method.update(target, lambda theta: bound_of(point, theta))
        return
    lower, upper = bound_of(point, tuple(issued) if isinstance(issued, list) else issued)
    missed = not lower <= target <= upper
    if hasattr(method, "update_censored"):
        method.update_censored(score_of(target, point), missed, censored)
    else:
        method.update(score_of(target, point), missed)
