"""Worked-out values of rank rules, feedback delays, decisions, metrics and reconciliation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bandwright.functions import ranks, scores
from bandwright.operators import calibrate, decision, forecast, hierarchy, metrics
from bandwright.sources import panel

ISSUES = "node string, c int, last_step int, origin int, point double, target double, score double"


def one(spark, **columns):
    kinds = ", ".join(f"{k} array<double>" for k in columns)
    return spark.createDataFrame([tuple(columns.values())], kinds)


def test_rank_rules(spark):
    df = one(spark, s=[float(k) for k in range(28, 0, -2)], none=[])
    s, none = F.col("s"), F.col("none")
    lo, hi = ranks.empirical_interval(s, 0.5, 3)
    row = df.select(
        ranks.score_quantile(s, 0.8).alias("a"), ranks.score_quantile(s, 0.95).alias("b"), ranks.score_quantile(none, 0.5).alias("c"),
        ranks.empirical_quantile(s, 0.0).alias("d"), ranks.empirical_quantile(s, 1.0).alias("e"), ranks.recency_quantile(s, 0.8, 1.0).alias("f"), lo.alias("lo"), hi.alias("hi"),
    ).first()
    assert tuple(row) == (24.0, None, None, 2.0, 28.0, 24.0, 2.0, 14.0)
    with pytest.raises(ValueError):
        ranks.score_quantile(s, 1.0)
    with pytest.raises(ValueError):
        ranks.recency_quantile(s, 0.7, 0.6)


def test_scores_are_known_when_their_last_step_is(spark):
    origins, steps = (40, 41, 45, 52, 60), (1, 9, 16, 20, 21)
    issues = spark.createDataFrame([("n", c, c, o, 0.0, 1.0, 1.0) for c in steps for o in origins], ISSUES)
    got = {r["c"]: r["n"] for r in calibrate.with_history(issues, 30).filter("origin = 60").select("c", F.size("hist").alias("n")).collect()}
    assert got == {c: sum(u + c <= 60 for u in origins) for c in steps} == {1: 4, 9: 3, 16: 2, 20: 1, 21: 0}


def test_later_scores_do_not_change_earlier_issues(spark):
    def thresholds(change):
        rows = [("n", 1, 2, o, 0.0, 1.0, float(o * 7 % 13) + (100 if o >= 20 and change else 0)) for o in range(30)]
        return {r["origin"]: r["threshold"] for r in calibrate.split(spark.createDataFrame(rows, ISSUES), 0.8, 8).collect()}

    a, b = thresholds(False), thresholds(True)
    assert all(a[o] == b[o] for o in range(22)) and a != b


def test_methods_that_read_their_own_bounds():
    t = calibrate.Tracker(0.75, 2.0, 5.0)
    bounds = []
    for missed in (True, False, False):
        t.update(1.0, missed)
        bounds.append(t.threshold())
    assert bounds == [6.5, 6.0, 5.5]
    a = calibrate.Adaptive(0.8, 0.5, 10)
    a.update(3.0, True)
    assert a.work == pytest.approx(1.2) and a.threshold() == float("inf")
    a.update(3.0, False)
    assert a.work == pytest.approx(1.1)
    with pytest.raises(ValueError):
        calibrate.ConformalPID(0.7).update(1.0, True)


def test_misses_are_those_of_the_issued_bounds(spark):
    rows = [("n", 1, 1, o, 10.0, 10.0 - (o % 3), -float(o % 3)) for o in range(12)]
    got = calibrate.fold(spark.createDataFrame(rows, ISSUES), lambda: calibrate.Tracker(0.5, 1.0, 0.0), "signed").orderBy("origin").collect()
    theta, want = 0.0, []
    for r in rows:
        want.append(theta)
        theta += (r[5] > r[4] + theta) - 0.5  # one-sided: a low target is no miss
    assert [r["threshold"] for r in got] == want


def test_settlement(spark):
    df = spark.createDataFrame([(7.5, [2.5, 4.0, 1.0], 6.0, 3.0), (1.0, [0.5, 0.0, 2.0], 9.25, 0.0)], "stock double, pipe array<double>, demand double, ordered double")
    settled = decision.settle(F.col("stock"), F.col("pipe"), F.col("demand"), F.col("ordered"), 0.5, 2.0)
    got = df.select(settled.alias("s")).select("s.arrivals", "s.sales", "s.missed", "s.end_inventory", "s.holding_cost", "s.shortage_cost", "s.pipeline").collect()
    assert [tuple(r) for r in got] == [(2.5, 6.0, 0.0, 4.0, 2.0, 0.0, [4.0, 1.0, 3.0]), (0.5, 1.5, 7.75, 0.0, 0.0, 15.5, [0.0, 2.0, 0.0])]
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            df.withColumn("demand", F.lit(bad).cast("double")).select(settled.alias("s")).collect()
    bound = df.select(decision.order_up_to(F.lit(17.0), F.col("stock"), F.col("pipe"))).collect()
    assert [r[0] for r in bound] == [2.0, 13.5]


def test_metrics(spark):
    y = spark.createDataFrame([(12.5,), (9.0,), (None,), (20.0,), (14.0,)], "y double").select("y", F.lit(10.0).alias("lo"), F.lit(18.0).alias("hi"))
    c = F.col
    row = y.agg(metrics.coverage(c("y"), c("lo"), c("hi")), metrics.width(c("y"), c("lo"), c("hi")), metrics.interval_score(c("y"), c("lo"), c("hi"), 0.8), metrics.pinball(c("y"), c("hi"), 0.75), metrics.newsvendor_cost(c("y"), c("hi"), 1.0, 4.0)).first()
    assert tuple(row) == pytest.approx((0.5, 8.0, 15.5, 1.53125, (5.5 + 9.0 + 8.0 + 4.0) / 4))


def test_hierarchy_leaves_out_what_is_already_there(spark):
    rows = [("s1", "north", "p"), ("s2", "north", "q"), ("s3", "south", "q"), ("s4", "south", "r"), ("s5", "south", "r"), ("s6", "north", "q")]
    edge = hierarchy.edges(spark.createDataFrame(rows, "series string, plant string, line string"), [["plant"], ["line"], ["plant", "line"]])
    got = [(r["idx"], r["node"], r["n_leaves"]) for r in hierarchy.nodes(edge).orderBy("idx").collect()]
    want = [*[(f"s{k}", 1) for k in range(1, 7)], ("plant=north", 3), ("plant=south", 3), ("line=q", 3), ("line=r", 2), ("plant=north/line=q", 2), ("total", 6)]
    assert got == [(k, n, m) for k, (n, m) in enumerate(want)]


@pytest.mark.parametrize("bottoms, groups", [(30, 4), (400, 37)])
def test_reconciliation_is_the_dense_solution(spark, bottoms, groups):
    draw = np.random.default_rng(bottoms)
    attrs = [(f"b{k}", f"g{draw.integers(groups)}", f"k{draw.integers(3)}") for k in range(bottoms)]
    edge = hierarchy.edges(spark.createDataFrame(attrs, "series string, g string, k string"), [["g"], ["k"]])
    pairs = [(r["node"], r["series"]) for r in edge.filter("level > 0").collect()]
    upper = sorted({n for n, _ in pairs})
    under = np.zeros((len(upper), bottoms))
    for n, s in pairs:
        under[upper.index(n), int(s[1:])] = 1
    base = draw.normal(100, 30, bottoms + len(upper))
    w, j = np.concatenate([np.ones(bottoms), under.sum(1)]), np.hstack([under, -np.eye(len(upper))])
    want = base - w * (j.T @ np.linalg.solve((j * w) @ j.T, j @ base))
    names = [f"b{k}" for k in range(bottoms)] + upper
    given = spark.createDataFrame([(n, 5, 1, float(v)) for n, v in zip(names, base)], "node string, origin int, h int, point double")
    got = {r["node"]: r["point"] for r in hierarchy.wls_struct(given, edge).collect()}
    assert np.allclose([got[n] for n in names], want, atol=1e-8)
    with pytest.raises(Exception, match="base point"):
        hierarchy.wls_struct(given.filter("node <> 'total'"), edge).collect()
    with pytest.raises(ValueError):
        hierarchy.wls_struct(given, edge, most_edges=3)


def test_ar1_does_not_depend_on_the_level(spark):
    y = [3.0, 8.0, 4.0, 9.0, 2.0, 7.0, 7.5, 1.0]
    at = lambda shift: [r["point"] - shift for r in forecast.ar1(spark.createDataFrame([("n", t, v + shift) for t, v in enumerate(y)], "node string, t int, value double"), 2, 4, 7).orderBy("origin", "h").collect()]
    assert np.allclose(at(0.0), at(1e9), atol=1e-4)
    x, z = np.array(y[:-1]), np.array(y[1:])
    phi, c = np.polyfit(x, z, 1)
    assert at(0.0)[-2] == pytest.approx(phi * y[-1] + c)


def test_panel_rules(spark):
    good = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("b", 2, 4.0)], "series string, period int, value double")
    assert {r["t"] for r in panel.from_long(good).collect()} == {0, 1}
    with pytest.raises(ValueError):
        panel.from_long(good.limit(3))
    days = good.select("series", F.date_add(F.lit("2024-03-01").cast("date"), F.col("period") * 2).alias("period"), "value")
    assert panel.from_long(days, step="2 days").count() == 4
    with pytest.raises(ValueError):
        panel.from_long(days, step="1 day")


def test_scaling_masks_and_folds(spark):
    rows = [("a", t, float(v)) for t, v in enumerate((2, 4, 100))] + [("b", t, 5.0) for t in range(3)]
    p = spark.createDataFrame(rows, "series string, t int, value double")
    spec = panel.scaling(p, 2)
    got = {(r["series"], r["t"]): r["value"] for r in panel.scaled(p, spec).collect()}
    assert got == {("a", 0): -1.0, ("a", 1): 1.0, ("a", 2): 97.0, ("b", 0): 0.0, ("b", 1): 0.0, ("b", 2): 0.0}
    assert sorted(map(tuple, panel.restored(panel.scaled(p, spec), spec).select("series", "t", "value").collect())) == sorted(rows)
    assert panel.folds(20, 2, 4, 3, 5) == [(0, 4, 9, 12, 16), (1, 8, 13, 16, 20)]
    with pytest.raises(ValueError):
        panel.folds(20, 2, 4, 3, 10)
    masked = p.select(scores.mask(F.col("value"), F.col("value") > 50).alias("v"), F.lit(0.0).alias("u")).collect()
    assert sum(r["v"] is None for r in masked) == 1
    loss = spark.createDataFrame([(1.0, -0.5), (0.0, -0.5), (1.0, 0.5)], "e double, u double").select(scores.selective_loss(F.col("e"), F.col("u"), 0.2)).collect()
    assert [r[0] for r in loss] == pytest.approx([1.0, 0.0, 0.2])


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
