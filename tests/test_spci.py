"""SPCI against forests grown whole, and the registered query's cells."""

import inspect

import numpy as np
import pytest

from bandwright.operators import calibrate
from bandwright.plans import catalog


def leaf_of(x, y, bag, rows, query, level, leaf):
    """The training rows in the query's leaf of a tree; rows are those that came this far."""
    drawn = [r for r in rows if bag[r]]
    if level == 0 or len({y[r] for r in drawn}) < 2:
        return rows
    best = None
    for f in range(x.shape[1]):
        values = sorted({x[r, f] for r in drawn})
        for low, high in zip(values, values[1:]):
            sides = [[r for r in drawn if (x[r, f] <= low) == s] for s in (True, False)]
            if min(map(len, sides)) < leaf:
                continue
            gain = sum(sum(bag[r] * y[r] for r in s) ** 2 / sum(bag[r] for r in s) for s in sides)
            if best is None or gain > best[0] * (1 + 1e-12):
                best = (gain, f, (low + high) / 2)
    if best is None:
        return rows
    _, f, at = best
    return leaf_of(x, y, bag, [r for r in rows if (x[r, f] <= at) == (query[f] <= at)], query, level - 1, leaf)


@pytest.mark.parametrize("seed", range(6))
def test_leaf_shares_are_those_of_whole_trees(seed):
    draw = np.random.default_rng(seed)
    x, y = draw.normal(size=(40, 3)), draw.normal(size=40)
    x[:, 1] = np.round(x[:, 1])
    query, bags = draw.normal(size=3), np.stack([np.bincount(draw.integers(0, 40, 40), minlength=40) for _ in range(12)])
    expected = np.zeros(40)
    for bag in bags:
        rows = leaf_of(x, y, bag, list(range(40)), query, 4, 3)
        expected[rows] += 1 / len(rows) / len(bags)
    np.testing.assert_allclose(calibrate.leaf_shares(x, y, query, bags, 4, 3), expected)


def test_one_leaf_gives_the_empirical_interval(spark):
    e = np.random.default_rng(1).normal(size=60)
    rows = [(n, c, c, o, float(e[o] * c)) for n in ("a", "b") for c in (1, 2) for o in range(60)]
    issues = spark.createDataFrame(rows, "node string, c int, last_step int, origin int, score double")
    got = {(r["node"], r["c"], r["origin"]): r for r in calibrate.spci(issues, 0.8, 30, 2, least=5, trees=3, leaf=1000).collect()}
    assert len(got) == len(rows)
    for (_, c, o), r in got.items():
        known = [(u, e[u] * c) for u in range(60) if u + c <= o][-30:]
        y = sorted(v for u, v in known if sum(w + c <= u for w, _ in known) >= 2)
        assert r["ready"] == (len(y) >= 5 and len(known) >= 7)
        if r["ready"]:
            at = lambda q: y[min(max(int(np.ceil(len(y) * q)) - 1, 0), len(y) - 1)]
            options = [(at(0.8 + b) - at(b), k, at(b), at(0.8 + b)) for k, b in enumerate(np.linspace(0, 1, 21) * (1 - 0.8))]
            assert (r["t_lo"], r["t_hi"]) == pytest.approx(min(options)[2:])


def test_query_gives_every_node_and_step(spark, monkeypatch):
    assert inspect.signature(calibrate.spci).parameters["trees"].default == 100
    monkeypatch.setattr(calibrate, "spci", lambda issues, *_: issues.selectExpr("*", "true AS ready", "0D AS t_lo", "0D AS t_hi"))
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in catalog.spci_interval(spark, sf).select("node", "c", "origin").collect()}
    assert got == {tuple(r) for r in catalog.residuals(spark, sf).select("node", "h", "origin").collect()}
