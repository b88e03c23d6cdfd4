"""The rolling driver and the bootstrap against plain loops."""

from fractions import Fraction

import numpy as np
import pytest

from bandwright.operators import covariates, forecast, hierarchy, resample, rolling

T = 30


def values(s):
    return np.random.default_rng(len(s) * 7 + ord(s[0])).integers(0, 40, T).astype(float)


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame([(s, t, float(v)) for s in ("u", "v", "w") for t, v in enumerate(values(s))], "series string, t int, value double").cache()


@pytest.fixture(scope="module")
def edge(spark):
    attrs = spark.createDataFrame([("u", "x"), ("v", "x"), ("w", "y")], "series string, g string")
    return hierarchy.edges(attrs, [["g"]]).cache()


class Refits(rolling.Forecaster):
    """Gives the number of values seen at the fit, so refits show."""

    def fit(self, seen):
        n = float(len(seen.y))
        return rolling.Plain(lambda s: np.full(s.horizon, n)).fit(seen)


def points(done):
    return {(r["node"], r["origin"], r["h"]): r["point"] for r in done.points.collect()}


def test_refits_are_counted_in_origins(panel, edge):
    origins = [5, 9, 10, 14, 20]
    got = points(rolling.rolling_forecasts(panel, edge, Refits(), rolling.IDENTITY, origins, 2, refit_every=2))
    want = {5: 6.0, 9: 6.0, 10: 11.0, 14: 11.0, 20: 21.0}
    assert {k: v for k, v in got.items() if k[0] == "u"} == {("u", o, h): want[o] for o in origins for h in (1, 2)}
    assert len({n for n, _, _ in got}) == edge.select("node").distinct().count()


def test_it_gives_what_the_column_plan_gives(panel, edge):
    season = rolling.Plain(lambda s: s.y[len(s.y) - 4 + (np.arange(s.horizon) % 4)])
    got = points(rolling.rolling_forecasts(panel, edge, season, rolling.BOTTOM_UP, list(range(10, 25)), 6))
    nodes = hierarchy.aggregate(panel, edge)
    want = {(r["node"], r["origin"], r["h"]): r["point"] for r in forecast.seasonal_naive(nodes, 4, 6, 10, 24).collect()}
    assert got == want
    coherent = points(rolling.rolling_forecasts(panel, edge, season, rolling.WLS_STRUCT, [12, 20], 6))
    assert all(coherent[k] == pytest.approx(want[k]) for k in coherent)


def test_a_model_sees_what_is_known_and_no_more(spark, panel, edge):
    ahead = spark.createDataFrame([(t, float(t)) for t in range(T + 3)], "t int, value double")
    past = spark.createDataFrame([(s, t, float(t)) for s in ("u", "v", "w") for t in range(T)], "series string, t int, value double")
    still = spark.createDataFrame([("u", 1.0), ("v", 2.0), ("w", 4.0)], "series string, value double")
    known = {"ahead": covariates.Covariate(ahead, True), "past": covariates.Covariate(past, aggregate="sum"), "still": covariates.Covariate(still, aggregate="sum")}
    model = rolling.Plain(lambda s: np.array([s.x["ahead"][-1], s.x["past"][-1], s.x["still"][0]]))
    got = points(rolling.rolling_forecasts(panel, edge, model, rolling.IDENTITY, [7, 11], 3, covariates=known))
    assert [got["u", 7, h] for h in (1, 2, 3)] == [10.0, 7.0, 1.0] and [got["total", 11, h] for h in (1, 2, 3)] == [14.0, 33.0, 7.0]
    with pytest.raises(ValueError):
        rolling.rolling_forecasts(panel, edge, model, rolling.IDENTITY, [T - 1], 4, covariates=known)


def test_bootstrap_errors_seed_every_node(panel, edge):
    model = rolling.BootstrapEnsemble(2, 8, seed=3)
    done = rolling.rolling_forecasts(panel, edge, model, rolling.BOTTOM_UP, [20, 21], 1, initial_residuals=True)
    seeds = {(r["node"], r["origin"]): r["residual"] for r in done.residuals.collect()}
    plain = {s: dict(model.fit(rolling.Seen(values(s)[:21], {}, 1)).residuals()) for s in ("u", "v", "w")}
    assert set(seeds) == {(n, o) for n in ("u", "v", "w", "g=x", "total") for o in range(1, 20)}
    assert all(seeds["total", o] == pytest.approx(sum(plain[s][o][0] for s in plain)) for o in range(1, 20))
    guess = sum(model.fit(rolling.Seen(values(s)[:21], {}, 1)).predict(rolling.Seen(values(s)[:22], {}, 1))[0] for s in plain)
    assert points(done)["total", 21, 1] == pytest.approx(guess)
    with pytest.raises(ValueError):
        rolling.rolling_forecasts(panel, edge, model, rolling.BOTTOM_UP, [20], 1, refit_every=1, initial_residuals=True)
    with pytest.raises(RuntimeError):
        rolling.BootstrapEnsemble(2, 1, most=1).fit(rolling.Seen(values("u"), {}, 1))


class Native(rolling.Forecaster):
    def fit(self, seen):
        own = rolling.Plain(None).fit(seen)
        own.predict_quantiles = lambda s: tuple(np.full(s.horizon, s.y[-1] + k) for k in (-1.0, 0.0, 1.0))
        return own


def test_native_quantiles_need_identity(panel, edge):
    row = rolling.rolling_forecasts(panel, edge, Native(), rolling.IDENTITY, [6], 2).points.filter("node = 'v' and h = 2").first()
    assert (row["q_lo"], row["point"], row["q_hi"]) == tuple(values("v")[6] + k for k in (-1, 0, 1))
    with pytest.raises(Exception, match="identity"):
        rolling.rolling_forecasts(panel, edge, Native(), rolling.BOTTOM_UP, [6], 2).points.collect()


@pytest.mark.parametrize("origins", [[], [3, 3], [4, 2], [-1], [T], [2.5]])
def test_schedules_that_are_refused(panel, edge, origins):
    with pytest.raises(ValueError):
        rolling.rolling_forecasts(panel, edge, Refits(), rolling.IDENTITY, origins, 1)


def test_regression_reads_covariates_known_ahead(spark, panel, edge):
    wave = spark.createDataFrame([(t, float((t * 5) % 7)) for t in range(T + 3)], "t int, value double")
    rows = [("n", t, 3.0 * ((t * 5) % 7) + 2.0) for t in range(T)]
    own = spark.createDataFrame(rows, "node string, t int, value double")
    flat = spark.createDataFrame([("n", 0, "n")], "node string, level int, series string")
    known = {"wave": covariates.Covariate(wave, True)}
    got = forecast.lag_regression(own, [1], 3, 20, T - 1, covariates=known, edge=flat, ridge=0.0).collect()
    assert all(r["point"] == pytest.approx(3.0 * (((r["origin"] + r["h"]) * 5) % 7) + 2.0, abs=1e-6) for r in got) and len(got) == 30
    with pytest.raises(ValueError):
        forecast.lag_regression(own, [1], 3, 20, T - 1, covariates={"wave": covariates.Covariate(wave)}, edge=flat)


def test_bootstrap_of_circular_blocks(spark):
    draw = np.random.default_rng(8)
    loss = {n: draw.random(24) for n in ("p", "q")}
    rows = [(n, t, float(v)) for n, x in loss.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "node string, place int, loss double")
    folds, block, replicates = [12, 9, 3], 6, 25
    got = {(r["node"], r["replicate"]): r["loss"] for r in resample.block_bootstrap(df, ["node"], "place", "loss", 3, folds, block, replicates, root=True, seed=9).collect()}
    import hashlib

    for n, x in loss.items():
        cycle = x.reshape(8, 3).mean(1)
        for r in range(replicates + 1):
            order = []
            for b in range(4):
                start = int(hashlib.md5(f"9|{r}|{b}".encode()).hexdigest()[:8], 16) % 8
                order += [(start + k) % 8 for k in range(2)]
            own = cycle[order[:8]] if r else cycle
            assert got[n, r] == pytest.approx(np.mean([np.sqrt(own[a:b].mean()) for a, b in ((0, 4), (4, 7), (7, 8))]))
    table = {r["node"]: r for r in resample.summary(resample.block_bootstrap(df, ["node"], "place", "loss", 3, folds, block, replicates, seed=9), ["node"], replicates, "0.8").collect()}
    ranked = {n: sorted(v for (m, r), v in {(q["node"], q["replicate"]): q["loss"] for q in resample.block_bootstrap(df, ["node"], "place", "loss", 3, folds, block, replicates, seed=9).collect()}.items() if m == n and r) for n in loss}
    assert all((table[n]["lower"], table[n]["upper"]) == (ranked[n][2], ranked[n][22]) for n in loss)
    assert resample.percentile_rank(Fraction("0.025"), 200) == 5 and resample.percentile_rank(Fraction("0.001"), 10) == 1
    with pytest.raises(ValueError):
        resample.block_bootstrap(df, ["node"], "place", "loss", 5, folds, 5)
    odd = resample.summary(spark.createDataFrame([("p", 0, 1.0), ("p", 1, None), ("p", 2, 2.0)], "node string, replicate int, loss double"), ["node"], 2).first()
    assert odd["status"] == "not finite" and odd["lower"] is None
