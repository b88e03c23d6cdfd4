"""Rolling-origin forecasts.  Every model sees periods up to the origin only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .covariates import Covariate, at_steps

def schedule(origins, n_periods: int, horizon: int, refit_every: int | None = None) -> list[int]:
    """origins, checked: whole numbers of the panel's periods, strictly increasing."""
    own = list(origins)
    if not own or any(isinstance(o, bool) or int(o) != o for o in own) or any(b <= a for a, b in zip(own, own[1:])):
        raise ValueError("origins must be strictly increasing whole numbers")
    if own[0] < 0 or own[-1] >= n_periods or horizon < 1 or (refit_every is not None and refit_every < 1):
        raise ValueError(f"origins must be periods of 0 to {n_periods - 1}, the horizon and refits at least 1")
    return [int(o) for o in own]


def _origins(panel: DataFrame, first: int, last: int) -> DataFrame:
    return panel.filter(F.col("t").between(first, last)).select("node", F.col("t").alias("origin"))


def seasonal_naive(panel: DataFrame, season: int, horizon: int, first: int, last: int) -> DataFrame:
    """The value one season before the step: y[o - season + 1 + (h - 1) mod season]."""
    if first < season - 1:
        raise ValueError("the first origin needs a whole season")
    grid = _origins(panel, first, last).select("node", "origin", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    grid = grid.withColumn("t", F.col("origin") - season + 1 + (F.col("h") - 1) % season)
    return grid.join(panel.select("node", "t", F.col("value").alias("point")), ["node", "t"]).select("node", "origin", "h", "point")


def window_average(panel: DataFrame, size: int, horizon: int, first: int, last: int) -> DataFrame:
    own = Window.partitionBy("node").orderBy("t").rowsBetween(-(size - 1), 0)
    flat = panel.select("node", F.col("t").alias("origin"), F.avg("value").over(own).alias("point"))
    return flat.filter(F.col("origin").between(first, last)).select("node", "origin", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "point")


def ar1(panel: DataFrame, horizon: int, first: int, last: int, slope_limit: float = 0.99) -> DataFrame:
    """Least squares of y on its last value, over all pairs up to the origin; the slope is clipped.

    Sums are of differences from the series' first value, so a large level does not cancel a small spread.
    """
    step = Window.partitionBy("node").orderBy("t")
    past = step.rowsBetween(Window.unboundedPreceding, 0)
    base = F.first("value").over(past)
    pairs = panel.select("node", "t", base.alias("base"), (F.col("value") - base).alias("y")).withColumn("x", F.lag("y").over(step))
    s = lambda e: F.sum(F.when(F.col("x").isNotNull(), e)).over(past)
    sums = pairs.select("node", "t", "base", "y", s(F.lit(1.0)).alias("n"), s(F.col("x")).alias("sx"), s(F.col("y")).alias("sy"), s(F.col("x") * F.col("y")).alias("sxy"), s(F.col("x") * F.col("x")).alias("sxx"))
    spread, along = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    slope = F.when(spread > 0, F.greatest(F.lit(-slope_limit), F.least(F.lit(slope_limit), along / spread))).otherwise(0.0)
    fit = sums.filter(F.col("t").between(max(first, 2), last)).select("node", F.col("t").alias("origin"), "base", "y", "n", "sx", "sy", slope.alias("phi"))
    mean = (F.col("sy") / F.col("n") - F.col("phi") * F.col("sx") / F.col("n")) / (1 - F.col("phi"))
    steps = fit.select("*", mean.alias("mu"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return steps.select("node", "origin", "h", (F.col("base") + F.col("mu") + F.pow("phi", F.col("h")) * (F.col("y") - F.col("mu"))).alias("point"))


def residuals(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """forecast with `target`, the value of the step's period; NULL where that is not known."""
    future = actual.select("node", (F.col("t")).alias("__t"), F.col("value").alias("target"))
    return forecast.withColumn("__t", F.col("origin") + F.col("h")).join(future, ["node", "__t"], "left").drop("__t")


def history_quantiles(panel: DataFrame, size: int, lo: float, hi: float, horizon: int, first: int, last: int) -> DataFrame:
    """A native quantile forecast: empirical quantiles of the last `size` values, for every step."""
    from ..functions.ranks import empirical_quantile

    if not 0 < lo < hi < 1:
        raise ValueError("quantile levels must satisfy 0 < lo < hi < 1")
    own = Window.partitionBy("node").orderBy("t").rowsBetween(-(size - 1), 0)
    hist = panel.select("node", F.col("t").alias("origin"), F.collect_list("value").over(own).alias("y")).filter(F.col("origin").between(first, last))
    out = hist.select("node", "origin", empirical_quantile(F.col("y"), 0.5).alias("point"), empirical_quantile(F.col("y"), lo).alias("q_lo"), empirical_quantile(F.col("y"), hi).alias("q_hi"))
    return out.select("node", "origin", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "point", "q_lo", "q_hi")


def local_model(panel: DataFrame, model, horizon: int, first: int, last: int) -> DataFrame:
    """Points of any function (values so far, horizon) -> horizon values, called for each series and origin.

    Models that are fitted and kept for several origins go through rolling.rolling_forecasts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")["value"].to_numpy(float)
        rows = [(pdf["node"].iloc[0], o, h + 1, float(p)) for o in range(first, min(last, len(y) - 1) + 1) for h, p in enumerate(model(y[: o + 1], horizon))]
        return pd.DataFrame(rows, columns=["node", "origin", "h", "point"])

    return panel.select("node", "t", "value").groupBy("node").applyInPandas(run, "node string, origin int, h int, point double")


def lag_regression(
    panel: DataFrame, lags: list[int], horizon: int, first: int, last: int, means: tuple[tuple[int, int], ...] = (), covariates: dict[str, Covariate] | None = None, edge: DataFrame | None = None, refit_every: int | None = None, ridge: float = 1e-3
) -> DataFrame:
    """One global linear model on lags, fitted on periods up to `first`, and each refit_every origins later, run forward step by step.

    means: (lag, size), the mean of `size` values that end `lag` periods before the target.  covariates: static ones and
    those known ahead enter with their value in the target's period; calendar features are covariates of t alone.  edge,
    a hierarchy's edges, makes the values of nodes.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    known = covariates or {}
    step = Window.partitionBy("node").orderBy("t")
    depth = max([*lags, *(k + n - 1 for k, n in means)])
    past = F.collect_list("value").over(step.rowsBetween(-(depth - 1), 0))
    inputs = lambda y: [F.element_at(y, -k) for k in lags] + [sum((F.element_at(y, -(k + j)) for j in range(n)), F.lit(0.0)) / n for k, n in means]
    names = [f"x{k}" for k in range(len(lags) + len(means))]
    rows = panel.select("node", F.col("t").alias("origin"), past.alias("y"), F.lead("value").over(step).alias("next")).filter(F.size("y") == depth)

    def with_values(grid: DataFrame) -> DataFrame:
        for name, own in known.items():
            grid = at_steps(grid, own, edge, f"c_{name}")
        return grid

    taught_all = with_values(rows.filter(F.col("next").isNotNull()).withColumn("h", F.lit(1)))
    taught_all = taught_all.select("origin", "next", *[e.alias(n) for e, n in zip(inputs(F.col("y")), names)], *[f"c_{n}" for n in known]).dropna()
    assemble = VectorAssembler(inputCols=[*names, *[f"c_{n}" for n in known]], outputCol="x")
    issued = rows.filter(F.col("origin").between(first, last)).select("node", "origin", "y")
    if known:
        grid = with_values(issued.select("node", "origin", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")))
        ahead = grid.groupBy("node", "origin").agg(F.array_sort(F.collect_list(F.struct("h", *[f"c_{n}" for n in known]))).alias("ahead"))
        issued = issued.join(ahead, ["node", "origin"])
    out, starts = None, [first] if refit_every is None else list(range(first, last + 1, refit_every))
    for at, after in zip(starts, [*starts[1:], last + 1]):
        model = LinearRegression(featuresCol="x", labelCol="next", regParam=ridge).fit(assemble.transform(taught_all.filter(F.col("origin") < at)))
        weight, base = [float(w) for w in model.coefficients], float(model.intercept)
        state = issued.filter(F.col("origin").between(at, after - 1))
        for h in range(horizon):
            values = inputs(F.col("y")) + [F.col("ahead")[h][f"c_{n}"] for n in known]
            state = state.withColumn("y", F.concat("y", F.array(sum((v * w for v, w in zip(values, weight)), F.lit(base)))))
        part = state.select("node", "origin", F.posexplode(F.slice("y", -horizon, horizon)).alias("h", "point")).withColumn("h", F.col("h") + 1)
        out = part if out is None else out.unionByName(part)
    return out


def global_model(
    panel: DataFrame, fit, horizon: int, first: int, last: int, refit_every: int | None = None, fit_periods: int = 365, lookback: int = 84, most: int = 1000, outputs: tuple[str, ...] = ("point",), seed: int = 0
) -> DataFrame:
    """(node, origin, h, outputs...) of one model for all series, from any library.

    fit(frame of node, t, value) gives predict(values so far, horizon) -> [horizon] or [horizon, outputs].  It is
    called at the first origin and, if refit_every is set, each so many origins later, with the last fit_periods
    periods up to that origin of at most `most` series, chosen by hash: that bounds what the driver holds.  Every
    series is forecast, on the executors, from its last `lookback` values.  Points must be finite.
    """
    if min(horizon, fit_periods, lookback, most) < 1 or (refit_every is not None and refit_every < 1):
        raise ValueError("horizon, periods, lookback, series and refits must be at least 1")
    chosen = panel.select("node").distinct().orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(most)
    starts = [first] if refit_every is None else list(range(first, last + 1, refit_every))
    schema = "node string, origin int, h int, " + ", ".join(f"{n} double" for n in outputs)

    def runner(predict, at: int, after: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            t, y, rows = pdf["t"].to_numpy(), pdf["value"].to_numpy(float), []
            for o in t[(t >= at) & (t < after)]:
                guess = np.asarray(predict(y[(t <= o) & (t > o - lookback)], horizon), float)
                if guess.size != horizon * len(outputs) or len(guess) != horizon or not np.isfinite(guess).all():
                    raise ValueError(f"the model gave {guess.shape} for {horizon} steps of {len(outputs)}, or values that are not finite")
                rows += [(pdf["node"].iloc[0], int(o), h + 1, *map(float, g)) for h, g in enumerate(guess.reshape(horizon, -1))]
            return pd.DataFrame(rows, columns=["node", "origin", "h", *outputs])

        return run

    every = None
    for at, after in zip(starts, [*starts[1:], last + 1]):
        taught = panel.filter(F.col("t").between(at - fit_periods + 1, at)).join(F.broadcast(chosen), "node", "left_semi")
        predict = fit(taught.select("node", "t", "value").orderBy("node", "t").toPandas())
        span = panel.filter(F.col("t").between(at - lookback + 1, after - 1)).select("node", "t", "value")
        part = span.groupBy("node").applyInPandas(runner(predict, at, after), schema)
        every = part if every is None else every.unionByName(part)
    return every


def lag_network(n_lags: int, horizon: int, hidden: int = 16, steps: int = 400, rate: float = 0.01, quantiles: tuple[float, ...] = (0.5,), seed: int = 0):
    """A fit function for global_model: one hidden layer on the last n_lags values, all steps at once, by pinball loss.

    Windows are scaled by their mean size.  Quantile outputs of a step are put in order.  Batches are seeded.
    """
    q = np.asarray(quantiles, float)

    def scale(x):
        return np.maximum(np.abs(x).mean(-1, keepdims=True), 1e-8)

    def fit(frame: pd.DataFrame):
        windows = []
        for _, own in frame.groupby("node", sort=True):
            y = own["value"].to_numpy(float)
            if len(y) >= n_lags + horizon:
                windows.append(np.lib.stride_tricks.sliding_window_view(y, n_lags + horizon))
        if not windows:
            raise ValueError("no series is long enough for a window")
        rows = np.concatenate(windows)
        size = scale(rows[:, :n_lags])
        x, y = rows[:, :n_lags] / size, rows[:, n_lags:, None] / size[..., None]
        draw = np.random.default_rng(seed)
        out = horizon * len(q)
        layers = [draw.normal(0, n_lags**-0.5, (n_lags, hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, (hidden, out)), np.zeros(out)]
        first, second = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
        for k in range(1, steps + 1):
            at = draw.integers(0, len(x), 128)
            h = np.maximum(x[at] @ layers[0] + layers[1], 0)
            error = y[at] - (h @ layers[2] + layers[3]).reshape(-1, horizon, len(q))
            slope = np.where(error > 0, -q, 1 - q).reshape(len(at), out) / len(at)
            back = (slope @ layers[2].T) * (h > 0)
            for i, g in enumerate((x[at].T @ back, back.sum(0), h.T @ slope, slope.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.999**k)) + 1e-8)

        def predict(values: np.ndarray, ahead: int) -> np.ndarray:
            if ahead != horizon or len(values) < n_lags:
                raise ValueError(f"the network reads {n_lags} values and gives {horizon} steps")
            last = np.asarray(values[-n_lags:], float)
            h = np.maximum(last / scale(last) @ layers[0] + layers[1], 0)
            return np.sort((h @ layers[2] + layers[3]).reshape(horizon, len(q)), axis=1) * scale(last)

        return predict

    return fit
