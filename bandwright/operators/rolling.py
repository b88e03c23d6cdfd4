"""One call from a model to reconciled points: schedule, fits and refits, covariates, seeds and native quantiles."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import covariates as cov
from . import hierarchy
from .forecast import schedule

IDENTITY, BOTTOM_UP, WLS_STRUCT = "identity", "bottom up", "wls struct"


@dataclass(frozen=True)
class Seen:
    """What a model of one series sees at an origin: its values through the origin, and each covariate's visible ones.

    x: one value of a static covariate, values through the origin of a historical one, through the horizon of one known ahead.
    """

    y: np.ndarray
    x: dict[str, np.ndarray]
    horizon: int


class Fitted(ABC):
    """A fitted model.  It may also have residuals() -> [(origin, errors of the steps)], and predict_quantiles(seen) -> (low, point, high)."""

    @abstractmethod
    def predict(self, seen: Seen) -> np.ndarray: ...


class Forecaster(ABC):
    """fit(seen) gives a Fitted and leaves the forecaster as it was."""

    @abstractmethod
    def fit(self, seen: Seen) -> Fitted: ...


@dataclass(frozen=True)
class Forecasts:
    """points (node, origin, h, point, and q_lo, q_hi of native quantiles); residuals (node, origin, h, residual) of the fit, or None."""

    points: DataFrame
    residuals: DataFrame | None


class _Plain(Fitted):
    def __init__(self, guess: Callable[[Seen], np.ndarray]):
        self.guess = guess

    def predict(self, seen: Seen) -> np.ndarray:
        return self.guess(seen)


class Plain(Forecaster):
    """Any function of what is seen, with nothing to fit."""

    def __init__(self, guess: Callable[[Seen], np.ndarray]):
        self.guess = guess

    def fit(self, seen: Seen) -> Fitted:
        return _Plain(self.guess)


def ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> Callable[[np.ndarray], np.ndarray]:
    """Least squares with an intercept and a small penalty."""
    a = np.hstack([np.ones((len(x), 1)), x])
    coef = np.linalg.solve(a.T @ a + penalty * np.eye(a.shape[1]), a.T @ y)
    return lambda z: np.hstack([np.ones((len(z), 1)), z]) @ coef


class _Bagged(Fitted):
    def __init__(self, learners, weight: np.ndarray, lags: int, seeds: list):
        self.learners, self.weight, self.lags, self.seeds = learners, weight, lags, seeds

    def predict(self, seen: Seen) -> np.ndarray:
        z = seen.y[None, -self.lags :]
        return np.array([self.weight @ np.array([f(z)[0] for f in self.learners])])

    def residuals(self) -> list:
        return self.seeds


class BootstrapEnsemble(Forecaster):
    """One-step learners on resampled rows of the last n_lags values, with out-of-bag errors.

    learn(x, y) gives a function of x.  The same rows are drawn for every series.  Bags are drawn until every row is left
    out of one; after max(4 estimators, estimators + 20) of them, or `most`, that is an error.  A learner weighs as much as
    its part in the out-of-bag means.
    """

    def __init__(self, n_lags: int, estimators: int = 20, seed: int = 0, learn=ridge, most: int | None = None):
        if n_lags < 1 or estimators < 1 or (most is not None and most < estimators):
            raise ValueError("lags and estimators must be at least 1, and the most bags at least the estimators")
        self.n_lags, self.estimators, self.seed, self.learn = n_lags, estimators, seed, learn
        self.most = most or max(4 * estimators, estimators + 20)

    def fit(self, seen: Seen) -> Fitted:
        if seen.horizon != 1 or seen.x:
            raise ValueError("the ensemble forecasts one step, without covariates")
        if len(seen.y) <= self.n_lags + 1:
            raise ValueError("the series is too short for its lags")
        x = np.lib.stride_tricks.sliding_window_view(seen.y, self.n_lags)[:-1]
        y = seen.y[self.n_lags :]
        draw, m, bags = np.random.default_rng(self.seed), len(y), []
        left = np.zeros((0, m), bool)
        while len(bags) < self.estimators or not left.any(0).all():
            if len(bags) >= self.most:
                raise RuntimeError("some row is in every bag")
            bags.append(np.sort(draw.integers(0, m, m)))
            left = np.vstack([left, np.bincount(bags[-1], minlength=m) == 0])
        learners = [self.learn(x[b], y[b]) for b in bags]
        guess = np.stack([f(x) for f in learners])
        error = y - (guess * left).sum(0) / left.sum(0)
        seeds = [(self.n_lags - 1 + k, [float(e)]) for k, e in enumerate(error)]
        return _Bagged(learners, (left / left.sum(0)).mean(1), self.n_lags, seeds)


def rolling_forecasts(
    panel: DataFrame,
    edge: DataFrame,
    model: Forecaster,
    reconciler: str,
    origins: list[int],
    horizon: int,
    refit_every: int | None = None,
    covariates: dict[str, cov.Covariate] | None = None,
    initial_residuals: bool = False,
) -> Forecasts:
    """Points of every node at each origin, from a panel (series, t, value) and a hierarchy's edges.

    bottom up: the model runs on the series and nodes are sums; identity and wls struct: it runs on every node.  It is
    fitted at the first origin and again each refit_every origins, counted in the list.  initial_residuals: the first
    fit's errors, reconciled alike; they need a model that is fitted once.  Native quantiles need identity.  Calendar
    covariates, one row a period, are read to the driver; other values reach their series by a join.
    """
    if reconciler not in (IDENTITY, BOTTOM_UP, WLS_STRUCT):
        raise ValueError(f"no reconciler {reconciler}")
    if initial_residuals and refit_every is not None:
        raise ValueError("initial residuals need a model that is fitted once")
    periods = panel.agg(F.max("t")).first()[0]
    origins = schedule(origins, 0 if periods is None else periods + 1, horizon, refit_every)
    known = covariates or {}
    for own in known.values():
        cov.check(own, panel, origins[-1], horizon)
    leaf = edge if reconciler != BOTTOM_UP else edge.filter("level = 0")
    rows = hierarchy.aggregate(panel, leaf).select("node", F.lit("").alias("name"), "t", "value")
    shared: dict[str, np.ndarray] = {}
    for name, own in known.items():
        values = cov.on_nodes(own, leaf)
        if own.shared:
            need = origins[-1] + 1 + (horizon if own.known_ahead else 0)
            shared[name] = np.array([r["value"] for r in values.filter(F.col("t") < need).orderBy("t").collect()], float)
        else:
            at = F.lit(0) if own.static else F.col("t")
            rows = rows.union(values.select("node", F.lit(name), at, "value"))
    reach = {name: None if own.static else horizon if own.known_ahead else 0 for name, own in known.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].iloc[0]
        columns = {k: g.sort_values("t")["value"].to_numpy(float) for k, g in pdf.groupby("name")}
        y, x = columns.pop(""), {**shared, **columns}
        out, fitted, native = [], None, None
        for index, o in enumerate(origins):
            seen = Seen(y[: o + 1], {k: v if reach[k] is None else v[: o + 1 + reach[k]] for k, v in x.items()}, horizon)
            if fitted is None or (refit_every is not None and index % refit_every == 0):
                fitted = model.fit(seen)
                own = hasattr(fitted, "predict_quantiles")
                if native is not None and own != native:
                    raise ValueError("refits must keep the kind of forecast")
                native = own
                if native and (reconciler != IDENTITY or initial_residuals):
                    raise ValueError("native quantiles need identity, and have no initial residuals")
                if initial_residuals:
                    if not hasattr(fitted, "residuals"):
                        raise TypeError("the model has no residuals")
                    for u, errors in fitted.residuals():
                        if len(errors) != horizon or u + horizon > o:
                            raise ValueError("residuals must be of all steps, and known at the first origin")
                        out += [(node, u, h + 1, None, None, None, None if not np.isfinite(e) else float(e)) for h, e in enumerate(errors)]
            lo, point, hi = fitted.predict_quantiles(seen) if native else (None, fitted.predict(seen), None)
            point = np.asarray(point, float)
            if point.shape != (horizon,) or not np.isfinite(point).all():
                raise ValueError(f"the model gave {point.shape} at origin {o}, or points that are not finite")
            out += [(node, o, h + 1, float(point[h]), float(lo[h]) if native else None, float(hi[h]) if native else None, None) for h in range(horizon)]
        return pd.DataFrame(out, columns=["node", "origin", "h", "point", "q_lo", "q_hi", "residual"], dtype=object)

    made = rows.groupBy("node").applyInPandas(run, "node string, origin int, h int, point double, q_lo double, q_hi double, residual double")
    issued = made.filter("point is not null").select("node", "origin", "h", "point", "q_lo", "q_hi")
    errors = made.filter("point is null").select("node", "origin", "h", F.col("residual").alias("point"))
    seeds = _reconciled(errors, edge, reconciler).withColumnRenamed("point", "residual") if initial_residuals else None
    return Forecasts(issued if reconciler == IDENTITY else _reconciled(issued.select("node", "origin", "h", "point"), edge, reconciler), seeds)


def _reconciled(base: DataFrame, edge: DataFrame, reconciler: str) -> DataFrame:
    if reconciler == BOTTOM_UP:
        return hierarchy.bottom_up(base.withColumnRenamed("node", "series"), edge)
    return base if reconciler == IDENTITY else hierarchy.wls_struct(base, edge)
