"""Thresholds from delayed out-of-sample scores.

issues: (node, c, last_step, origin, point, target, score...).  A score of origin u is known at u + last_step and
may be used by origins from there on.  Methods that do not look at their own bounds are one window plan over the
events of (node, c): what became known, then what is issued.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranks
from ..functions.scores import PLAIN


def check_window(window: int, capacity: int | None = None) -> None:
    if isinstance(window, bool) or window < 1 or (capacity is not None and capacity < window):
        raise ValueError("the window must be at least 1 and the capacity at least the window")


def with_history(issues: DataFrame, window: int, score: str = "score", key: tuple[str, ...] = ("node", "c"), seeds: DataFrame | None = None) -> DataFrame:
    """issues with `hist`, the last `window` finite scores known at the origin, oldest first, and `n_known`, how many are known.

    score may be an array: rows of a pool's scores.  seeds (key, k, score) come before all else, in order of k.
    One exchange on the key serves the whole plan.
    """
    check_window(window)
    keys = list(key)
    events = F.array(
        F.struct((F.col("origin") + F.col("last_step")).alias("at"), F.lit(0).alias("kind"), F.col("origin").alias("u")),
        F.struct(F.col("origin").alias("at"), F.lit(1).alias("kind"), F.col("origin").alias("u")),
    )
    rows = issues.repartition(*keys).select("*", F.inline(events))
    rows = rows.filter((F.col("kind") == 1) | F.col(score).isNotNull())
    if seeds is not None:
        rows = rows.unionByName(seeds.select(*keys, score, F.lit(-(1 << 30)).alias("at"), F.lit(0).alias("kind"), F.col("k").cast("int").alias("u")), allowMissingColumns=True)
    recent = Window.partitionBy(*keys, "kind").orderBy("at", "u").rowsBetween(-(window - 1), 0)
    rows = rows.withColumn("__h", F.when(F.col("kind") == 0, F.collect_list(score).over(recent)))
    seen = Window.partitionBy(*keys).orderBy("at", "kind", "u").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hist", F.last("__h", ignorenulls=True).over(seen)).withColumn("n_known", F.sum((F.col("kind") == 0).cast("long")).over(seen))
    empty = F.array().cast(rows.schema["__h"].dataType)
    return rows.filter("kind = 1").withColumn("hist", F.coalesce("hist", empty)).drop("__h", "at", "kind", "u")


def split(issues: DataFrame, level: float | Column, window: int, seeds: DataFrame | None = None) -> DataFrame:
    """issues with `threshold`: the conformal rank of the last scores; level may be a column, one for each node."""
    return with_history(issues, window, seeds=seeds).withColumn("threshold", ranks.score_quantile(F.col("hist"), level))


def split_pooled(issues: DataFrame, pools: DataFrame, level: float, window: int) -> DataFrame:
    """As split, with the scores of all nodes of a pool (node, pool): the last `window` origins with a score in it."""
    rows = issues.join(pools, "node")
    pooled = rows.groupBy("pool", "c", "last_step", "origin").agg(F.collect_list("score").alias("scores"))
    pooled = pooled.withColumn("scores", F.when(F.size("scores") > 0, F.col("scores")))
    known = with_history(pooled, window, "scores", ("pool", "c"))
    known = known.select("pool", "c", "origin", ranks.score_quantile(F.flatten("hist"), level).alias("threshold"))
    return rows.join(known, ["pool", "c", "origin"])


def split_capacity(issues: DataFrame, level: float, window: int, capacity: int) -> DataFrame:
    """As split, where only the last `capacity` origins with any known column are stored, for all columns alike."""
    check_window(window, capacity)
    least = issues.agg(F.min("last_step")).first()[0]
    own = Window.partitionBy("node", "c").orderBy("origin")
    numbered = issues.withColumn("idx", F.row_number().over(own)).withColumn("newest", F.count(F.lit(1)).over(own.rangeBetween(Window.unboundedPreceding, -least)))
    pairs = numbered.withColumn("pair", F.when(F.col("score").isNotNull(), F.struct("idx", "score")))
    known = with_history(pairs, window, "pair")
    kept = F.filter("hist", lambda x: x["idx"] > F.col("newest") - capacity)
    return known.withColumn("threshold", ranks.score_quantile(F.transform(kept, lambda x: x["score"]), level))


def nexcp(issues: DataFrame, level: float, rho: float, window: int, seeds: DataFrame | None = None) -> DataFrame:
    return with_history(issues, window, seeds=seeds).withColumn("threshold", ranks.recency_quantile(F.col("hist"), level, rho))


def enbpi(issues: DataFrame, level: float, window: int, grid: int = 21, seeds: DataFrame | None = None) -> DataFrame:
    """issues with `t_lo`, `t_hi`: the shortest interval of the last signed errors."""
    known = with_history(issues, window, seeds=seeds)
    lo, hi = ranks.empirical_interval(F.col("hist"), level, grid)
    return known.withColumn("__b", F.struct(lo.alias("t_lo"), hi.alias("t_hi"))).select(*known.columns, "__b.*")


def risk_control(issues: DataFrame, grid: list[float], alpha: float, loss, maximum: float = 1.0) -> DataFrame:
    """issues with `threshold`: the least grid value with (sum of losses + maximum) <= alpha (n + 1) over all known targets."""
    if not 0 < alpha < maximum or list(grid) != sorted(set(grid)) or not all(map(math.isfinite, grid)):
        raise ValueError("alpha must be in (0, maximum) and the grid finite and increasing")
    keys = ["node", "c"]
    tried = issues.withColumn("theta", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn("loss", F.when(F.col("target").isNotNull(), loss(F.col("theta"))))
    own = Window.partitionBy(*keys, "theta")
    events = F.array(F.struct((F.col("origin") + F.col("last_step")).alias("at"), F.lit(0).alias("kind")), F.struct(F.col("origin").alias("at"), F.lit(1).alias("kind")))
    rows = tried.select("*", F.inline(events)).filter("kind = 1 or loss is not null")
    seen = own.orderBy("at", "kind", "origin").rowsBetween(Window.unboundedPreceding, 0)
    fed = lambda e: F.coalesce(F.sum(F.when(F.col("kind") == 0, e)).over(seen), F.lit(0.0))
    rows = rows.withColumn("risk", fed(F.col("loss"))).withColumn("n", fed(F.lit(1.0))).filter("kind = 1")
    best = rows.groupBy(*keys, "origin").agg(F.min(F.when(F.col("risk") + maximum <= alpha * (F.col("n") + 1), F.col("theta"))).alias("threshold"), F.max("n").cast("long").alias("n_known"))
    return issues.join(best, [*keys, "origin"])


# Methods that read their own issued bounds: an ordered fold for each (node, c).


# Each names in STATE what it must keep between calls.


class Tracker:
    """theta += rate (miss - (1 - level))."""

    STATE = ("theta",)

    def __init__(self, level: float, rate: float, start: float = 0.0):
        if not 0 < level < 1 or rate <= 0:
            raise ValueError("level must be in (0, 1) and the rate positive")
        self.level, self.rate, self.theta = level, rate, start

    def update(self, score: float, missed: bool) -> None:
        self.theta += self.rate * (float(missed) - (1 - self.level))

    def threshold(self) -> float:
        return self.theta


class Retained:
    """The conformal rank of the last `window` scores; below 1, rho weighs them by age."""

    STATE = ("scores",)

    def __init__(self, level: float, window: int, rho: float = 1.0):
        check_window(window)
        if not 0 < level < 1 or not 0 < rho <= 1 or (rho < 1 and level >= rho):
            raise ValueError("level must be in (0, 1), rho in (0, 1], and the level below it")
        self.level, self.window, self.rho, self.scores = level, window, rho, []

    def seed(self, scores: list[float]) -> None:
        self.scores = [s for s in scores if math.isfinite(s)][-self.window :]

    def update(self, score: float, missed: bool) -> None:
        self.scores = (self.scores + [score])[-self.window :]

    def threshold_at(self, level: float) -> float:
        if self.rho == 1:
            rank = math.ceil((len(self.scores) + 1) * level)
            return sorted(self.scores)[rank - 1] if rank <= len(self.scores) else math.inf
        n = len(self.scores)
        weighed = sorted((s, self.rho ** (n - i)) for i, s in enumerate(self.scores))
        need, total = level * (1 + sum(w for _, w in weighed)), 0.0
        for s, w in weighed:
            total += w
            if total >= need:
                return s
        return math.inf

    def threshold(self) -> float:
        return self.threshold_at(self.level)


class Adaptive:
    """A retained quantile whose working level follows the misses: level += gamma (miss - (1 - level))."""

    STATE = ("work", "scores")

    def __init__(self, level: float, gamma: float = 0.005, window: int = 52, rho: float = 1.0):
        if gamma <= 0:
            raise ValueError("gamma must be positive")
        self.base = Retained(level, window, rho)
        self.level, self.gamma, self.work = level, gamma, level

    @property
    def scores(self) -> list[float]:
        return self.base.scores

    @scores.setter
    def scores(self, kept: list[float]) -> None:
        self.base.scores = kept

    def update(self, score: float, missed: bool) -> None:
        self.work += self.gamma * (float(missed) - (1 - self.level))
        self.base.update(score, missed)

    def threshold(self) -> float:
        if self.work >= 1:
            return math.inf
        if self.work <= 0:
            return -math.inf
        return self.base.threshold_at(min(max(self.work, 1e-6), 1 - 1e-6))


class ShortestInterval:
    """The shortest interval of the last signed errors, as a pair of thresholds."""

    STATE = ("scores",)

    def __init__(self, level: float, window: int, grid: int = 21):
        check_window(window)
        if not 0 < level < 1 or grid < 2:
            raise ValueError("level must be in (0, 1) and the grid of two points at least")
        self.level, self.window, self.scores = level, window, []
        self.betas = [g * (1.0 / (grid - 1)) * (1 - level) for g in range(grid - 1)] + [1 - level]

    def update(self, score: float, missed: bool) -> None:
        self.scores = (self.scores + [score])[-self.window :]

    def threshold(self) -> tuple[float, float]:
        s = sorted(self.scores)
        if not s:
            return -math.inf, math.inf
        at = lambda q: s[min(max(math.ceil(len(s) * q), 1), len(s)) - 1]
        return min(((at(b), at(self.level + b)) for b in self.betas), key=lambda pair: pair[1] - pair[0])


class Risk:
    """The least grid value whose summed losses, with the maximum, stay within alpha (n + 1), over all known targets."""

    STATE = ("sums", "n")
    by_target = True

    def __init__(self, grid: list[float], alpha: float, loss, maximum: float = 1.0):
        if not 0 < alpha < maximum or list(grid) != sorted(set(grid)) or not all(map(math.isfinite, grid)):
            raise ValueError("alpha must be in (0, maximum) and the grid finite and increasing")
        self.grid, self.alpha, self.loss, self.maximum, self.sums, self.n = list(grid), alpha, loss, maximum, [0.0] * len(grid), 0

    def update(self, target: float, bounds) -> None:
        """bounds(theta) gives the (lower, upper) that theta would have issued."""
        self.sums = [total + self.loss(target, *bounds(g)) for total, g in zip(self.sums, self.grid)]
        self.n += 1

    def threshold(self) -> float:
        fit = [g for g, total in zip(self.grid, self.sums) if total + self.maximum <= self.alpha * (self.n + 1)]
        return fit[0] if fit else math.inf


class ConformalPID:
    """A proportional tracker on the seed's scale, a tangent integrator, and a scorecast of the scores ahead.

    scorecaster(scores, ahead) gives the score `ahead` steps after the last `cast_window` known ones; without one the
    scorecast is 0.
    """

    STATE = ("scale", "ring", "p", "e", "t")

    def __init__(self, level: float, rate: float = 0.05, gain: float = 0.1, saturation: float = 5.0, window: int = 256, scorecaster=None, cast_window: int = 64, ahead: int = 1):
        check_window(window)
        check_window(ahead)
        check_window(cast_window)
        if not 0 < level < 1 or rate <= 0 or gain < 0 or saturation <= 0:
            raise ValueError("level in (0, 1), rate and saturation positive, gain not negative")
        self.level, self.rate, self.gain, self.saturation, self.window, self.cast_window = level, rate, gain, saturation, window, cast_window
        self.scorecaster, self.ahead, self.scale, self.ring, self.p, self.e, self.t = scorecaster, ahead, None, [], 0.0, 0.0, 0

    def _ahead(self) -> float:
        if self.scorecaster is None:
            return 0.0
        value = float(self.scorecaster(self.ring[-self.cast_window :], self.ahead))
        if not math.isfinite(value):
            raise ValueError("the scorecast must be finite")
        return max(value, 0.0)

    def seed(self, scores: list[float]) -> None:
        if self.scale is not None:
            raise ValueError("only an empty state can be seeded")
        finite = [float(x) for x in scores if not math.isnan(x)]
        if not finite or min(finite) < 0 or math.inf in finite:
            raise ValueError("a seed of nonnegative scores is needed")
        self.ring = finite[-self.window :]
        s = np.asarray(self.ring)
        self.scale = max(float(s.std()), 0.1 * float(s.mean()), 1e-8)
        rank = min(max(math.ceil(len(s) * self.level), 1), len(s))
        self.p = float(np.sort(s)[rank - 1]) - self._ahead()

    def remember(self, score: float) -> None:
        """A score of an origin that no bound was issued for: it may be forecast from, but nothing was missed or hit."""
        if self.scale is None:
            raise ValueError("seed first")
        if score < 0:
            raise ValueError("scores must not be negative")
        self.ring = (self.ring + [score])[-self.window :]

    def update(self, score: float, missed: bool) -> None:
        self.remember(score)
        error = float(missed) - (1 - self.level)
        self.p += self.rate * self.scale * error
        self.e, self.t = self.e + error, self.t + 1

    def threshold(self) -> float:
        if self.scale is None:
            return math.inf
        angle = self.e * math.log(self.t + 1) / (self.saturation * (self.t + 1))
        i = 0.0 if self.gain == 0 else math.copysign(math.inf, angle) if abs(angle) >= math.pi / 2 else self.gain * self.scale * math.tan(angle)
        return self.p + i + self._ahead()


class ForecastScorecaster:
    """Any function (values so far, horizon) -> horizon values as a scorecaster; the mean of fewer than `least` values, 0 of none."""

    def __init__(self, model, least: int = 3):
        check_window(least)
        self.model, self.least = model, least

    def __call__(self, values: list[float], ahead: int) -> float:
        if len(values) < self.least:
            return float(np.mean(values)) if values else 0.0
        return float(np.asarray(self.model(np.asarray(values, float), ahead), float)[ahead - 1])


def fold(issues: DataFrame, make, score: str = "absolute", seed_rows: int = 0) -> DataFrame:
    """issues with `threshold`, by a method object that make() gives for each (node, c).

    Feedback comes in order of issue; a target misses if it is outside the bounds as issued, which `score` makes of
    the point (or of q_lo and q_hi) and the threshold.  seed_rows: the first scores of a cell seed the method, and
    origins before that have no threshold; a score of such an origin that comes later is only remembered.  Infinite
    thresholds become NULL with ready false.
    """
    bound_of, native = PLAIN[score][1], score == "cqr"
    schema = "node string, c int, origin int, threshold double, ready boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin")
        method, issued, waiting, seeds, rows = make(), {}, [], [], []
        point = [(min(a, b), max(a, b)) for a, b in zip(pdf.q_lo, pdf.q_hi)] if native else pdf.point
        known, last = {o: (s, y, p) for o, s, y, p in zip(pdf.origin, pdf.score, pdf.target, point)}, int(pdf.last_step.iloc[0])
        for o in pdf.origin:
            while waiting and waiting[0] + last <= o:
                u = waiting.pop(0)
                value, target, p = known[u]
                if not np.isfinite(value):
                    continue
                if len(seeds) < seed_rows:
                    seeds.append(value)
                    if len(seeds) == seed_rows:
                        method.seed(seeds)
                elif u in issued:
                    lower, upper = bound_of(p, issued[u])
                    method.update(value, not lower <= target <= upper)
                else:
                    method.remember(value)
            waiting.append(o)
            if len(seeds) < seed_rows:
                rows.append((o, None, False))
                continue
            issued[o] = theta = method.threshold()
            rows.append((o, theta if math.isfinite(theta) else None, math.isfinite(theta)))
        out = pd.DataFrame(rows, columns=["origin", "threshold", "ready"])
        out.insert(0, "c", pdf.c.iloc[0])
        out.insert(0, "node", pdf.node.iloc[0])
        return out

    points = ["q_lo", "q_hi"] if native else ["point"]
    slim = issues.select("node", F.col("c").cast("int").alias("c"), F.col("last_step").cast("int").alias("last_step"), F.col("origin").cast("int").alias("origin"), "score", "target", *points)
    return issues.join(slim.groupBy("node", "c").applyInPandas(run, schema), ["node", "c", "origin"])


def leaf_shares(x: np.ndarray, y: np.ndarray, query: np.ndarray, bags: np.ndarray, depth: int, leaf: int) -> np.ndarray:
    """Weight of each training row: the mean over trees of its share of the query's leaf, all training rows in it alike.

    bags (trees, rows): how often a tree drew a row.  A split takes the feature and place of least squared error in the
    bag, with `leaf` different drawn rows on each side at least.  Trees are grown together, along the query's path only.
    """
    trees, n, features = len(bags), len(y), x.shape[1]
    order = np.argsort(x, axis=0, kind="stable").T
    v = np.take_along_axis(x.T, order, 1)
    here, growing = np.ones((trees, n), bool), np.arange(trees)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(depth):
            held = here[growing] & (bags[growing] > 0)
            mixed = np.where(held, y, -np.inf).max(1) > np.where(held, y, np.inf).min(1)
            growing, held = growing[mixed], held[mixed]
            if not len(growing):
                break
            w = np.where(held, bags[growing], 0)[:, order]
            drawn = w > 0
            n_left, w_left, s_left = drawn.cumsum(2), w.cumsum(2), (w * y[order]).cumsum(2)
            after = np.minimum.accumulate(np.where(drawn, v, np.inf)[:, :, ::-1], 2)[:, :, ::-1]
            after = np.concatenate([after[:, :, 1:], np.full((len(growing), features, 1), np.inf)], 2)
            ok = drawn & (after > v) & (n_left >= leaf) & (n_left[:, :, -1:] - n_left >= leaf)
            gain = np.where(ok, s_left**2 / w_left + (s_left[:, :, -1:] - s_left) ** 2 / (w_left[:, :, -1:] - w_left), -np.inf).reshape(len(growing), -1)
            # features that part the drawn rows alike differ by rounding only: the first of them
            best, rows = (gain >= gain.max(1, keepdims=True) * (1 - 1e-12)).argmax(1), np.flatnonzero(ok.any((1, 2)))
            growing, f, k = growing[rows], best[rows] // n, best[rows] % n
            low, high = v[f, k], after[rows, f, k]
            at = np.where((low + high) / 2 < high, (low + high) / 2, low)[:, None]
            here[growing] &= (x.T[f] <= at) == (query[f][:, None] <= at)
    return (here / here.sum(1, keepdims=True)).mean(0)


def shortest_weighted(y: np.ndarray, w: np.ndarray, level: float, grid: int) -> tuple[float, float]:
    """The shortest interval between weighted empirical quantiles that are `level` apart; ties: the first of the grid."""
    y, w = y[w > 0], w[w > 0]
    order = np.argsort(y, kind="stable")
    y, w = y[order], w[order]
    beta = np.linspace(0, 1, grid) * (1 - level)
    q = np.clip(np.stack([beta, level + beta]), 0, 1)
    if (w == w[0]).all():
        rank = np.clip(np.ceil(len(y) * q).astype(np.int64) - 1, 0, len(y) - 1)
    else:
        cum = np.cumsum(w / w.max())
        rank = np.minimum(np.searchsorted(cum / cum[-1], q), len(y) - 1)
    lo, hi = y[rank]
    best = int(np.argmin(hi - lo))
    return float(lo[best]), float(hi[best])


def spci(issues: DataFrame, level: float, window: int, n_lags: int, least: int = 20, trees: int = 100, depth: int = 5, leaf: int = 5, grid: int = 21, seed: int = 0) -> DataFrame:
    """issues with `t_lo`, `t_hi`: the shortest interval of errors weighted by a quantile forest on the last errors.

    Pairs and their lags are of the last `window` errors; a pair's lags were known when it was issued.  Cells with
    fewer than `least` pairs are not ready.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin")
        u, e, last, rows = pdf.origin.to_numpy(), pdf.score.to_numpy(float), int(pdf.last_step.iloc[0]), []
        fine = np.isfinite(e)
        u_ok, e_ok = u[fine], e[fine]
        for o in u:
            n = int((u_ok + last <= o).sum())
            known_u, known_e = u_ok[max(0, n - window) : n], e_ok[max(0, n - window) : n]
            ends = np.searchsorted(known_u, known_u - last, side="right")
            ready = ends >= n_lags
            if len(known_e) < n_lags + least or ready.sum() < least:
                rows.append((o, None, None, False))
                continue
            x, y = known_e[ends[ready, None] + np.arange(-n_lags, 0)], known_e[ready]
            draws = np.random.default_rng([seed, int(o)]).integers(0, len(y), (trees, len(y)))
            bags = np.stack([np.bincount(d, minlength=len(y)) for d in draws])
            rows.append((o, *shortest_weighted(y, leaf_shares(x, y, known_e[-n_lags:], bags, depth, leaf), level, grid), True))
        out = pd.DataFrame(rows, columns=["origin", "t_lo", "t_hi", "ready"])
        out.insert(0, "c", pdf.c.iloc[0])
        out.insert(0, "node", pdf.node.iloc[0])
        return out

    slim = issues.select("node", F.col("c").cast("int").alias("c"), F.col("last_step").cast("int").alias("last_step"), F.col("origin").cast("int").alias("origin"), "score")
    done = slim.groupBy("node", "c").applyInPandas(run, "node string, c int, origin int, t_lo double, t_hi double, ready boolean")
    return issues.join(done, ["node", "c", "origin"])
