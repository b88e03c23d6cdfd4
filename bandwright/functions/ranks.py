"""Rank rules on arrays of scores, as Column expressions.  NULL stands for "not ready"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _level(level: float | Column) -> Column:
    if isinstance(level, Column):
        return level.cast("double")
    if not 0 < level < 1:
        raise ValueError("level must be strictly between 0 and 1")
    return F.lit(float(level))


def _with(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def score_quantile(scores: Column, level: float | Column) -> Column:
    """The order statistic of rank ceil((n + 1) q), without interpolation; NULL where the rank is beyond n."""
    rank = F.ceil((F.size(scores) + 1) * _level(level)).cast("int")
    return F.when((rank >= 1) & (rank <= F.size(scores)), F.try_element_at(F.array_sort(scores), rank))


def empirical_quantile(scores: Column, level: float | Column) -> Column:
    """The order statistic of rank ceil(n q), held in 1..n; levels 0 and 1 are allowed; NULL for no scores."""
    level = level if isinstance(level, Column) else F.lit(float(level))
    rank = F.least(F.greatest(F.ceil(F.size(scores) * level), F.lit(1)), F.size(scores)).cast("int")
    return F.when(F.size(scores) > 0, F.try_element_at(F.array_sort(scores), F.greatest(rank, F.lit(1))))


def recency_quantile(scores: Column, level: float, rho: float) -> Column:
    """Scores in order of age, oldest first, weigh rho ** age with the newest at age 1; the test point has mass 1 at infinity."""
    if not 0 < rho <= 1 or (rho < 1 and level >= rho):
        raise ValueError("rho must be in (0, 1] and the level below it")
    pairs = F.array_sort(F.transform(scores, lambda s, i: F.struct(s.alias("s"), F.pow(F.lit(float(rho)), F.size(scores) - i).alias("w"))))
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("hit"))

    def search(p: Column) -> Column:
        need = F.aggregate(p["pairs"], F.lit(1.0), lambda a, x: a + x["w"]) * float(level)
        step = lambda a, x, y: F.struct((a["cum"] + x["w"]).alias("cum"), F.coalesce(a["hit"], F.when(a["cum"] + x["w"] >= y, x["s"])).alias("hit"))
        return _with(need, lambda y: F.aggregate(p["pairs"], start, lambda a, x: step(a, x, y), lambda a: a["hit"]))

    return _with(F.struct(pairs.alias("pairs")), search)


def empirical_interval(scores: Column, level: float, grid: int = 21) -> tuple[Column, Column]:
    """The shortest [Q(b), Q(level + b)] over an even grid of b in [0, 1 - level]; ties go to the first b."""
    if grid < 2:
        raise ValueError("grid must have two points at least")
    betas = [g * (1.0 / (grid - 1)) * (1 - level) if g < grid - 1 else 1 - level for g in range(grid)]
    n = F.size(scores)

    def search(p: Column) -> Column:
        def at(q: float) -> Column:
            rank = F.greatest(F.least(F.ceil(n * F.lit(float(q))).cast("int"), n), F.lit(1))
            return F.try_element_at(p["s"], rank)

        return F.array_min(F.array(*[F.struct((at(level + b) - at(b)).alias("width"), F.lit(k).alias("k"), at(b).alias("lo"), at(level + b).alias("hi")) for k, b in enumerate(betas)]))

    best = _with(F.struct(F.array_sort(scores).alias("s")), search)
    return F.when(n > 0, best["lo"]), F.when(n > 0, best["hi"])
