"""Metrics of issued bounds: means over rows whose target is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(F.when(y.isNotNull(), ((F.coalesce(y >= lo, F.lit(True))) & F.coalesce(y <= hi, F.lit(True))).cast("double")))


def width(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(F.when(y.isNotNull(), hi - lo))


def interval_score(y: Column, lo: Column, hi: Column, level: float) -> Column:
    return F.avg(F.when(y.isNotNull(), hi - lo + 2 / (1 - level) * (F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0)))))


def pinball(y: Column, bound: Column, tau: float) -> Column:
    return F.avg(F.greatest(tau * (y - bound), (tau - 1) * (y - bound)))


def newsvendor_cost(y: Column, order: Column, holding: float, shortage: float) -> Column:
    return F.avg(F.when(y.isNotNull(), holding * F.greatest(order - y, F.lit(0.0)) + shortage * F.greatest(y - order, F.lit(0.0))))


def compare(replays: dict[str, DataFrame], level: float, by: str | None = None, one_sided: bool = False) -> DataFrame:
    """One row a method, and a value of the column `by` where it is given: the share of ready issues, and metrics of those with a target.

    Two-sided bounds have coverage, width and interval score; one-sided ones, whose lower end is open, coverage and the
    upper bound's pinball loss at level.
    """
    if not replays:
        raise ValueError("there must be a method to compare")
    rows, label = None, [by] if by else []
    for name, df in replays.items():
        part = df.select(F.lit(name).alias("method"), *label, "target", "lower", "upper")
        rows = part if rows is None else rows.unionByName(part)
    y, lo, hi = F.col("target"), F.col("lower"), F.col("upper")
    ready = hi.isNotNull() if one_sided else lo.isNotNull() & hi.isNotNull()
    known = F.when(ready, y)
    own = [pinball(known, hi, level).alias("pinball")] if one_sided else [width(known, lo, hi).alias("width"), interval_score(known, lo, hi, level).alias("interval_score")]
    return rows.groupBy("method", *label).agg(F.avg(ready.cast("double")).alias("ready"), coverage(known, lo, hi).alias("coverage"), *own)


def point_errors(rows: DataFrame, by: list[str]) -> DataFrame:
    e = F.col("target") - F.col("point")
    return rows.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def describe(panel: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by..., counts, range, mean, deviation, quantiles, sample skewness and excess kurtosis, distinct and repeated values), rounded to 6 places."""
    v, n = F.col(value), F.col("n").cast("double")
    q = F.percentile(value, [0.05, 0.5, 0.95])
    base = panel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum((v == 0).cast("long")).alias("zeros"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        q.alias("q"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"), F.countDistinct(v).alias("n_unique"),
    )
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    tails = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    r = lambda e, name: F.round(e, 6).alias(name)
    return base.select(
        *by, "n", "zeros", "low", "high", r(F.col("mean"), "mean"), r(F.col("std"), "std"), r(F.col("q")[0], "q05"), r(F.col("q")[1], "q50"), r(F.col("q")[2], "q95"),
        r(skew, "skew"), r(tails, "excess_kurtosis"), "n_unique", (F.col("n") - F.col("n_unique")).alias("repeats"),
    )
