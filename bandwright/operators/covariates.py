"""Covariates, and which of their values a model may see at an origin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Covariate:
    """rows has value, and: series and t; t alone, the same for all series; or series alone, static.

    known_ahead: values after the origin may be read, through the horizon.  aggregate, sum or mean, makes the values
    of nodes above the bottoms.
    """

    rows: DataFrame
    known_ahead: bool = False
    aggregate: str = "mean"

    def __post_init__(self):
        if "value" not in self.rows.columns or not {"series", "t"} & set(self.rows.columns):
            raise ValueError("a covariate needs value, and series or t")
        if self.aggregate not in ("sum", "mean"):
            raise ValueError("aggregate must be sum or mean")

    @property
    def static(self) -> bool:
        return "t" not in self.rows.columns

    @property
    def shared(self) -> bool:
        return "series" not in self.rows.columns

    @property
    def kind(self) -> str:
        return "static" if self.static else "known ahead" if self.known_ahead else "historical"


def check(covariate: Covariate, series: DataFrame, last: int, horizon: int) -> None:
    """Fail unless the covariate has every series, and every period that the last origin may read."""
    rows = covariate.rows
    if not covariate.shared and series.select("series").distinct().join(rows.select("series").distinct(), "series", "left_anti").limit(1).count():
        raise ValueError("the covariate must have every series, or none")
    if not covariate.static:
        needed = last + 1 + (horizon if covariate.known_ahead else 0)
        seen = rows.filter(F.col("t").between(0, needed - 1))
        short = (seen if covariate.shared else seen.groupBy("series")).agg(F.countDistinct("t").alias("n")).agg(F.min("n")).first()[0] or 0
        if short < needed:
            raise ValueError(f"the covariate has {short} periods of {needed}")


def on_nodes(covariate: Covariate, edge: DataFrame) -> DataFrame:
    """(node, t, value), without t where static; shared rows stay (t, value) and go to every node."""
    if covariate.shared:
        return covariate.rows.select("t", "value")
    by = [] if covariate.static else ["t"]
    total = F.sum("value") if covariate.aggregate == "sum" else F.sum("value") / F.count(F.lit(1))
    return covariate.rows.join(edge.select("node", "series"), "series").groupBy("node", *by).agg(total.cast("double").alias("value"))


def at_steps(grid: DataFrame, covariate: Covariate, edge: DataFrame, name: str) -> DataFrame:
    """grid (node, origin, h) with the value of each step's period, which only a static or known-ahead covariate has."""
    if covariate.kind == "historical":
        raise ValueError(f"{name} is not known ahead")
    return _met(grid, covariate, edge, name, F.col("origin") + F.col("h"))


def at_lag(grid: DataFrame, covariate: Covariate, edge: DataFrame, name: str, lag: int = 0) -> DataFrame:
    """grid (node, origin) with the value `lag` periods before the origin, which every covariate has."""
    if lag < 0:
        raise ValueError("a lag must not be negative")
    return _met(grid, covariate, edge, name, F.col("origin") - lag)


def _met(grid: DataFrame, covariate: Covariate, edge: DataFrame, name: str, period) -> DataFrame:
    values = on_nodes(covariate, edge).withColumnRenamed("value", name)
    if covariate.static:
        return grid.join(values, "node", "left")
    values = values.withColumnRenamed("t", "__t")
    return grid.withColumn("__t", period).join(values, ["__t"] if covariate.shared else ["node", "__t"], "left").drop("__t")


def visible(covariate: Covariate, origin: int, horizon: int) -> DataFrame:
    """What a model may read at an origin: all of a static one, a known-ahead one through the horizon, else through the origin."""
    if covariate.static:
        return covariate.rows
    return covariate.rows.filter(F.col("t") <= origin + (horizon if covariate.known_ahead else 0))
