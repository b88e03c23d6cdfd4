"""Targets, scores, bounds and losses as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Score:
    """score(target, point, q_lo, q_hi) and bound(threshold, point, q_lo, q_hi) -> (lower, upper)."""

    name: str
    score: Callable[..., Column]
    bound: Callable[..., tuple[Column, Column]]


ABSOLUTE = Score("absolute", lambda y, p, lo=None, hi=None: F.abs(y - p), lambda t, p, lo=None, hi=None: (p - t, p + t))
#: One-sided: the lower bound is minus infinity, shown as NULL.
SIGNED = Score("signed", lambda y, p, lo=None, hi=None: y - p, lambda t, p, lo=None, hi=None: (F.lit(None).cast("double"), p + t))
CQR = Score(
    "cqr",
    lambda y, p, lo, hi: F.greatest(F.least(lo, hi) - y, y - F.greatest(lo, hi)),
    lambda t, p, lo, hi: (F.least(lo, hi) - t, F.greatest(lo, hi) + t),
)


#: The same on plain numbers, name: (score of target and point, bounds of point and threshold); a native pair, in order, is the point of "cqr".
PLAIN: dict[str, tuple[Callable, Callable]] = {
    "absolute": (lambda y, p: abs(y - p), lambda p, t: (p - t, p + t)),
    "signed": (lambda y, p: y - p, lambda p, t: (-math.inf, p + t)),
    "asymmetric": (lambda y, p: y - p, lambda p, t: (p + t[0], p + t[1])),
    "cqr": (lambda y, q: max(q[0] - y, y - q[1]), lambda q, t: (q[0] - t, q[1] + t)),
}


def asymmetric_bound(t_lo: Column, t_hi: Column, point: Column) -> tuple[Column, Column]:
    return point + t_lo, point + t_hi


def miss(y: Column, lower: Column, upper: Column) -> Column:
    """1 where y is outside the bounds, ends included in them; an open end is NULL."""
    return (F.coalesce(y < lower, F.lit(False)) | F.coalesce(y > upper, F.lit(False))).cast("double")


def selective_loss(error: Column, upper: Column, alpha: float) -> Column:
    """Between 0 and 1, and not monotone: an error counts where the upper bound, threshold less confidence, is negative."""
    predicted = F.when(upper < 0, 1.0).otherwise(0.0)
    return error * predicted - alpha * predicted + alpha


def mask(target: Column, imputed: Column) -> Column:
    """A target that rests on an imputed or censored value is missing."""
    return F.when(~F.coalesce(imputed, F.lit(False)), target)


def step_columns(steps: DataFrame, by: list[str]) -> DataFrame:
    """One target column a step: c = h."""
    return steps.select(*by, F.col("h").alias("c"), F.col("h").alias("last_step"), "point", "target", *[x for x in ("q_lo", "q_hi", "censored") if x in steps.columns])


def lead_time_columns(steps: DataFrame, by: list[str], lead: int) -> DataFrame:
    """One target column: the sum of the first `lead` steps, missing where one is; censored where any is."""
    if lead < 1:
        raise ValueError("lead must be at least 1")
    within = steps.filter(F.col("h") <= lead)
    whole = lambda c: F.when(F.count(c) == lead, F.sum(c)).alias(c)
    more = [F.bool_or("censored").alias("censored")] if "censored" in steps.columns else []
    return within.groupBy(*by).agg(F.lit(1).alias("c"), F.lit(lead).alias("last_step"), whole("point"), whole("target"), *more)
