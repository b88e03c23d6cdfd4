"""Orders from bounds, and what they cost under lost sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def critical_ratio(holding: Column, shortage: Column) -> Column:
    return F.when((holding > 0) & (shortage > 0), shortage / (holding + shortage)).otherwise(F.raise_error(F.lit("costs must be positive")).cast("double"))


def order_up_to(bound: Column, on_hand: Column, in_transit: Column) -> Column:
    return F.greatest(bound - (on_hand + F.aggregate(in_transit, F.lit(0.0), lambda a, x: a + x)), F.lit(0.0))


def settle(on_hand: Column, in_transit: Column, demand: Column, order: Column, holding: float, shortage: float) -> Column:
    """One period: receive, sell what there is, lose the rest, and put the order at the end of the pipeline.

    Demand must be known and finite.
    """
    whole = demand.isNotNull() & ~F.isnan(demand) & (F.abs(demand) < float("inf"))
    demand = F.when(whole, demand).otherwise(F.raise_error(F.lit("demand must be finite")).cast("double"))
    start = on_hand + F.element_at(in_transit, 1)
    sales = F.least(start, demand)
    return F.struct(
        F.element_at(in_transit, 1).alias("arrivals"), demand.alias("demand"), sales.alias("sales"), (demand - sales).alias("missed"), (start - sales).alias("end_inventory"),
        ((start - sales) * holding).alias("holding_cost"), ((demand - sales) * shortage).alias("shortage_cost"),
        F.concat(F.slice(in_transit, 2, F.size(in_transit) - 1), F.array(order)).alias("pipeline"),
    )


def play(series: DataFrame, lead: int, holding: float, shortage: float) -> DataFrame:
    """(series, period, ...): each series' periods, an array of (bound, demand), settled in order.

    Stock and pipeline at the start are the columns on_hand and in_transit (an array of `lead` orders), or empty.  A period
    without a bound orders nothing.  The fold runs inside one expression a series.
    """
    if holding <= 0 or shortage <= 0 or lead < 1:
        raise ValueError("costs must be positive and the lead at least 1")
    zero = F.array(*[F.lit(0.0)] * lead)
    stock = F.coalesce(F.col("on_hand").cast("double"), F.lit(0.0)) if "on_hand" in series.columns else F.lit(0.0)
    pipe = F.coalesce(F.col("in_transit").cast("array<double>"), zero) if "in_transit" in series.columns else zero
    log = "array<struct<period:int,demand:double,sales:double,missed:double,end_inventory:double,ordered:double,holding_cost:double,shortage_cost:double>>"
    start = F.struct(stock.alias("stock"), pipe.alias("pipe"), F.array().cast(log).alias("log"))

    def step(acc: Column, x: Column) -> Column:
        order = F.coalesce(order_up_to(x["bound"], acc["stock"], acc["pipe"]), F.lit(0.0))
        s = settle(acc["stock"], acc["pipe"], x["demand"], order, holding, shortage)
        row = F.struct(F.size(acc["log"]).alias("period"), s["demand"], s["sales"], s["missed"], s["end_inventory"], order.alias("ordered"), s["holding_cost"], s["shortage_cost"])
        return F.struct(s["end_inventory"].alias("stock"), s["pipeline"].alias("pipe"), F.concat(acc["log"], F.array(row)).cast(log).alias("log"))

    return series.select("series", F.inline(F.aggregate("periods", start, step, lambda a: a["log"])))


def played_costs(played: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Summed holding and shortage costs and their total, over all or by columns of a play."""
    sums = played.groupBy(*(by or [])).agg(F.sum("holding_cost").alias("holding"), F.sum("shortage_cost").alias("shortage"))
    return sums.withColumn("total", F.col("holding") + F.col("shortage"))
