"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, numbered

#: Hash and rank fractions are kept as whole numbers of this unit.
UNIT = 1 << 40


def _places(rows: DataFrame, group: list[str], order: list[str], spot: F.Column, per_bucket: int, total: F.Column) -> DataFrame:
    """rows with `place`, their 0-based rank by `order` inside `group`.

    spot in 0..UNIT-1 grows with the order and is spread evenly; a group is cut into ranges of it of about
    per_bucket rows, ranked each by itself after the counts of the ranges before it.
    """
    ranges = F.greatest(F.lit(1), F.ceil(total / per_bucket)).cast("long")
    rows = rows.select("*", F.shiftright(spot * ranges, 40).alias("__range"))
    key = [*group, "__range"]
    fills = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*group).orderBy("__range") if group else Window.orderBy("__range")
    before = fills.select(*[F.col(c).alias(f"__b_{c}") for c in key], (F.sum("__n").over(over) - F.col("__n")).alias("__before"))
    ranked = rows.select("*", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("__rank"))
    condition = F.col("__range") == F.col("__b___range")
    for c in group:
        condition = condition & (F.col(c) == F.col(f"__b_{c}"))
    out = ranked.join(before, condition).withColumn("place", F.col("__before") + F.col("__rank") - 1)
    return out.drop("__range", "__rank", "__before", *[f"__b_{c}" for c in key])


def interleave(rows: DataFrame, source_col: str, order_cols: list[str], shards: int, seed: int = 42, per_bucket: int = 50_000) -> DataFrame:
    """rows with `shard` and `slot`: every shard holds the sources in their proportions, counts at most one apart.

    A source's rows are put in the order of a seeded hash of order_cols; row r of n has the fraction
    (r + 1/2) / n.  All rows sorted by the fraction (ties by source, then hash) are cut into `shards` equal
    runs; slot counts from 0 in each.  Null sources are one source.  Rows alike in all of order_cols are
    interchangeable.  An empty table gives no rows.  Columns named shard or slot are replaced, all others kept.
    """
    # columns go by numbers meanwhile, so none can clash with those added here
    at = {c: f"__c{k}" for k, c in enumerate(rows.columns)}
    rows, source_col, order_cols = rows.toDF(*at.values()), at[source_col], [at[c] for c in order_cols]
    keep, tie_cols = [F.col(n).alias(c) for c, n in at.items() if c not in ("shard", "slot")], order_cols[:1]
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in order_cols])
    rows = rows.select("*", F.shiftrightunsigned(h, 24).alias("__spot"), h.alias("__hash"))
    rows = cut(rows, "shard-rows")
    counts = cut(rows.groupBy(source_col).agg(F.count(F.lit(1)).alias("__size")), "shard-sources")
    number = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())).cast("long")
    # One row a source: the ranking of sources is a short list beside the rows.
    listed = counts.select(F.col(source_col).alias("__s"), "__size", number.alias("__stratum"), F.sum("__size").over(Window.partitionBy()).alias("__total"))
    rows = rows.join(F.broadcast(listed) if listed.count() <= 100_000 else listed, F.col(source_col).eqNullSafe(F.col("__s"))).drop("__s")
    own = _places(rows, ["__stratum"], ["__spot", "__hash", *tie_cols], F.col("__spot"), per_bucket, F.col("__size"))
    # fractions are told apart to 2**-40; those alike go by source and place
    spot = F.floor((F.col("__place") + 0.5) / F.col("__size") * float(UNIT)).cast("long")
    own = own.withColumnRenamed("place", "__place").select("*", spot.alias("__f"))
    whole = _places(own, [], ["__f", "__stratum", "__place"], F.col("__f"), per_bucket, F.col("__total"))
    shard = F.expr(f"(place * {shards}) div __total").cast("int")
    begin = F.expr(f"(((place * {shards}) div __total) * __total + {shards - 1}) div {shards}")
    return whole.select(*keep, shard.alias("shard"), (F.col("place") - begin).cast("long").alias("slot"))


def sharded_rows(docs: DataFrame, source_col: str, shards: int, seed: int = 42) -> DataFrame:
    """docs with `shard` and `slot`, in place of any such columns; whole rows are shuffled once, to meet their place."""
    docs = docs.drop("shard", "slot")
    at = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    rows = numbered(docs.toDF(*at.values()), "shard-input")
    content = F.xxhash64(*at.values())
    narrow = rows.select("__row", F.col(at[source_col]).alias("__source"), content.alias("__content"))
    dealt = interleave(narrow, "__source", ["__content"], shards, seed).select("__row", "shard", "slot")
    return rows.join(dealt, "__row").select(*[F.col(n).alias(c) for c, n in at.items()], "shard", "slot")
