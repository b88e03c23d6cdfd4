"""Block bootstrap of losses in whole cycles, its percentile summary, and the losses' autocorrelation."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drawn_start(replicate: Column, block: Column, cycles: int, seed: int) -> Column:
    """The cycle that a block starts at: the first 32 bits of a digest of seed, replicate and block, modulo the cycles."""
    text = F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), block.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(cycles)).cast("int")


def cycle_means(losses: DataFrame, by: list[str], place: str, loss: str, period: int) -> DataFrame:
    """(by..., cycle, loss): means of `period` places in a row, which start at place 0."""
    return losses.groupBy(*by, F.floor(F.col(place) / period).cast("int").alias("cycle")).agg(F.avg(loss).alias("loss"), F.count(loss).alias("n"))


def _statistic(slots: DataFrame, by: list[str], fold_cycles: list[int], root: bool) -> DataFrame:
    """Means of the slots of each fold, their square root where root is set, averaged over the folds."""
    ends = [sum(fold_cycles[: k + 1]) for k in range(len(fold_cycles))]
    fold = F.coalesce(*[F.when(F.col("slot") < e, k) for k, e in enumerate(ends)])
    means = slots.groupBy(*by, fold.alias("fold")).agg(F.avg("loss").alias("loss"))
    return means.groupBy(*by).agg(F.avg(F.sqrt("loss") if root else F.col("loss")).alias("loss"))


def block_bootstrap(losses: DataFrame, by: list[str], place: str, loss: str, period: int, fold_sizes: list[int], block: int, replicates: int = 10_000, root: bool = False, seed: int = 42) -> DataFrame:
    """(by..., replicate, loss): the statistic of records redrawn from circular blocks that keep the phase of the cycle.

    The record has sum(fold_sizes) places from 0 on, all of them present for every group.  A block is `block` places long,
    whole cycles; blocks start at cycles drawn alike for every group, run on past the record's end at its start, and fill
    the folds' places in order.  Replicate 0 is the record itself.  Draws are made where they are used, from digests.
    """
    record = sum(fold_sizes)
    if period < 1 or any(n % period or n < 1 for n in fold_sizes) or block % period or not period <= block < record or replicates < 2:
        raise ValueError("folds and blocks must be whole cycles, and a block shorter than the record")
    cycles, each = record // period, block // period
    means = cycle_means(losses, by, place, loss, period)
    means = means.withColumn("loss", F.when(F.col("n") == period, F.col("loss")))
    spark = losses.sparkSession
    drawn = spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))).alias("slot"))
    start = drawn_start(F.col("replicate"), F.expr(f"slot div {each}").cast("int"), cycles, seed)
    drawn = drawn.select("replicate", "slot", F.pmod(start + F.col("slot") % each, F.lit(cycles)).cast("int").alias("cycle"))
    itself = spark.range(cycles).select(F.lit(0).alias("replicate"), F.col("id").cast("int").alias("slot"), F.col("id").cast("int").alias("cycle"))
    slots = means.select(*by, "cycle", "loss").join(drawn.union(itself), "cycle")
    return _statistic(slots, [*by, "replicate"], [n // period for n in fold_sizes], root)


def percentile_rank(probability: Fraction, count: int) -> int:
    """The rank of the least of `count` sorted values that at least this share does not exceed, in exact arithmetic."""
    return max(1, -(-count * probability.numerator // probability.denominator))


def summary(draws: DataFrame, by: list[str], replicates: int, confidence: str = "0.95") -> DataFrame:
    """(by..., estimate, lower, upper, bootstrap_mean, bootstrap_bias, status) of block_bootstrap's rows; bounds are draws, not interpolated.

    A group with a missing or infinite draw or estimate has no bounds: none is left out of the ranking.
    """
    tail = (1 - Fraction(confidence)) / 2
    if not 0 < tail < Fraction(1, 2):
        raise ValueError("confidence must be between 0 and 1")
    low, high = percentile_rank(tail, replicates), percentile_rank(1 - tail, replicates)
    own = F.when(F.col("replicate") > 0, F.col("loss"))
    fine = F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") < float("inf"))
    grouped = draws.groupBy(*by).agg(F.max(F.when(F.col("replicate") == 0, F.col("loss"))).alias("estimate"), F.array_sort(F.collect_list(own)).alias("s"), F.avg(own).alias("mean"), F.sum((~fine).cast("int")).alias("bad"))
    ok = (F.col("bad") == 0) & (F.size("s") == replicates)
    at = lambda rank, name: F.when(ok, F.try_element_at("s", F.lit(rank))).alias(name)
    return grouped.select(*by, "estimate", at(low, "lower"), at(high, "upper"), F.col("mean").alias("bootstrap_mean"), (F.col("mean") - F.col("estimate")).alias("bootstrap_bias"), F.when(ok, "ok").otherwise("not finite").alias("status"))


def autocorrelation(losses: DataFrame, by: list[str], place: str, loss: str, period: int) -> DataFrame:
    """(by..., lag, n_pairs, raw_acf, phase_acf) at one and at seven periods; places run from 0 and are all present.

    Around the mean of the whole record, over the sum of all squares; phase_acf takes each phase's mean off first.  A lag as
    long as the record, and a constant record, have NULL.
    """
    group, phase = Window.partitionBy(*by), Window.partitionBy(*by, "phase")
    rows = losses.select(*by, F.col(place).alias("at"), F.col(loss).alias("loss"), (F.col(place) % period).alias("phase"))
    rows = rows.withColumn("raw", F.col("loss") - F.avg("loss").over(group)).withColumn("own", F.col("loss") - F.avg("loss").over(phase))
    order = group.orderBy("at")
    out = None
    for lag in (period, 7 * period):
        paired = rows.withColumn("raw_b", F.lag("raw", lag).over(order)).withColumn("own_b", F.lag("own", lag).over(order))
        ratio = lambda e: F.try_divide(F.sum(F.col(e) * F.col(f"{e}_b")), F.sum(F.col(e) * F.col(e)))
        part = paired.groupBy(*by).agg(F.lit(lag).alias("lag"), F.count("raw_b").alias("n_pairs"), ratio("raw").alias("raw_acf"), ratio("own").alias("phase_acf"))
        out = part if out is None else out.union(part)
    return out
