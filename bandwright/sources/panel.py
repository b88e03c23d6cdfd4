"""Panels: one row a series and period, on a complete calendar, from ordinary tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the session names, or, on one machine, in one of our own where it names none."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="bandwright-")
        _OWN[context.applicationId] = base
    return f"{base.rstrip('/')}/bandwright/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complete(long: DataFrame, period: str, unit: str, step: str, attributes: list[str], fill: float | None = 0.0) -> DataFrame:
    """(series, attributes..., t, period, value): every series on every period from first to last.

    long has `value` and a timestamp to truncate to `unit`.  Missing cells get `fill`; None leaves them missing.
    The summed cells, series x periods at most, are written once: long is read in one pass, whatever follows.
    """
    cells = kept(long.groupBy(*attributes, F.date_trunc(unit, period).alias("period")).agg(F.sum("value").alias("value")), "cells")
    ends = cells.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    span = F.sequence(F.col("a"), F.col("b"), F.expr(f"interval {step}"))
    # the calendar is one row that every series explodes: series x periods rows, which is what a panel has
    series = cells.select(*attributes).distinct().withColumn("one", F.lit(1)).join(F.broadcast(ends.withColumn("one", F.lit(1))), "one")
    grid = series.select(*attributes, F.posexplode(span).alias("t", "period"))
    value = F.col("value") if fill is None else F.coalesce("value", F.lit(float(fill)))
    full = grid.join(cells, [*attributes, "period"], "left")
    return full.select(F.concat_ws("/", *attributes).alias("series"), *attributes, "t", "period", value.alias("value"))


def from_long(frame: DataFrame, series: str = "series", period: str = "period", value: str = "value", step: str | None = None) -> DataFrame:
    """A validated panel of a complete long frame; a missing, doubled or non-finite cell is an error.

    step, such as "7 days", is how far periods are apart: one that no series has is an error too.
    """
    own = frame.select(F.col(series).alias("series"), F.col(period).alias("period"), F.col(value).cast("double").alias("value"))
    faults = validate(own).filter("n > 0").collect()
    if faults:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']}" for r in faults))
    if step is not None and calendar_gaps(own, step).limit(1).count():
        raise ValueError(f"periods must be {step} apart")
    return own.join(_numbered(own), "period")


def _numbered(own: DataFrame) -> DataFrame:
    return own.select("period").distinct().select("period", (F.row_number().over(Window.orderBy("period")) - 1).alias("t"))


def validate(panel: DataFrame) -> DataFrame:
    """(rule, n): how many cells break each rule of a panel with series, period and value."""
    size = panel.agg(F.countDistinct("series").alias("s"), F.countDistinct("period").alias("p"), F.countDistinct("series", "period").alias("cells"), F.count(F.lit(1)).alias("n"), F.sum((F.col("value").isNull() | F.isnan("value") | F.col("value").isin(float("inf"), float("-inf"))).cast("long")).alias("bad"))
    return size.select(F.explode(F.array(
        F.struct(F.lit("missing").alias("rule"), (F.col("s") * F.col("p") - F.col("cells")).alias("n")),
        F.struct(F.lit("doubled").alias("rule"), (F.col("n") - F.col("cells")).alias("n")),
        F.struct(F.lit("not finite").alias("rule"), F.coalesce("bad", F.lit(0).cast("long")).alias("n")),
    )).alias("x")).select("x.rule", "x.n")


def calendar_gaps(panel: DataFrame, step: str) -> DataFrame:
    """Periods between first and last, `step` apart, that no series has."""
    ends = panel.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    full = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("period"))
    return full.join(panel.select("period").distinct(), "period", "left_anti")


def forward_fill(panel: DataFrame) -> DataFrame:
    """Missing values take the last one before them; `observed` says which were there; periods before every series has a value go."""
    past = Window.partitionBy("series").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    first = panel.filter("value is not null").groupBy("series").agg(F.min("t").alias("f")).agg(F.max("f").alias("start")).withColumn("one", F.lit(1))
    filled = panel.withColumn("observed", F.col("value").isNotNull()).withColumn("value", F.last("value", ignorenulls=True).over(past)).withColumn("one", F.lit(1))
    return filled.join(F.broadcast(first), "one").filter("t >= start").drop("one", "start")


def dropped_periods(panel: DataFrame) -> DataFrame:
    """(dropped): how many leading periods forward_fill leaves out, those before every series has a value."""
    first = panel.filter("value is not null").groupBy("series").agg(F.min("t").alias("f")).agg(F.max("f").alias("start"))
    low = panel.agg(F.min("t").alias("low")).crossJoin(F.broadcast(first))  # one row each
    return low.select((F.col("start") - F.col("low")).cast("long").alias("dropped"))


def scaling(panel: DataFrame, train_end: int) -> DataFrame:
    """(series, centre, scale): mean and population deviation of the periods before train_end; a constant series has scale 1."""
    own = panel.filter(F.col("t") < train_end).groupBy("series").agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("scale"))
    return own.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))


def scaled(panel: DataFrame, spec: DataFrame, value: str = "value") -> DataFrame:
    return panel.join(spec, "series").withColumn(value, (F.col(value) - F.col("centre")) / F.col("scale")).drop("centre", "scale")


def restored(panel: DataFrame, spec: DataFrame, value: str = "value") -> DataFrame:
    return panel.join(spec, "series").withColumn(value, F.col(value) * F.col("scale") + F.col("centre")).drop("centre", "scale")


def folds(n: int, count: int, test: int, calibration: int, train: int) -> list[tuple[int, int, int, int, int]]:
    """(fold, train start, train end, test start, test end): the last `count` blocks of `test` periods, with the periods before each."""
    first = n - count * test
    if min(count, test, train) < 1 or calibration < 0 or first - calibration - train < 0:
        raise ValueError("there are too few periods for these folds")
    return [(k, at - calibration - train, at - calibration, at, at + test) for k, at in enumerate(range(first, n, test))]


def from_wide(frame: DataFrame, keys: list[str], name: str = "period", value: str = "value") -> DataFrame:
    """Columns beside keys become rows."""
    return frame.unpivot(keys, [c for c in frame.columns if c not in keys], name, value)


def from_arrays(frame: DataFrame, series: str = "series", values: str = "values") -> DataFrame:
    return frame.select(F.col(series).alias("series"), F.posexplode(values).alias("t", "value"))


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def pinned(spark: SparkSession, path: str, digest: str) -> None:
    """Fail unless the file's SHA-256 is digest."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()
    if [r[0] for r in found] != [digest]:
        raise ValueError(f"{path} is not the pinned file")


def shipped_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly shipped quantity by part type and supplier region."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    items = t("lineitem").select("l_partkey", "l_suppkey", "l_shipdate", F.col("l_quantity").alias("value"))
    items = items.join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    return complete(items, "l_shipdate", "week", "7 days", ["p_type", "r_name"])


def event_hours(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    """Hourly count of events by type."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", F.lit(1.0).alias("value"))
    return complete(events, "ts", "hour", "1 hour", ["event_type"], fill)
