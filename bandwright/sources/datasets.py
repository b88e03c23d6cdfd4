"""Panels of the public forecasting data sets, from their published files.

Each reader gives a long panel (series, period, value) with the data set's attributes and, where it has them, `censored`
or `observed`.  Nothing is pivoted: wide files are unpivoted while they are read, so a row stays a series and period.
Missing cells follow the data set's own rule: zero only where an absent value means no sale, else the last value before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .panel import forward_fill

# The hierarchy levels of each data set.
VN2_LEVELS = [["Store"], ["ProductGroup"], ["Division"], ["Department"], ["DepartmentGroup"]]
FAVORITA_LEVELS = [["state"], ["state", "city"], ["store_nbr"], ["family"], ["state", "family"]]
FAVORITA_ATTRIBUTES = ["store_nbr", "family", "state", "city", "type", "cluster"]
M5_ATTRIBUTES = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(header=True, **options).csv(path)


def _long(wide: DataFrame, keys: list[str], value: str) -> DataFrame:
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "period", value)


def _joined(*parts: str) -> Column:
    return F.concat_ws("_", *parts)


def on_calendar(long: DataFrame, step: str, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """(keys..., t, period, value): every series on every period from the first to the last one, gaps missing."""
    ends = long.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    calendar = ends.select(F.posexplode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("t", "period"))
    series = long.select(*keys).distinct().withColumn("one", F.lit(1))
    spans = calendar.agg(F.array_sort(F.collect_list(F.struct("t", "period"))).alias("span")).withColumn("one", F.lit(1))
    grid = series.join(F.broadcast(spans), "one").select(*keys, F.inline("span"))
    return grid.join(long.select(*keys, "period", "value"), [*keys, "period"], "left")


def filled(long: DataFrame, step: str, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """on_calendar with gaps filled from the past, leading periods without a value of every series left out; t counts from 0."""
    full = forward_fill(on_calendar(long, step, keys))
    return full.withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy("series")))


def vn2(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(panel, stock) of the inventory challenge: weekly sales with `censored` where out of stock, and the first state.

    A product without a value sold nothing; weeks that the stock file does not have count as in stock.
    """
    sales = _long(_csv(spark, f"{path}/week_8_sales.csv"), ["Store", "Product"], "value")
    stocked = _long(_csv(spark, f"{path}/week_0_in_stock.csv"), ["Store", "Product"], "stocked")
    day = lambda df: df.withColumn("period", F.to_timestamp("period"))
    master = _csv(spark, f"{path}/week_0_master.csv")
    known = day(sales).join(day(stocked), ["Store", "Product", "period"], "left").join(master, ["Store", "Product"], "left")
    own = [c for c in master.columns if c not in ("Store", "Product")]
    panel = known.select(
        _joined("Store", "Product").alias("series"), "Store", *own, "period", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"),
        (~F.coalesce(F.lower("stocked").isin("true", "1", "1.0"), F.lit(True))).alias("censored"),
    )
    state = _csv(spark, f"{path}/week_0_initial_state.csv")
    pipe = F.array(*[F.col(f"In Transit W+{k}").cast("double") for k in (1, 2)])
    return panel, state.select(_joined("Store", "Product").alias("series"), F.col("End Inventory").cast("double").alias("on_hand"), pipe.alias("in_transit"))


def m5(spark: SparkSession, path: str) -> DataFrame:
    """Daily unit sales with item, department, category, store and state; t is the day column's place."""
    wide = _csv(spark, f"{path}/sales_train_evaluation.csv").drop("id")
    days = _long(wide, M5_ATTRIBUTES, "value").withColumnRenamed("period", "d")
    calendar = _csv(spark, f"{path}/calendar.csv").select("d", F.to_timestamp("date").alias("period"))
    t = (F.substring("d", 3, 9).cast("int") - 1).alias("t")
    return days.join(calendar, "d").select(_joined("item_id", "store_id").alias("series"), *M5_ATTRIBUTES, t, "period", F.col("value").cast("double").alias("value"))


def m5_prices(spark: SparkSession, path: str, horizon: int, days: int) -> DataFrame:
    """(series, t, value): each day's price through days + horizon, known ahead.

    A day without a price takes the next listed one, or the last one where none follows.
    """
    calendar = _csv(spark, f"{path}/calendar.csv").select((F.substring("d", 3, 9).cast("int") - 1).alias("t"), F.col("wm_yr_wk").alias("week")).filter(F.col("t") < days + horizon)
    if calendar.count() < days + horizon:
        raise ValueError(f"the calendar needs {days + horizon} days")
    prices = _csv(spark, f"{path}/sell_prices.csv").groupBy("store_id", "item_id", F.col("wm_yr_wk").alias("week")).agg(F.avg(F.col("sell_price").cast("double")).alias("value"))
    prices = prices.withColumn("series", _joined("item_id", "store_id")).select("series", "week", "value")
    spans = calendar.agg(F.array_sort(F.collect_list(F.struct("t", "week"))).alias("span")).withColumn("one", F.lit(1))
    grid = prices.select("series").distinct().withColumn("one", F.lit(1)).join(F.broadcast(spans), "one").select("series", F.inline("span"))
    own = Window.partitionBy("series").orderBy("t")
    back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    # as the published reading does: the next listed price first, the last one only where none follows
    value = F.coalesce(F.first("value", True).over(ahead), F.last("value", True).over(back))
    return grid.join(prices, ["series", "week"], "left").select("series", "t", value.alias("value"))


def matrix_text(spark: SparkSession, path: str, step: str, start: str = "2000-01-01") -> DataFrame:
    """A text matrix (may be gzipped) of a column a series and a line a period, without times: they count from start.

    Lines are numbered by their place in the file, which one task reads, as a gzipped file is read anyway.
    """
    whole = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\s+$", ""), "\n").alias("lines"))
    lines = whole.select(F.posexplode("lines").alias("t", "line")).select("t", F.split("line", ",").alias("cells"))
    cells = lines.select("t", F.posexplode("cells").alias("column", "value"))
    period = F.expr(f"timestamp '{start}' + t * interval {step}")
    return cells.select(F.concat(F.lit("column_"), F.lpad((F.col("column") + 1).cast("string"), 3, "0")).alias("series"), "t", period.alias("period"), F.trim("value").cast("double").alias("value"))


def ett(spark: SparkSession, path: str, column: str = "OT") -> DataFrame:
    """One column of a transformer-temperature file."""
    return _csv(spark, path).select(F.lit(column).alias("series"), F.to_timestamp("date").alias("period"), F.col(column).cast("double").alias("value"))


def beijing(spark: SparkSession, path: str) -> DataFrame:
    """Hourly PM2.5 by station from the archive's CSV files; gaps take the value before, with `observed`."""
    rows = _csv(spark, path, nullValue="NA", pathGlobFilter="*.csv", recursiveFileLookup=True)
    whole = [F.col(c).cast("int") for c in ("year", "month", "day", "hour")]
    long = rows.select(F.col("station").alias("series"), F.make_timestamp(*whole, F.lit(0), F.lit(0.0)).alias("period"), F.col("`PM2.5`").cast("double").alias("value"))
    return filled(long, "1 hour")


def bike(spark: SparkSession, path: str) -> DataFrame:
    """Hourly rentals; absent hours take the value before, with `observed`."""
    rows = _csv(spark, path)
    period = F.to_timestamp("dteday") + F.make_dt_interval(hours=F.col("hr").cast("int"))
    return filled(rows.select(F.lit("cnt").alias("series"), period.alias("period"), F.col("cnt").cast("double").alias("value")), "1 hour")


def favorita(spark: SparkSession, path: str) -> DataFrame:
    """Daily sales by store and family with the store's attributes; absent days take the value before, with `observed`."""
    sales = _csv(spark, f"{path}/train.csv").select("date", "store_nbr", "family", "sales")
    known = sales.join(_csv(spark, f"{path}/stores.csv"), "store_nbr", "left")
    keys = ["series", *FAVORITA_ATTRIBUTES]
    long = known.select(F.concat_ws(":", "store_nbr", "family").alias("series"), *FAVORITA_ATTRIBUTES, F.to_timestamp("date").alias("period"), F.col("sales").cast("double").alias("value"))
    attributes = long.select(*keys).dropDuplicates(["series"])
    return filled(long, "1 day").join(attributes, "series")


def freshretail(spark: SparkSession, train: str, evaluation: str, attributes: list[str]) -> DataFrame:
    """Daily sales by store and product of both files, `censored` where an hour from 6 to 22 was out of stock."""
    columns = [*attributes, "dt", "sale_amount", "stock_hour6_22_cnt"]
    rows = spark.read.parquet(train).select(*columns).unionByName(spark.read.parquet(evaluation).select(*columns))
    return rows.select(
        F.concat_ws(":", "store_id", "product_id").alias("series"), *attributes, F.to_timestamp("dt").alias("period"), F.col("sale_amount").cast("double").alias("value"), (F.col("stock_hour6_22_cnt") > 0).alias("censored")
    )

