"""The registered queries of the forecasting engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranks, scores
from ..operators import calibrate, covariates, decision, forecast, hierarchy, metrics, resample, rolling
from ..sources import panel as panels

SEASON, HORIZON, FIRST, LAST, WINDOW, LEVEL = 52, 4, 200, 349, 52, 0.9
LEVELS = [["p_type"], ["r_name"]]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---------------------------------------------------------------- shared plans


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return panels.shipped_quantity(spark, sf)


def _edges(panel: DataFrame) -> DataFrame:
    return hierarchy.edges(panel.select("series", "p_type", "r_name").distinct(), LEVELS)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(node, t, value) of every node, worked out once and shared by what follows."""
    p = _panel(spark, sf)
    return hierarchy.aggregate(p, _edges(p))


def _bottoms(spark: SparkSession, sf: str) -> DataFrame:
    return _panel(spark, sf).select(F.col("series").alias("node"), "t", "value")


def _steps(nodes: DataFrame) -> DataFrame:
    return forecast.residuals(forecast.seasonal_naive(nodes, SEASON, HORIZON, FIRST, LAST), nodes)


def _issues(nodes: DataFrame, score: scores.Score = scores.ABSOLUTE) -> DataFrame:
    steps = scores.step_columns(_steps(nodes), ["node", "origin"])
    return steps.withColumn("score", score.score(F.col("target"), F.col("point")))


def _lead(nodes: DataFrame, lead: int, score: scores.Score) -> DataFrame:
    cols = scores.lead_time_columns(_steps(nodes), ["node", "origin"], lead)
    return cols.withColumn("score", score.score(F.col("target"), F.col("point")))


def _band(issued: DataFrame, score: scores.Score = scores.ABSOLUTE) -> DataFrame:
    lo, hi = score.bound(F.col("threshold"), F.col("point"), *[F.col(c) for c in ("q_lo", "q_hi") if c in issued.columns])
    return issued.withColumn("lower", lo).withColumn("upper", hi)


BASE = """
WITH item AS (
  SELECT p_type, r_name, date_trunc('week', l_shipdate) AS period, l_quantity FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cells AS (SELECT p_type, r_name, CAST(period AS TIMESTAMP) AS period, sum(l_quantity) AS v FROM item GROUP BY 1, 2, 3),
cal AS (SELECT unnest(generate_series((SELECT min(period) FROM cells), (SELECT max(period) FROM cells), INTERVAL 7 DAY)) AS period),
attr AS (SELECT DISTINCT p_type || '/' || r_name AS series, p_type, r_name FROM cells),
panel AS (
  SELECT series, a.p_type, a.r_name, CAST(date_diff('day', (SELECT min(period) FROM cal), cal.period) // 7 AS INTEGER) AS t,
         cal.period AS period, coalesce(v, 0.0) AS value
  FROM attr a CROSS JOIN cal LEFT JOIN cells c ON c.p_type = a.p_type AND c.r_name = a.r_name AND c.period = cal.period),
edge AS (
  SELECT series AS node, 0 AS level, series FROM attr UNION ALL SELECT 'p_type=' || p_type, 1, series FROM attr
  UNION ALL SELECT 'r_name=' || r_name, 2, series FROM attr UNION ALL SELECT 'total', 3, series FROM attr),
nodes AS (SELECT node, t, sum(value) AS value FROM panel JOIN edge USING (series) GROUP BY 1, 2)"""
FORECAST = (
    BASE
    + f""",
steps AS (
  SELECT o.node, o.t AS origin, h, p.value AS point, y.value AS target
  FROM nodes o CROSS JOIN (SELECT CAST(unnest(range(1, {HORIZON + 1})) AS INTEGER) AS h) k
  JOIN nodes p ON p.node = o.node AND p.t = o.t - {SEASON} + 1 + (h - 1) % {SEASON}
  LEFT JOIN nodes y ON y.node = o.node AND y.t = o.t + h WHERE o.t BETWEEN {FIRST} AND {LAST}),
issues AS (SELECT node, origin, h AS c, h AS last_step, point, target, abs(target - point) AS score, target - point AS signed FROM steps),
lead2 AS (
  SELECT node, origin, 1 AS c, 2 AS last_step, CASE WHEN count(point) = 2 THEN sum(point) END AS point,
         CASE WHEN count(target) = 2 THEN sum(target) END AS target FROM steps WHERE h <= 2 GROUP BY 1, 2)"""
)


def _known(source: str = "issues", score: str = "score", window: int = WINDOW) -> str:
    return f""",
known AS (
  SELECT i.node, i.c, i.origin, r.origin AS u, r.{score} AS s,
         row_number() OVER (PARTITION BY i.node, i.c, i.origin ORDER BY r.origin DESC) AS age
  FROM {source} i JOIN {source} r ON r.node = i.node AND r.c = i.c AND r.origin + r.last_step <= i.origin AND r.{score} IS NOT NULL
  QUALIFY age <= {window}),
sorted AS (SELECT node, c, origin, list(s ORDER BY s) AS hist FROM known GROUP BY 1, 2, 3)"""


def _rank(level: str = str(LEVEL)) -> str:
    r = f"CAST(ceil((len(hist) + 1) * CAST({level} AS DOUBLE)) AS BIGINT)"
    return f"CASE WHEN {r} <= len(hist) THEN hist[{r}] END"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- panels and hierarchy


@query(BASE + " SELECT series, t, period, value FROM panel")
def panel_weekly(spark, sf):
    return _panel(spark, sf).select("series", "t", "period", "value")


@query(
    BASE
    + """ SELECT 'missing' AS rule, CAST(count(DISTINCT series) * count(DISTINCT period) - count(*) AS BIGINT) AS n FROM panel
UNION ALL SELECT 'doubled', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT series, period FROM panel)) AS BIGINT) FROM panel
UNION ALL SELECT 'not finite', CAST(count(*) FILTER (WHERE value IS NULL OR NOT isfinite(value)) AS BIGINT) FROM panel"""
)
def panel_validation(spark, sf):
    return panels.validate(_panel(spark, sf))


EVENTS = """
WITH c AS (SELECT event_type AS series, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2),
cal AS (SELECT unnest(generate_series((SELECT min(period) FROM c), (SELECT max(period) FROM c), INTERVAL 1 HOUR)) AS period),
grid AS (SELECT series, cal.period, CAST(date_diff('hour', (SELECT min(period) FROM cal), cal.period) AS INTEGER) AS t, v
  FROM (SELECT DISTINCT series FROM c) s CROSS JOIN cal LEFT JOIN c USING (series, period))"""


@query(
    EVENTS
    + """ SELECT series, t, last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS value, v IS NOT NULL AS observed
FROM grid QUALIFY t >= (SELECT max(f) FROM (SELECT min(t) AS f FROM grid WHERE v IS NOT NULL GROUP BY series))"""
)
def panel_ffill_observed(spark, sf):
    return panels.forward_fill(panels.event_hours(spark, sf, None)).select("series", "t", "value", "observed")


@query(EVENTS + " SELECT series, t, coalesce(v, 0.0) AS value FROM grid")
def panel_event_hours(spark, sf):
    return panels.event_hours(spark, sf).select("series", "t", "value")


@query(BASE + " SELECT CAST(row_number() OVER (ORDER BY level, node) - 1 AS INTEGER) AS idx, node, CAST(level AS INTEGER) AS level, n_leaves FROM (SELECT node, level, CAST(count(*) AS BIGINT) AS n_leaves FROM edge GROUP BY 1, 2)")
def hierarchy_nodes(spark, sf):
    return hierarchy.nodes(_edges(_panel(spark, sf)))


@query(BASE + " SELECT node, t, value FROM nodes")
def hierarchy_aggregate(spark, sf):
    return _nodes(spark, sf).select("node", "t", "value")


@query(BASE + " SELECT node, t, bool_or(value >= 2 * m) AS high FROM panel JOIN (SELECT series, avg(value) AS m FROM panel GROUP BY 1) USING (series) JOIN edge USING (series) GROUP BY 1, 2")
def hierarchy_any_bottom(spark, sf):
    p = _panel(spark, sf)
    flagged = p.withColumn("high", F.col("value") >= 2 * F.avg("value").over(Window.partitionBy("series")))
    return hierarchy.any_bottom(flagged, _edges(p), "high")


@query(BASE + " SELECT node, t, round(avg(value), 6) AS value FROM panel JOIN edge USING (series) GROUP BY 1, 2")
def covariate_node_mean(spark, sf):
    p = _panel(spark, sf)
    own = covariates.Covariate(p.select("series", "t", "value"), aggregate="mean")
    return covariates.on_nodes(own, _edges(p)).select("node", "t", F.round("value", 6).alias("value"))


@query(BASE + f" SELECT series, t, round((value - c) / CASE WHEN d > 0 THEN d ELSE 1 END, 6) AS value FROM panel JOIN (SELECT series, avg(value) AS c, stddev_pop(value) AS d FROM panel WHERE t < {FIRST} GROUP BY 1) USING (series)")
def panel_scaled(spark, sf):
    p = _panel(spark, sf)
    return panels.scaled(p, panels.scaling(p, FIRST)).select("series", "t", F.round("value", 6).alias("value"))


@query(EVENTS + " SELECT CAST((SELECT max(f) FROM (SELECT min(t) AS f FROM grid WHERE v IS NOT NULL GROUP BY series)) - min(t) AS BIGINT) AS dropped FROM grid")
def panel_dropped(spark, sf):
    return panels.dropped_periods(panels.event_hours(spark, sf, None))


@query(
    BASE
    + """, flag AS (SELECT node, t, bool_or(value >= 2 * m) AS high FROM panel JOIN (SELECT series, avg(value) AS m FROM panel GROUP BY 1) USING (series) JOIN edge USING (series) GROUP BY 1, 2)
SELECT node, t, CASE WHEN NOT high THEN value END AS target FROM nodes JOIN flag USING (node, t)"""
)
def target_masked(spark, sf):
    p = _panel(spark, sf)
    edge = _edges(p)
    flags = hierarchy.any_bottom(p.withColumn("high", F.col("value") >= 2 * F.avg("value").over(Window.partitionBy("series"))), edge, "high")
    return hierarchy.aggregate(p, edge).join(flags, ["node", "t"]).select("node", "t", scores.mask(F.col("value"), F.col("high")).alias("target"))


@query(
    BASE
    + """ SELECT series, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS excess_kurtosis,
CAST(count(DISTINCT value) AS BIGINT) AS n_unique, CAST(count(*) - count(DISTINCT value) AS BIGINT) AS repeats FROM panel GROUP BY 1"""
)
def describe_panel(spark, sf):
    return metrics.describe(_panel(spark, sf), ["series"])


# ---------------------------------------------------------------- forecasts


@query(FORECAST + " SELECT node, origin, h, point FROM steps")
def fc_seasonal_naive(spark, sf):
    return forecast.seasonal_naive(_nodes(spark, sf), SEASON, HORIZON, FIRST, LAST)


@query(BASE + f" SELECT node, t AS origin, h, round(point, 6) AS point FROM (SELECT node, t, avg(value) OVER (PARTITION BY node ORDER BY t ROWS 7 PRECEDING) AS point FROM nodes) CROSS JOIN (SELECT CAST(unnest(range(1, {HORIZON + 1})) AS INTEGER) AS h) WHERE t BETWEEN {FIRST} AND {LAST}")
def fc_window_average(spark, sf):
    return forecast.window_average(_nodes(spark, sf), 8, HORIZON, FIRST, LAST).withColumn("point", F.round("point", 6))


AR1 = (
    BASE
    + f""", pairs AS (SELECT node, t, value AS y, lag(value) OVER (PARTITION BY node ORDER BY t) AS x FROM nodes),
sums AS (SELECT node, t, y, regr_slope(y, x) OVER w AS slope, regr_avgx(y, x) OVER w AS mx, regr_avgy(y, x) OVER w AS my FROM pairs WINDOW w AS (PARTITION BY node ORDER BY t ROWS UNBOUNDED PRECEDING)),
fit AS (SELECT *, greatest(-0.99, least(0.99, CASE WHEN isfinite(slope) THEN slope ELSE 0 END)) AS phi FROM sums),
ar AS (SELECT node, t AS origin, h, mu + phi ** h * (y - mu) AS point
  FROM (SELECT *, (my - phi * mx) / (1 - phi) AS mu FROM fit) CROSS JOIN (SELECT CAST(unnest(range(1, {HORIZON + 1})) AS INTEGER) AS h) WHERE t BETWEEN {FIRST} AND {LAST})"""
)


@query(AR1 + " SELECT node, origin, h, round(point, 4) AS point FROM ar")
def fc_ar1(spark, sf):
    return forecast.ar1(_nodes(spark, sf), HORIZON, FIRST, LAST).withColumn("point", F.round("point", 4))


@query(FORECAST + " SELECT e.node, origin, h, sum(point) AS point FROM steps s JOIN edge e ON s.node = e.series GROUP BY 1, 2, 3")
def fc_bottom_up(spark, sf):
    p = _panel(spark, sf)
    base = forecast.seasonal_naive(p.select(F.col("series").alias("node"), "t", "value"), SEASON, HORIZON, FIRST, LAST)
    return hierarchy.bottom_up(base.withColumnRenamed("node", "series"), _edges(p))


@query(FORECAST + " SELECT node, origin, h, round(point, 4) AS point FROM steps")
def fc_wls_struct(spark, sf):
    """Seasonal naive points of all nodes are coherent already, so reconciling leaves them as they are."""
    p = _panel(spark, sf)
    nodes = hierarchy.aggregate(p, _edges(p))
    base = forecast.seasonal_naive(nodes, SEASON, HORIZON, FIRST, LAST)
    return hierarchy.wls_struct(base, _edges(p)).withColumn("point", F.round("point", 4))


def _grid_inverse(types: int, regions: int) -> str:
    """VALUES (level, other level, the same node, weight): the inverse of the constraints' matrix of a full grid, by kinds of nodes."""
    under = np.zeros((types + regions + 1, types * regions))
    for a in range(types):
        for b in range(regions):
            under[[a, types + b, -1], a * regions + b] = 1
    inverse, level = np.linalg.inv(under @ under.T + np.diag(under.sum(1))), [1] * types + [2] * regions + [3]
    kinds = {(level[a], level[b], a == b): float(inverse[a, b]) for a in range(len(level)) for b in range(len(level))}
    return ", ".join(f"({a}, {b}, {same}, {w!r}::DOUBLE)" for (a, b, same), w in kinds.items())


@query(
    AR1
    + f""", k(l1, l2, same, w) AS (VALUES {_grid_inverse(6, 5)}),
off AS (SELECT e.node, e.level, b.origin, b.h, sum(b.point) - max(u.point) AS off, count(*) AS leaves
  FROM edge e JOIN ar b ON b.node = e.series JOIN ar u ON u.node = e.node AND u.origin = b.origin AND u.h = b.h WHERE e.level > 0 GROUP BY 1, 2, 3, 4),
mult AS (SELECT a.node, a.origin, a.h, max(a.leaves) AS leaves, sum(w * b.off) AS m FROM off a JOIN off b USING (origin, h) JOIN k ON l1 = a.level AND l2 = b.level AND same = (a.node = b.node) GROUP BY 1, 2, 3),
down AS (SELECT e.series AS node, origin, h, sum(m) AS m FROM mult JOIN edge e ON e.node = mult.node AND e.level > 0 GROUP BY 1, 2, 3)
SELECT a.node, a.origin, a.h, round(a.point + coalesce(mult.leaves * mult.m, 0) - coalesce(down.m, 0), 4) AS point
FROM ar a LEFT JOIN mult USING (node, origin, h) LEFT JOIN down ON down.node = a.node AND down.origin = a.origin AND down.h = a.h"""
)
def fc_wls_window(spark, sf):
    """AR1 points of all nodes, which are not coherent, reconciled."""
    p = _panel(spark, sf)
    base = forecast.ar1(hierarchy.aggregate(p, _edges(p)), HORIZON, FIRST, LAST)
    return hierarchy.wls_struct(base, _edges(p)).withColumn("point", F.round("point", 4))


@query(
    BASE
    + f""" SELECT n.node, n.t AS origin, h, n.value + leaves * ((n.t + h) % 13 - n.t % 13) AS point
FROM nodes n JOIN (SELECT node, count(*) AS leaves FROM edge GROUP BY 1) USING (node) CROSS JOIN (SELECT CAST(unnest(range(1, {HORIZON + 1})) AS INTEGER) AS h) WHERE n.t BETWEEN {FIRST} AND {LAST}"""
)
def fc_rolling_bottom_up(spark, sf):
    """The rolling driver: the last value moved by a calendar covariate that is known ahead, on the bottoms, summed up."""
    p = _panel(spark, sf)
    calendar = spark.range(LAST + HORIZON + 1).select(F.col("id").cast("int").alias("t"), (F.col("id") % 13).cast("double").alias("value"))

    def guess(seen):
        x = seen.x["phase"]
        return seen.y[-1] + x[-seen.horizon :] - x[-seen.horizon - 1]

    known = {"phase": covariates.Covariate(calendar, known_ahead=True)}
    return rolling.rolling_forecasts(p, _edges(p), rolling.Plain(guess), rolling.BOTTOM_UP, list(range(FIRST, LAST + 1)), HORIZON, 50, known).points


@query()
def fc_lag_covariates(spark, sf):
    """The global regression with a mean of lags and two covariates, refitted each 75 origins."""
    p = _panel(spark, sf)
    edge = _edges(p)
    calendar = spark.range(LAST + HORIZON + 1).select(F.col("id").cast("int").alias("t"), F.sin(F.col("id") * 2 * np.pi / 52).alias("value"))
    known = {"season": covariates.Covariate(calendar, known_ahead=True), "size": covariates.Covariate(p.filter(F.col("t") < FIRST).groupBy("series").agg(F.avg("value").alias("value")), aggregate="sum")}
    return forecast.lag_regression(hierarchy.aggregate(p, edge), [1, 2, 52], HORIZON, FIRST, LAST, ((1, 8),), known, edge, 75)


@query()
def fc_global_network(spark, sf):
    """Native quantiles of one small network for all bottoms, refitted each 75 origins."""
    fit = forecast.lag_network(13, HORIZON, quantiles=(0.05, 0.5, 0.95))
    return forecast.global_model(_bottoms(spark, sf), fit, HORIZON, FIRST, LAST, 75, 156, 13, outputs=("q_lo", "point", "q_hi"))


@query()
def fc_bootstrap(spark, sf):
    p = _panel(spark, sf)
    done = rolling.rolling_forecasts(p, hierarchy.flat(p), rolling.BootstrapEnsemble(4), rolling.IDENTITY, list(range(FIRST, LAST + 1)), 1, initial_residuals=True)
    return done.points.select("node", "origin", "h", "point", F.lit(None).cast("double").alias("residual")).union(done.residuals.select("node", "origin", "h", F.lit(None).cast("double"), "residual"))


@query()
def fc_lag_regression(spark, sf):
    return forecast.lag_regression(_nodes(spark, sf), [1, 2, 52], HORIZON, FIRST, LAST)


@query(FORECAST + f" SELECT node, origin, h, avg_ AS point FROM (SELECT s.node, s.origin, s.h, n.value AS avg_ FROM steps s JOIN nodes n ON n.node = s.node AND n.t = s.origin)")
def fc_local_model(spark, sf):
    return forecast.local_model(_nodes(spark, sf), lambda y, h: np.repeat(y[-1], h), HORIZON, FIRST, LAST)


@query(FORECAST + " SELECT node, origin, h, point, target, target - point AS residual FROM steps")
def residuals(spark, sf):
    return _steps(_nodes(spark, sf)).withColumn("residual", F.col("target") - F.col("point"))


@query(FORECAST + " SELECT h, round(sqrt(avg((target - point) ** 2)), 6) AS rmse, round(avg(abs(target - point)), 6) AS mae, round(avg(target - point), 6) AS bias FROM steps GROUP BY 1")
def point_errors(spark, sf):
    out = metrics.point_errors(_steps(_nodes(spark, sf)), ["h"])
    return out.select("h", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "bias")])


# ---------------------------------------------------------------- targets, scores, calibrators


@query(FORECAST + " SELECT node, origin, point, target FROM lead2")
def target_lead_time(spark, sf):
    return scores.lead_time_columns(_steps(_nodes(spark, sf)), ["node", "origin"], 2).select("node", "origin", "point", "target")


@query(FORECAST + " SELECT node, c, origin, score FROM issues")
def score_absolute(spark, sf):
    return _issues(_nodes(spark, sf)).select("node", "c", "origin", "score")


@query(FORECAST + " SELECT node, c, origin, signed AS score FROM issues")
def score_signed(spark, sf):
    return _issues(_nodes(spark, sf), scores.SIGNED).select("node", "c", "origin", "score")


@query(FORECAST + _known(window=10**6) + " SELECT i.node, i.c, i.origin, CAST(count(k.u) AS BIGINT) AS n_known FROM issues i LEFT JOIN known k USING (node, c, origin) GROUP BY 1, 2, 3")
def feedback_counts(spark, sf):
    return calibrate.with_history(_issues(_nodes(spark, sf)), WINDOW).select("node", "c", "origin", F.coalesce("n_known", F.lit(0).cast("long")).alias("n_known"))


SPLIT = FORECAST + _known() + f", issued AS (SELECT i.*, {_rank()} AS threshold FROM issues i LEFT JOIN sorted USING (node, c, origin))"
BANDS = SPLIT + ", band AS (SELECT *, point - threshold AS lower, point + threshold AS upper FROM issued)"


def _split_band(spark, sf):
    return _band(calibrate.split(_issues(_nodes(spark, sf)), LEVEL, WINDOW))


@query(BANDS + " SELECT node, c, origin, threshold IS NOT NULL AS ready, threshold, lower, upper FROM band")
def split_step_band(spark, sf):
    return _split_band(spark, sf).select("node", "c", "origin", F.col("threshold").isNotNull().alias("ready"), "threshold", "lower", "upper")


LEAD = FORECAST + ", lead AS (SELECT *, target - point AS score FROM lead2)"


@query(LEAD + _known("lead") + f" SELECT i.node, i.origin, {_rank()} AS threshold, point + {_rank()} AS upper FROM lead i LEFT JOIN sorted USING (node, c, origin)")
def split_lead_time_bound(spark, sf):
    return _band(calibrate.split(_lead(_nodes(spark, sf), 2, scores.SIGNED), LEVEL, WINDOW), scores.SIGNED).select("node", "origin", "threshold", "upper")


@query(
    FORECAST
    + f""", lv AS (SELECT node, min(level) AS pool FROM edge GROUP BY 1), p AS (SELECT * FROM issues JOIN lv USING (node)),
rows_ AS (SELECT DISTINCT pool, c, last_step, origin FROM p WHERE score IS NOT NULL),
keep AS (SELECT i.pool, i.c, i.origin, r.origin AS u FROM (SELECT DISTINCT pool, c, origin FROM p) i JOIN rows_ r ON r.pool = i.pool AND r.c = i.c AND r.origin + r.last_step <= i.origin
  QUALIFY row_number() OVER (PARTITION BY i.pool, i.c, i.origin ORDER BY r.origin DESC) <= 8),
sorted AS (SELECT k.pool, k.c, k.origin, list(score ORDER BY score) AS hist FROM keep k JOIN p ON p.pool = k.pool AND p.c = k.c AND p.origin = k.u AND score IS NOT NULL GROUP BY 1, 2, 3)
SELECT node, p.c, p.origin, {_rank()} AS threshold FROM p LEFT JOIN sorted s ON s.pool = p.pool AND s.c = p.c AND s.origin = p.origin"""
)
def split_pooled(spark, sf):
    p = _panel(spark, sf)
    edge = _edges(p)
    pools = edge.select("node", F.col("level").alias("pool")).distinct()
    return calibrate.split_pooled(_issues(hierarchy.aggregate(p, edge)), pools, LEVEL, 8).select("node", "c", "origin", "threshold")


@query(FORECAST + _known() + f" SELECT i.node, i.c, i.origin, {_rank('CASE WHEN i.node = ' + chr(39) + 'total' + chr(39) + ' THEN 0.8 ELSE 0.9 END')} AS threshold FROM issues i LEFT JOIN sorted USING (node, c, origin)")
def split_node_level(spark, sf):
    level = F.when(F.col("node") == "total", F.lit(0.8)).otherwise(F.lit(0.9))
    return calibrate.split(_issues(_nodes(spark, sf)), level, WINDOW).select("node", "c", "origin", "threshold")


@query(
    FORECAST
    + f""", seeds AS (SELECT node, c, CAST(k AS DOUBLE) AS score, k FROM (SELECT DISTINCT node, c FROM issues) CROSS JOIN (SELECT unnest(range(-20, 0)) AS k)),
fed AS (SELECT node, c, origin, last_step, score FROM issues UNION ALL SELECT node, c, k - 1000000, 0, score FROM seeds),
known AS (SELECT i.node, i.c, i.origin, r.score AS s FROM issues i JOIN fed r ON r.node = i.node AND r.c = i.c AND r.origin + r.last_step <= i.origin AND r.score IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY i.node, i.c, i.origin ORDER BY r.origin DESC) <= {WINDOW}),
sorted AS (SELECT node, c, origin, list(s ORDER BY s) AS hist FROM known GROUP BY 1, 2, 3)
SELECT i.node, i.c, i.origin, {_rank()} AS threshold FROM issues i LEFT JOIN sorted USING (node, c, origin)"""
)
def split_seeded(spark, sf):
    issues = _issues(_nodes(spark, sf))
    seeds = issues.select("node", "c").distinct().select("node", "c", F.explode(F.sequence(F.lit(-20), F.lit(-1))).alias("k")).withColumn("score", F.col("k").cast("double"))
    return calibrate.split(issues, LEVEL, WINDOW, seeds).select("node", "c", "origin", "threshold")


@query(
    FORECAST
    + f""", known AS (SELECT i.node, i.c, i.origin, r.score AS s FROM issues i JOIN issues r ON r.node = i.node AND r.c = i.c AND r.origin + r.last_step <= i.origin
  AND r.score IS NOT NULL AND r.origin > i.origin - 1 - 14 QUALIFY row_number() OVER (PARTITION BY i.node, i.c, i.origin ORDER BY r.origin DESC) <= 12),
sorted AS (SELECT node, c, origin, list(s ORDER BY s) AS hist FROM known GROUP BY 1, 2, 3)
SELECT i.node, i.c, i.origin, {_rank('0.85')} AS threshold FROM issues i LEFT JOIN sorted USING (node, c, origin)"""
)
def split_capacity(spark, sf):
    return calibrate.split_capacity(_issues(_nodes(spark, sf)), 0.85, 12, 14).select("node", "c", "origin", "threshold")


@query(
    FORECAST
    + _known()
    + """, w AS (SELECT *, pow(CAST(0.99 AS DOUBLE), age) AS w FROM known),
cum AS (SELECT *, sum(w) OVER (PARTITION BY node, c, origin ORDER BY s, w ROWS UNBOUNDED PRECEDING) AS cum, 1 + sum(w) OVER (PARTITION BY node, c, origin) AS mass FROM w),
hit AS (SELECT node, c, origin, min(s) AS threshold FROM cum WHERE cum >= CAST(0.9 AS DOUBLE) * mass GROUP BY 1, 2, 3)
SELECT i.node, i.c, i.origin, threshold FROM issues i LEFT JOIN hit USING (node, c, origin)"""
)
def nexcp_band(spark, sf):
    return calibrate.nexcp(_issues(_nodes(spark, sf)), LEVEL, 0.99, WINDOW).select("node", "c", "origin", "threshold")


def _interval_sql(level: float, grid: int) -> str:
    betas = [g * (1.0 / (grid - 1)) * (1 - level) if g < grid - 1 else 1 - level for g in range(grid)]
    at = lambda q: f"hist[CAST(least(greatest(ceil(len(hist) * CAST({q!r} AS DOUBLE)), 1), len(hist)) AS BIGINT)]"
    options = ", ".join(f"{{'w': {at(level + b)} - {at(b)}, 'k': {k}, 'lo': {at(b)}, 'hi': {at(level + b)}}}" for k, b in enumerate(betas))
    return f"list_min([{options}])"


@query(FORECAST + _known(score="signed") + f", best AS (SELECT node, c, origin, {_interval_sql(LEVEL, 21)} AS b FROM sorted) SELECT i.node, i.c, i.origin, b.lo AS t_lo, b.hi AS t_hi FROM issues i LEFT JOIN best USING (node, c, origin)")
def enbpi_interval(spark, sf):
    return calibrate.enbpi(_issues(_nodes(spark, sf), scores.SIGNED), LEVEL, WINDOW).select("node", "c", "origin", "t_lo", "t_hi")


GRID = [0.0, 50.0, 100.0, 200.0, 400.0, 800.0, 1600.0, 3200.0, 6400.0]


@query(
    FORECAST
    + f""", g AS (SELECT CAST(unnest({GRID}) AS DOUBLE) AS theta),
fed AS (SELECT i.node, i.c, i.origin, theta, coalesce(sum(CASE WHEN r.score > theta THEN 1.0 ELSE 0.0 END), 0) AS risk, count(r.score) AS n
  FROM issues i CROSS JOIN g LEFT JOIN issues r ON r.node = i.node AND r.c = i.c AND r.origin + r.last_step <= i.origin AND r.target IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT node, c, origin, min(CASE WHEN risk + 1.0 <= CAST(0.1 AS DOUBLE) * (n + 1) THEN theta END) AS threshold, CAST(max(n) AS BIGINT) AS n_known FROM fed GROUP BY 1, 2, 3"""
)
def risk_control_miss(spark, sf):
    issues = _issues(_nodes(spark, sf))
    loss = lambda theta: scores.miss(F.col("target"), F.col("point") - theta, F.col("point") + theta)
    return calibrate.risk_control(issues, GRID, 0.1, loss).select("node", "c", "origin", "threshold", "n_known")


CQR_BASE = BASE + f""", hq AS (SELECT node, t AS origin, list(value) OVER (PARTITION BY node ORDER BY t ROWS 25 PRECEDING) AS y FROM nodes),
q AS (SELECT node, origin, list_sort(y) AS s FROM hq WHERE origin BETWEEN {FIRST} AND {LAST}),
issues AS (SELECT q.node, origin, h AS c, h AS last_step, v.value AS target, s[CAST(ceil(26 * CAST(0.1 AS DOUBLE)) AS BIGINT)] AS q_lo, s[CAST(ceil(26 * CAST(0.9 AS DOUBLE)) AS BIGINT)] AS q_hi
  FROM q CROSS JOIN (SELECT CAST(unnest(range(1, {HORIZON + 1})) AS INTEGER) AS h) k LEFT JOIN nodes v ON v.node = q.node AND v.t = q.origin + h),
scored AS (SELECT *, greatest(q_lo - target, target - q_hi) AS score FROM issues WHERE target IS NOT NULL UNION ALL SELECT *, NULL FROM issues WHERE target IS NULL)"""


@query(CQR_BASE + _known("scored") + f" SELECT i.node, i.c, i.origin, i.q_lo - {_rank()} AS lower, i.q_hi + {_rank()} AS upper FROM scored i LEFT JOIN sorted USING (node, c, origin)")
def cqr_band(spark, sf):
    nodes = _nodes(spark, sf)
    steps = forecast.residuals(forecast.history_quantiles(nodes, 26, 0.1, 0.9, HORIZON, FIRST, LAST), nodes)
    cols = scores.step_columns(steps, ["node", "origin"])
    scored = cols.withColumn("score", F.when(F.col("target").isNotNull(), scores.CQR.score(F.col("target"), F.col("point"), F.col("q_lo"), F.col("q_hi"))))
    return _band(calibrate.split(scored, LEVEL, WINDOW), scores.CQR).select("node", "c", "origin", "lower", "upper")


RECURSIVE = FORECAST.replace("WITH item", "WITH RECURSIVE item")
#: Whether the target of `c` origins ago, f, was outside the bounds that the last thresholds gave; NULL where none was issued.
MISSED = "CASE WHEN f.target BETWEEN f.point - r.past[-o.c] AND f.point + r.past[-o.c] THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"


@query(
    RECURSIVE
    + f""", run AS (SELECT node, c, origin, 0.0::DOUBLE AS theta, [0.0::DOUBLE] AS past FROM issues WHERE origin = {FIRST}
  UNION ALL SELECT node, c, origin, theta, list_append(past[-3:], theta) FROM (
    SELECT o.node, o.c, o.origin, r.past, r.theta + CASE WHEN f.score IS NULL THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * ({MISSED} - (1 - 0.9::DOUBLE)) END AS theta
    FROM run r JOIN issues o ON o.node = r.node AND o.c = r.c AND o.origin = r.origin + 1 LEFT JOIN issues f ON f.node = o.node AND f.c = o.c AND f.origin = o.origin - o.c))
SELECT node, c, origin, round(theta, 6) AS threshold FROM run"""
)
def tracker_bound(spark, sf):
    done = calibrate.fold(_issues(_nodes(spark, sf)), lambda: calibrate.Tracker(0.9, 100.0))
    return done.select("node", "c", "origin", F.round("threshold", 6).alias("threshold"))


_ACI = "CASE WHEN work >= 1 THEN 'inf'::DOUBLE WHEN work <= 0 THEN '-inf'::DOUBLE ELSE coalesce(CASE WHEN ceil((n + 1) * greatest(1e-6, least(1 - 1e-6, work))) <= n THEN hist[CAST(ceil((n + 1) * greatest(1e-6, least(1 - 1e-6, work))) AS BIGINT)] END, 'inf'::DOUBLE) END"


@query(
    RECURSIVE
    + _known().replace("known AS", "known AS MATERIALIZED", 1)
    + f""", own AS MATERIALIZED (SELECT i.*, coalesce(len(hist), 0) AS n, hist FROM issues i LEFT JOIN sorted USING (node, c, origin)),
run AS (SELECT node, c, origin, 0.9::DOUBLE AS work, 'inf'::DOUBLE AS theta, ['inf'::DOUBLE] AS past FROM own WHERE origin = {FIRST}
  UNION ALL SELECT node, c, origin, work, {_ACI} AS theta, list_append(past[-3:], {_ACI}) FROM (
    SELECT o.node, o.c, o.origin, o.n, o.hist, r.past, r.work + CASE WHEN f.score IS NULL THEN 0.0::DOUBLE ELSE 0.01::DOUBLE * ({MISSED} - (1 - 0.9::DOUBLE)) END AS work
    FROM run r JOIN own o ON o.node = r.node AND o.c = r.c AND o.origin = r.origin + 1 LEFT JOIN issues f ON f.node = o.node AND f.c = o.c AND f.origin = o.origin - o.c))
SELECT node, c, origin, isfinite(theta) AS ready, CASE WHEN isfinite(theta) THEN theta END AS threshold, CASE WHEN isfinite(theta) THEN point - theta END AS lower, CASE WHEN isfinite(theta) THEN point + theta END AS upper
FROM run JOIN issues USING (node, c, origin)"""
)
def aci_band(spark, sf):
    return _band(calibrate.fold(_issues(_nodes(spark, sf)), lambda: calibrate.Adaptive(LEVEL, 0.01, WINDOW))).select("node", "c", "origin", "ready", "threshold", "lower", "upper")


SEEDS = 26


@query(
    RECURSIVE
    + f""", seed AS MATERIALIZED (SELECT node, c, greatest(stddev_pop(score), 0.1::DOUBLE * avg(score), 1e-8::DOUBLE) AS scale, list(score ORDER BY score)[CAST(ceil({SEEDS} * 0.9::DOUBLE) AS BIGINT)] AS p0
  FROM issues WHERE origin < {FIRST + SEEDS} GROUP BY 1, 2),
run AS (SELECT node, c, {FIRST + SEEDS - 1} + c AS origin, scale, p0 AS p, 0.0::DOUBLE AS e, 0 AS n, p0 AS theta, [p0] AS past FROM seed
  UNION ALL SELECT node, c, origin, scale, p, e, n, p + 0.1::DOUBLE * scale * tan(e * ln(n + 1) / (5.0::DOUBLE * (n + 1))) AS theta,
    list_append(past[-3:], p + 0.1::DOUBLE * scale * tan(e * ln(n + 1) / (5.0::DOUBLE * (n + 1)))) FROM (
    SELECT node, c, origin, scale, past, p + 0.05::DOUBLE * scale * err AS p, e + err AS e, n + fed AS n FROM (
      SELECT o.node, o.c, o.origin, r.scale, r.past, r.p, r.e, r.n, CASE WHEN f.score IS NULL THEN 0 ELSE 1 END AS fed, CASE WHEN f.score IS NULL THEN 0.0::DOUBLE ELSE {MISSED} - (1 - 0.9::DOUBLE) END AS err
      FROM run r JOIN issues o ON o.node = r.node AND o.c = r.c AND o.origin = r.origin + 1
      LEFT JOIN issues f ON f.node = o.node AND f.c = o.c AND f.origin = o.origin - o.c AND f.origin >= {FIRST + SEEDS - 1} + f.c)))
SELECT i.node, i.c, i.origin, theta IS NOT NULL AS ready, round(theta, 4) AS threshold, round(point - theta, 4) AS lower, round(point + theta, 4) AS upper FROM issues i LEFT JOIN run USING (node, c, origin)"""
)
def pid_band(spark, sf):
    band = _band(calibrate.fold(_issues(_nodes(spark, sf)), lambda: calibrate.ConformalPID(LEVEL), seed_rows=SEEDS))
    return band.select("node", "c", "origin", "ready", *[F.round(x, 4).alias(x) for x in ("threshold", "lower", "upper")])


@query()
def spci_interval(spark, sf):
    return calibrate.spci(_issues(_nodes(spark, sf), scores.SIGNED), LEVEL, 64, 4).select("node", "c", "origin", "ready", "t_lo", "t_hi")


# ---------------------------------------------------------------- metrics and decisions


@query(BANDS + " SELECT node, c, origin, CASE WHEN target IS NULL OR threshold IS NULL THEN NULL ELSE target BETWEEN lower AND upper END AS covered FROM band")
def replay_covered(spark, sf):
    b = _split_band(spark, sf)
    return b.select("node", "c", "origin", F.when(F.col("target").isNotNull() & F.col("threshold").isNotNull(), F.col("target").between(F.col("lower"), F.col("upper"))).alias("covered"))


@query(
    BANDS
    + """ SELECT c, round(avg(CASE WHEN target BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(upper - lower), 6) AS width,
round(avg(upper - lower + 2 / (1 - CAST(0.9 AS DOUBLE)) * (greatest(lower - target, 0) + greatest(target - upper, 0))), 6) AS interval_score,
round(avg(greatest(0.9 * (target - upper), (0.9 - 1) * (target - upper))), 6) AS pinball,
round(avg(0.2 * greatest(upper - target, 0) + 1.0 * greatest(target - upper, 0)), 6) AS newsvendor
FROM band WHERE target IS NOT NULL AND threshold IS NOT NULL GROUP BY 1"""
)
def metric_table(spark, sf):
    b = _split_band(spark, sf).filter("target is not null and threshold is not null")
    y, lo, hi = F.col("target"), F.col("lower"), F.col("upper")
    parts = {"coverage": metrics.coverage(y, lo, hi), "width": metrics.width(y, lo, hi), "interval_score": metrics.interval_score(y, lo, hi, LEVEL), "pinball": metrics.pinball(y, hi, 0.9), "newsvendor": metrics.newsvendor_cost(y, hi, 0.2, 1.0)}
    return b.groupBy("c").agg(*[F.round(v, 6).alias(k) for k, v in parts.items()])


@query(
    SPLIT
    + f""", sorted2 AS (SELECT node, c, origin, list(s ORDER BY s) AS hist FROM known WHERE age <= 20 GROUP BY 1, 2, 3),
both_ AS (SELECT 'split_52' AS method, target, point - threshold AS lower, point + threshold AS upper FROM issued
  UNION ALL SELECT 'split_20', target, point - {_rank()}, point + {_rank()} FROM issues LEFT JOIN sorted2 USING (node, c, origin))
SELECT method, round(avg(CASE WHEN lower IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS ready,
  round(avg(CASE WHEN target BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END) FILTER (WHERE target IS NOT NULL AND lower IS NOT NULL), 6) AS coverage,
  round(avg(upper - lower) FILTER (WHERE target IS NOT NULL), 6) AS width,
  round(avg(upper - lower + 2 / (1 - CAST(0.9 AS DOUBLE)) * (greatest(lower - target, 0) + greatest(target - upper, 0))) FILTER (WHERE target IS NOT NULL AND lower IS NOT NULL), 6) AS interval_score
FROM both_ GROUP BY 1"""
)
def compare_methods(spark, sf):
    issues = _issues(_nodes(spark, sf))
    table = metrics.compare({"split_52": _band(calibrate.split(issues, LEVEL, 52)), "split_20": _band(calibrate.split(issues, LEVEL, 20))}, LEVEL)
    return table.select("method", *[F.round(c, 6).alias(c) for c in ("ready", "coverage", "width", "interval_score")])


@query(
    FORECAST
    + ", lead AS (SELECT *, target - point AS score FROM lead2)"
    + _known("lead")
    + f""", lv AS (SELECT node, min(level) AS level FROM edge GROUP BY 1),
b AS (SELECT CAST(level AS INTEGER) AS level, target, point + {_rank()} AS upper FROM lead i JOIN lv USING (node) LEFT JOIN sorted USING (node, c, origin))
SELECT 'split' AS method, level, round(avg(CASE WHEN upper IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS ready, round(avg(CASE WHEN target <= upper THEN 1.0 ELSE 0.0 END) FILTER (WHERE target IS NOT NULL AND upper IS NOT NULL), 6) AS coverage,
  round(avg(greatest(0.9 * (target - upper), (0.9 - 1) * (target - upper))), 6) AS pinball FROM b GROUP BY 2"""
)
def compare_levels(spark, sf):
    """One-sided bounds of the lead time, by level of the hierarchy."""
    p = _panel(spark, sf)
    edge = _edges(p)
    bound = _band(calibrate.split(_lead(hierarchy.aggregate(p, edge), 2, scores.SIGNED), LEVEL, WINDOW), scores.SIGNED)
    table = metrics.compare({"split": bound.join(edge.select("node", "level").distinct(), "node")}, LEVEL, "level", one_sided=True)
    return table.select("method", "level", *[F.round(c, 6).alias(c) for c in ("ready", "coverage", "pinball")])


@query("SELECT c_custkey, round(CAST(0.5 AS DOUBLE) / (0.5 + (1 + c_nationkey)), 6) AS ratio FROM customer")
def critical_ratio(spark, sf):
    return panels.table(spark, sf, "customer").select("c_custkey", F.round(decision.critical_ratio(F.lit(1.0) + F.col("c_nationkey"), F.lit(0.5)), 6).alias("ratio"))


@query(LEAD + _known("lead") + f" SELECT i.node, i.origin, greatest(point + {_rank()} - (10.0 + 5.0 + 2.0), 0.0) AS ordered FROM lead i JOIN sorted USING (node, c, origin) WHERE {_rank()} IS NOT NULL")
def order_up_to(spark, sf):
    b = _band(calibrate.split(_lead(_nodes(spark, sf), 2, scores.SIGNED), LEVEL, WINDOW), scores.SIGNED).filter("upper is not null")
    return b.select("node", "origin", decision.order_up_to(F.col("upper"), F.lit(10.0), F.array(F.lit(5.0), F.lit(2.0))).alias("ordered"))


PLAY = (
    BASE.replace("WITH item", "WITH RECURSIVE item")
    + """, d AS (SELECT series, t - 200 AS period, value AS demand, CASE WHEN t < 206 THEN lag(value, 1) OVER (PARTITION BY series ORDER BY t) + 100 END AS bound FROM panel WHERE t BETWEEN 199 AND 207),
run AS (
  SELECT DISTINCT series, -1 AS period, 0.0::DOUBLE AS demand, 0.0::DOUBLE AS sales, 0.0::DOUBLE AS missed, 50.0::DOUBLE AS end_inventory, 20.0::DOUBLE AS p1, 10.0::DOUBLE AS p2, 0.0::DOUBLE AS ordered FROM d
  UNION ALL
  SELECT d.series, d.period, d.demand, least(r.end_inventory + r.p1, d.demand), d.demand - least(r.end_inventory + r.p1, d.demand),
    r.end_inventory + r.p1 - least(r.end_inventory + r.p1, d.demand), r.p2, coalesce(greatest(d.bound - (r.end_inventory + r.p1 + r.p2), 0.0), 0.0), coalesce(greatest(d.bound - (r.end_inventory + r.p1 + r.p2), 0.0), 0.0)
  FROM run r JOIN d ON d.series = r.series AND d.period = r.period + 1)"""
)


def _play(spark, sf):
    """Orders for six weeks up to last week's demand and 100 more, settled over eight, from some stock and orders under way."""
    last = F.lag("value").over(Window.partitionBy("series").orderBy("t"))
    p = _panel(spark, sf).filter("t between 199 and 207").withColumn("bound", F.when(F.col("t") < 206, last + 100)).filter("t >= 200")
    series = p.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("t", "bound", F.col("value").alias("demand")))).alias("periods"))
    return decision.play(series.withColumns({"on_hand": F.lit(50.0), "in_transit": F.array(F.lit(20.0), F.lit(10.0))}), 2, 0.2, 1.0)


@query(PLAY + " SELECT series, CAST(period AS INTEGER) AS period, demand, sales, missed, end_inventory, ordered, round(0.2 * end_inventory, 6) AS holding_cost, missed * 1.0 AS shortage_cost FROM run WHERE period >= 0")
def settle_play(spark, sf):
    return _play(spark, sf).withColumn("holding_cost", F.round("holding_cost", 6))


@query(PLAY + " SELECT round(sum(0.2 * end_inventory), 4) AS holding, round(sum(missed * 1.0), 4) AS shortage, round(sum(0.2 * end_inventory) + sum(missed * 1.0), 4) AS total FROM run WHERE period >= 0")
def play_costs(spark, sf):
    return decision.played_costs(_play(spark, sf)).select(*[F.round(c, 4).alias(c) for c in ("holding", "shortage", "total")])


PERIOD, FOLDS, BLOCK, REPLICATES = 5, [50, 50, 50], 10, 1000


def _losses(spark, sf):
    return _issues(_nodes(spark, sf)).filter("score is not null").select("node", "c", (F.col("origin") - FIRST).alias("place"), "score")


@query(
    FORECAST
    + ", l AS (SELECT node, c, origin, score, (origin - 200) % 5 AS phase FROM issues WHERE score IS NOT NULL), m AS (SELECT *, score - avg(score) OVER (PARTITION BY node, c) AS raw, score - avg(score) OVER (PARTITION BY node, c, phase) AS own FROM l)"
    + " UNION ALL ".join(
        f"{', z AS (' if k == 0 else ''}SELECT node, c, {lag} AS lag, raw, own, lag(raw, {lag}) OVER w AS rb, lag(own, {lag}) OVER w AS ob FROM m WINDOW w AS (PARTITION BY node, c ORDER BY origin)" for k, lag in enumerate((5, 35))
    )
    + ") SELECT node, c, lag, CAST(count(rb) AS BIGINT) AS n_pairs, round(sum(raw * rb) / sum(raw * raw), 6) AS raw_acf, round(sum(own * ob) / sum(own * own), 6) AS phase_acf FROM z GROUP BY 1, 2, 3"
)
def loss_acf(spark, sf):
    out = resample.autocorrelation(_losses(spark, sf), ["node", "c"], "place", "score", PERIOD)
    return out.select("node", "c", "lag", "n_pairs", F.round("raw_acf", 6).alias("raw_acf"), F.round("phase_acf", 6).alias("phase_acf"))


BOOTSTRAP = (
    FORECAST
    + f""", cyc AS (SELECT node, c, CAST((origin - {FIRST}) // {PERIOD} AS INTEGER) AS cycle, avg(score) AS loss FROM issues WHERE score IS NOT NULL GROUP BY 1, 2, 3),
drawn AS (SELECT r AS replicate, s AS slot, (CAST('0x' || substr(md5('42|' || r || '|' || (s // 2)), 1, 8) AS BIGINT) % 30 + s % 2) % 30 AS cycle
  FROM (SELECT unnest(range(1, {REPLICATES + 1})) AS r) CROSS JOIN (SELECT unnest(range(0, 30)) AS s) UNION ALL SELECT 0, s, s FROM (SELECT unnest(range(0, 30)) AS s)),
fold AS (SELECT node, c, replicate, slot // 10 AS fold, avg(loss) AS loss FROM cyc JOIN drawn USING (cycle) GROUP BY 1, 2, 3, 4),
draws AS (SELECT node, c, CAST(replicate AS INTEGER) AS replicate, avg(loss) AS loss FROM fold GROUP BY 1, 2, 3)"""
)


def _draws(spark, sf):
    return resample.block_bootstrap(_losses(spark, sf), ["node", "c"], "place", "score", PERIOD, FOLDS, BLOCK, REPLICATES)


@query(BOOTSTRAP + " SELECT node, c, replicate, round(loss, 6) AS loss FROM draws")
def block_bootstrap(spark, sf):
    """Mean loss of 150 origins as three folds of ten cycles, redrawn a thousand times from circular blocks of two cycles, alike for every node and step."""
    return _draws(spark, sf).withColumn("loss", F.round("loss", 6))


@query(
    BOOTSTRAP
    + """, s AS (SELECT node, c, max(loss) FILTER (WHERE replicate = 0) AS estimate, list(loss ORDER BY loss) FILTER (WHERE replicate > 0) AS v, avg(loss) FILTER (WHERE replicate > 0) AS mean FROM draws GROUP BY 1, 2)
SELECT node, c, round(estimate, 6) AS estimate, round(v[25], 6) AS lower, round(v[975], 6) AS upper, round(mean, 6) AS bootstrap_mean, round(mean - estimate, 6) AS bootstrap_bias, 'ok' AS status FROM s"""
)
def bootstrap_summary(spark, sf):
    table = resample.summary(_draws(spark, sf), ["node", "c"], REPLICATES)
    return table.select("node", "c", *[F.round(x, 6).alias(x) for x in ("estimate", "lower", "upper", "bootstrap_mean", "bootstrap_bias")], "status")


@query()
def stream_tracker(spark, sf):
    """The tracker over the issues as a stream, in batches of origins, restarted from its own state."""
    from ..streaming import online

    base = panels.scratch(spark, "stream")
    own = _issues(_nodes(spark, sf))
    issues = panels.kept(own.select("node", *[F.col(x).cast("int").alias(x) for x in ("c", "last_step", "origin")], "point", "target", "score"), "stream-issues")
    for part in ("origin < 275", "origin >= 275"):
        issues.filter(part).write.mode("append").parquet(base + "/in")
        stream = online.track(spark.readStream.schema(issues.schema).parquet(base + "/in"), 0.9, 100.0)
        stream.writeStream.format("parquet").option("checkpointLocation", base + "/state").trigger(availableNow=True).start(base + "/out").awaitTermination()
    return spark.read.schema(online.OUT).parquet(base + "/out").select("node", "c", "origin", F.round("threshold", 6).alias("threshold"))


ORACLE_SQL["stream_tracker"] = ORACLE_SQL["tracker_bound"]


@query(ORACLE_SQL["tracker_bound"])
def ledger_tracker(spark, sf):
    """The tracker through the ledger, all origins and steps: half of them, then the rest from the table that was saved."""
    from ..streaming import ledger

    base, cover, make = panels.scratch(spark, "ledger"), ledger.per_step(HORIZON), lambda c: calibrate.Tracker(0.9, 100.0)
    nodes = panels.kept(_nodes(spark, sf), "ledger-nodes")
    points = forecast.seasonal_naive(nodes, SEASON, HORIZON, FIRST, LAST)
    state, out = ledger.initial_state(nodes.select("node").distinct(), cover, make), None
    for at, after in ((FIRST, 275), (275, LAST + 1)):
        new = nodes.filter(F.col("t").between(at if at > FIRST else 0, after - 1))
        ledger.replay(state, list(range(at, after)), points, new, f"{base}/{at}", cover=cover, make=make)
        state = ledger.load_state(spark, f"{base}/{at}")
        made = ledger.issues(state).select("node", "c", "origin", F.round("threshold", 6).alias("threshold"))
        out = made if out is None else out.union(made)
    return out


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage and width of split-conformal bands of weekly shipments, by step."""
    return metric_table(spark, sf)
