"""Hierarchies: nodes and the bottoms under them, from attribute columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edges(attributes: DataFrame, levels: list[list[str]]) -> DataFrame:
    """(node, level, series): bottoms (level 0), one node for each value of a level's crossed columns, then the total.

    attributes has series and the columns.  A node whose members are those of a bottom or an earlier node, or of
    the total, is left out; level numbers keep their places.  Labels are col=value, crossed ones joined by /.
    """
    cols = sorted({c for level in levels for c in level} - {"series"})
    own = attributes.groupBy("series").agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in cols])
    # checked where it is computed: a series that is there twice stops the query
    own = own.withColumn("series", F.when(F.col("__n") == 1, F.col("series")).otherwise(F.raise_error(F.lit("series must be unique")).cast("string")))
    top = len(levels) + 1
    labels = [F.col("series"), *[F.concat_ws("/", *[F.concat(F.lit(c + "="), F.col(c)) for c in level]) for level in levels], F.lit("total")]
    nodes = F.array(*[F.struct(label.cast("string").alias("node"), F.lit(k).alias("level")) for k, label in enumerate(labels)])
    every = own.select(F.explode(nodes).alias("__x"), "series").select("__x.node", "__x.level", "series")
    # a member set is known by its size and two sums of hashes, which are added up before any exchange
    mark = lambda salt: F.sum(F.xxhash64("series", F.lit(salt)).cast("decimal(38,0)"))
    members = every.groupBy("node", "level").agg(F.struct(F.count(F.lit(1)), mark(1), mark(2)).alias("print"))
    first = Window.partitionBy("print").orderBy(F.when(F.col("level") == 0, 0).when(F.col("level") == top, 1).otherwise(2), "level", "node")
    kept = members.select("*", F.row_number().over(first).alias("r")).filter(f"r = 1 or level = 0 or level = {top}").select("node", "level")
    return every.join(kept, ["node", "level"])


def flat(panel: DataFrame) -> DataFrame:
    return panel.select("series").distinct().select(F.col("series").alias("node"), F.lit(0).alias("level"), "series")


def aggregate(panel: DataFrame, edge: DataFrame, value: str = "value", by: tuple[str, ...] = ("t",), how: str = "sum") -> DataFrame:
    """Sums (or means over bottoms) of the bottoms under each node; an edge list is as short as the hierarchy."""
    agg = {"sum": F.sum(value), "mean": F.sum(value) / F.count(F.lit(1))}[how]
    return panel.join(edge.select("node", "series"), "series").groupBy("node", *by).agg(agg.alias(value))


def any_bottom(panel: DataFrame, edge: DataFrame, flag: str, by: tuple[str, ...] = ("t",)) -> DataFrame:
    return panel.join(edge.select("node", "series"), "series").groupBy("node", *by).agg(F.bool_or(flag).alias(flag))


def bottom_up(base: DataFrame, edge: DataFrame) -> DataFrame:
    """Node points as sums of the bottoms' points; base has series, origin, h, point."""
    return aggregate(base, edge, "point", ("origin", "h"))


def nodes(edge: DataFrame) -> DataFrame:
    """(idx, node, level, n_leaves): bottoms first, then levels in order, each by label; the total is last."""
    order = F.row_number().over(Window.orderBy("level", "node")) - 1
    # one row a node: as many as the hierarchy has
    return edge.groupBy("node", "level").agg(F.count(F.lit(1)).alias("n_leaves")).select(order.alias("idx"), "node", "level", "n_leaves")


def multipliers(under: tuple[np.ndarray, np.ndarray], leaves: np.ndarray, bottoms: int, off: np.ndarray, tolerance: float = 1e-13, most: int = 500) -> np.ndarray:
    """x of (A A' + D) x = off by conjugate gradients; A has a 1 at each (upper, bottom) of under, D is diag(leaves).

    Scaled by D, the nodes of one level add eigenvalues of at most 1 to the identity, so the condition is at most 1 and
    the number of levels, whatever the number of nodes, and some tens of steps do.  No matrix is made.
    """
    upper, bottom = under
    scale = 1 / np.sqrt(leaves)

    def times(v):
        w = v * scale
        down = np.bincount(bottom, w[upper], bottoms)
        return v + scale * np.bincount(upper, down[bottom], len(leaves))

    b = off * scale
    x, r = np.zeros_like(b), b.copy()
    p, old = r.copy(), float(r @ r)
    least = tolerance**2 * max(old, 1e-300)
    for _ in range(most):
        if old <= least:
            break
        q = times(p)
        a = old / float(p @ q)
        x, r = x + a * p, r - a * q
        new = float(r @ r)
        p, old = r + new / old * p, new
    else:
        raise RuntimeError("reconciliation did not converge")
    return x * scale


def wls_struct(base: DataFrame, edge: DataFrame, most_edges: int = 20_000_000) -> DataFrame:
    """Coherent points nearest to the base points of all nodes: least squares with structural weights, the leaf counts.

    The edges above the bottoms, most_edges at most, go to every task as two arrays of numbers.  The points of one
    origin and step meet in one task, which solves for one multiplier a node above the bottoms.  A node without a point
    is an error.
    """
    rows = edge.filter("level > 0").select("node", "series").limit(most_edges + 1).toPandas()
    if len(rows) > most_edges:
        raise ValueError(f"the hierarchy has over {most_edges} edges")
    upper, above = np.unique(rows["node"].to_numpy(str), return_inverse=True)
    series, below = np.unique(rows["series"].to_numpy(str), return_inverse=True)
    leaves = np.bincount(above, minlength=len(upper)).astype(float)
    spark = base.sparkSession
    sent = spark.sparkContext.broadcast((upper, series, above.astype(np.int32), below.astype(np.int32), leaves))

    def solve(pdf):
        upper, series, above, below, leaves = sent.value
        names = pdf["node"].to_numpy(str)
        order = np.argsort(names)
        at = [order[np.minimum(np.searchsorted(names, own, sorter=order), len(names) - 1)] for own in (upper, series)]
        if (names[at[0]] != upper).any() or (names[at[1]] != series).any():
            raise ValueError("every node of the hierarchy needs a base point")
        point = pdf["point"].to_numpy(float).copy()
        off = np.bincount(above, point[at[1]][below], len(upper)) - point[at[0]]
        m = multipliers((above, below), leaves, len(series), off)
        point[at[1]] -= np.bincount(below, m[above], len(series))
        point[at[0]] += leaves * m
        pdf["point"] = point
        return pdf

    if not len(rows):
        return base.select("node", "origin", "h", "point")
    own = base.select("node", F.col("origin").cast("int").alias("origin"), F.col("h").cast("int").alias("h"), F.col("point").cast("double").alias("point"))
    return own.groupBy("origin", "h").applyInPandas(solve, "node string, origin int, h int, point double")
