"""URL filter: host and path rules, and a character language-model ratio for the URLs that no rule fits.

Everything here is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

ORDER = 3
SYMBOLS = 32
CELLS = SYMBOLS ** (ORDER + 1)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty where it is null or has no `://`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), upper, lower), part(2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits a host, or one it is a subdomain of, and the path's start."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, allow = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.allow)).otherwise(allow)
    return name, allow


def symbols(text: Column) -> Column:
    """The characters as numbers under SYMBOLS: letters, all digits alike, and a few groups of marks."""

    def one(c: Column) -> Column:
        a = F.ascii(c)
        return (
            F.when(a.between(97, 122), a - 97)
            .when(a.between(48, 57), 26)
            .when(a == 47, 27)
            .when(a == 46, 28)
            .when(a.isin(45, 95), 29)
            .when(a.isin(35, 37, 38, 43, 58, 61, 63), 30)
            .otherwise(31)
        )

    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), one)).otherwise(F.array().cast("array<int>"))


def grams(codes: Column) -> Column:
    """Each symbol with the ORDER before it as one number; before the text stands symbol 31."""
    back = lambda i, k: F.coalesce(F.get(codes, i - k), F.lit(31))
    return F.transform(codes, lambda c, i: ((back(i, 3) * SYMBOLS + back(i, 2)) * SYMBOLS + back(i, 1)) * SYMBOLS + c)


def ratio_model(taught: DataFrame) -> DataFrame:
    """One row: array `model` of the log2 ratio of accepted to rejected probability of each gram.

    taught has `codes` and boolean `allow`.  Each class has a variable-order model: a context's count n and
    number q of different next symbols give n / (n + q) by count and q / (n + q) to the shorter context, down to
    even chances.  A context that was not met leaves all to the shorter one.  The table has CELLS entries,
    whatever the input.
    """
    counted = cut(
        taught.select("allow", F.explode(grams(F.col("codes"))).alias("g"))
        .groupBy("g")
        .agg(F.sum(F.col("allow").cast("long")).alias("n1"), F.sum((~F.col("allow")).cast("long")).alias("n0")),
        "url-grams",
    )
    shorter = None
    for order in range(ORDER + 1):
        size = SYMBOLS ** (order + 1)
        own = counted.groupBy((F.col("g") % size).alias("g")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        totals = own.groupBy(F.shiftright("g", 5).alias("h")).agg(
            *[F.sum(f"n{c}").alias(f"t{c}") for c in (1, 0)], *[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"q{c}") for c in (1, 0)]
        )
        cells = taught.sparkSession.range(size).select(F.col("id").alias("g"), F.shiftright("id", 5).alias("h"), (F.col("id") % (size // SYMBOLS)).alias("s"))
        joined = cells.join(own, "g", "left").join(totals, "h", "left")
        if shorter is None:
            joined = joined.select("*", F.lit(1.0 / SYMBOLS).alias("p1"), F.lit(1.0 / SYMBOLS).alias("p0"))
        else:
            joined = joined.join(shorter.withColumnRenamed("g", "s"), "s", "left")
        mixed = lambda c: F.when(F.col(f"t{c}") > 0, (F.coalesce(f"n{c}", F.lit(0)) + F.col(f"q{c}") * F.col(f"p{c}")) / (F.col(f"t{c}") + F.col(f"q{c}"))).otherwise(F.col(f"p{c}"))
        shorter = joined.select("g", mixed(1).alias("p1"), mixed(0).alias("p0"))
    pair = F.struct("g", F.log2(F.col("p1") / F.col("p0")).cast("float").alias("r"))
    return shorter.agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["r"]).alias("model"))


def scores(rows: DataFrame, model: DataFrame, codes: str = "codes") -> DataFrame:
    """rows with `score`: the mean log2 ratio of its symbols; null for no symbols."""
    step = lambda acc, c: F.struct(
        ((acc["g"] * SYMBOLS + c) % CELLS).alias("g"),
        (acc["s"] + F.element_at("__model", ((acc["g"] * SYMBOLS + c) % CELLS + 1).cast("int"))).alias("s"),
    )
    start = F.struct(F.lit(CELLS - 1).cast("long").alias("g"), F.lit(0.0).alias("s"))
    total = F.aggregate(F.col(codes), start, step, lambda acc: acc["s"])
    return rows.select("*", model.scalar().alias("__model")).select(*rows.columns, F.when(F.size(codes) > 0, total / F.size(codes)).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The cut on `score` that best parts allowed from blocked URLs, in steps of a thousandth; 0 for one class only."""
    bins = scored.filter("score is not null").groupBy(F.round(F.col("score") * 1000).cast("long").alias("b")).agg(F.sum(F.col("allow").cast("long")).alias("n1"), F.sum((~F.col("allow")).cast("long")).alias("n0"))
    below, whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    share = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0)) / F.sum(c).over(whole)
    best = bins.select("b", (share("n0") - share("n1")).alias("j"), F.sum("n1").over(whole).alias("t1"), F.sum("n0").over(whole).alias("t0")).filter("t1 > 0 and t0 > 0")
    top = best.orderBy(F.desc("j"), F.abs("b"), "b").first()
    return (top["b"] - 0.5) / 1000 if top else 0.0


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", folds: int = 4) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of pages.

    A URL that a rule fits has the rule's verdict.  The URLs that rules fit teach the two models, all but a fold
    of them (crc32 of the URL), on which the cut is set.  Other URLs are allowed if their score reaches the cut.
    A null or empty URL has no rule and no score and is allowed, as is every URL where rules fit only allowed or
    only blocked ones.  Repeated rows are each returned.  Models are tables of fixed size.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("__url"), host.alias("host"), path.alias("path"))
    name, allow = rule_of(F.col("host"), F.col("path"), rules)
    bare = F.regexp_replace(F.translate(F.coalesce("__url", F.lit("")), upper, lower), "^[a-z]*://", "")
    rows = rows.select("*", name.alias("rule"), allow.alias("allow"), symbols(bare).alias("codes"), (F.crc32(F.coalesce("__url", F.lit("")).cast("binary")) % folds).alias("fold"))
    ruled = cut(rows.filter("allow is not null").select("allow", "codes", "fold"), "ruled-urls")
    sides = {r[0]: r[1] for r in ruled.groupBy("allow").count().collect()}
    if len(sides) < 2:
        out = rows.select("*", F.lit(None).cast("double").alias("score"))
        limit = 0.0
    else:
        model = cut(ratio_model(ruled.filter("fold <> 0")), "url-model")
        limit = calibrate(scores(ruled.filter("fold = 0"), model))
        out = scores(rows, model)
    verdict = F.when(F.coalesce("allow", F.coalesce(F.col("score") >= limit, F.lit(True))), "allow").otherwise("block")
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
