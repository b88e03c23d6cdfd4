"""Mixing sources to target weights by budget fitting on exact document lengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import cut, numbered


def word_count(text: F.Column) -> F.Column:
    """Number of runs of other than space and the bytes 9 to 13; null: 0."""
    gap = r"[\x20\x09-\x0D]"
    runs = F.size(F.split(text, gap + "+")) - text.rlike("^" + gap).cast("int") - F.substring(text, -1, 1).rlike(gap).cast("int")
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, runs).otherwise(0).cast("long")


def share_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], most: float) -> dict[str | None, float]:
    """Words to take of each source: the total by weight, at most `most` times its size, the excess shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    target: dict[str | None, float] = {}
    left, open_ = float(sum(n for _, n in order)), [s for s, _ in order]
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * each > cap[s]]
        for s in over or open_:
            target[s] = cap[s] if over else weight[s] * each
        if not over:
            break
        left -= sum(cap[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def proportional_part(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take before the exact fit: shares of the budget less twice the longest length.

    Shares are rounded down; where that leaves more than twice the longest length, lengths whose share lost most by
    rounding, longer ones first, give one document more each until it does not.
    """
    room, stock = 2 * int(length.max()), int((length * count).sum())
    shared = max(0, budget - room)
    whole = np.where(length > 0, count, 0).astype(object) * shared
    take, lost = (whole // stock).astype(np.int64), (whole % stock).astype(float)
    rest = budget - int((take * length).sum())
    for k in np.lexsort((-length, -lost)):
        if rest <= room:
            break
        if lost[k] > 0:
            take[k] += 1
            rest -= int(length[k])
    return take


def fit_counts(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many of the documents of each length to take so that their words are the budget, or just under it.

    Every length gives about the same share of its documents, up to some twice the longest length below the budget;
    a bounded knapsack over the documents still in stock then meets the rest exactly where any choice does, and
    else comes as near from below as one can.
    """
    stock = int((length * count).sum())
    if budget <= 0 or not stock:
        return np.zeros(len(length), np.int64)
    if budget >= stock:
        return np.where(length > 0, count, 0).astype(np.int64)
    take = proportional_part(length, count, budget)
    rest = budget - int((take * length).sum())
    # reach: bit w is set if some choice makes w words.  A choice of up to c of a length is c's binary parts.
    reach, steps, full = 1, [], (1 << (rest + 1)) - 1
    for k in np.argsort(-length, kind="stable"):
        spare, unit = int(count[k] - take[k]), int(length[k])
        if unit <= 0 or unit > rest or not spare:
            continue
        spare, part = min(spare, rest // unit), 1
        while spare and not reach >> rest & 1:
            part_now = min(part, spare)
            steps.append((k, part_now, reach))
            reach = (reach | (reach << (part_now * unit))) & full
            spare, part = spare - part_now, part * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for k, part_now, before in reversed(steps):
        if not before >> at & 1:
            take[k] += part_now
            at -= part_now * int(length[k])
    return take


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: float = 3.0,
    seed: int = 42,
    per_bucket: int = 100_000,
    row_col: str | None = None,
    most_sources: int = 100_000,
) -> DataFrame:
    """(id, source, size, source_size, target, times, tie) for every row of docs: how often the mix takes it.

    row_col, a column of docs, comes first where it is given.

    A source's target is met by whole passes over its rows, then by rows chosen for the rest: fit_counts says
    how many of each length, and the rows of a length with the least seeded hash of their id are taken.  Rows of
    one source and length are ranked in buckets of about per_bucket rows, so a large group of copies is not
    ranked in one task.  Rows without words are taken 0 times and a null text has none; a null source is a
    source of its own, the last.  Rows of one id and text rank in any order.  The sources are a mixture's short list and are read to
    the driver, most_sources of them at most; rows are not.
    """
    tie, kept = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), [row_col] if row_col else []
    source = F.col(source_col).cast("string")
    rows = docs.select(*kept, F.col(id_col).alias("id"), F.coalesce(source, F.lit("")).alias("src"), source.isNull().alias("nul"), word_count(F.col(text_col)).alias("size"), tie.alias("tie"))
    rows = cut(rows, "mix-rows")
    stock = cut(rows.groupBy("src", "nul", "size").agg(F.count(F.lit(1)).alias("n")), "mix-stock")
    sums = stock.groupBy("src", "nul").agg(F.sum(F.col("n") * F.col("size")).alias("words")).limit(most_sources + 1).collect()
    if len(sums) > most_sources:
        raise ValueError(f"a mixture has at most {most_sources} sources")
    sizes = {None if r["nul"] else r["src"]: int(r["words"]) for r in sums}
    target = share_targets(list(sizes.items()), weights, most)
    passes = {s: (int(target[s] // n) if n else 0) for s, n in sizes.items()}
    rest = {s: int(round(target[s] - passes[s] * n)) for s, n in sizes.items()}
    spec = docs.sparkSession.createDataFrame(
        [(s or "", s is None, n, float(target[s]), passes[s], rest[s]) for s, n in sizes.items()],
        "src string, nul boolean, source_size long, target double, passes long, rest long",
    )

    def fit(pdf):
        pdf["take"] = fit_counts(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["rest"].iloc[0]))
        pdf["buckets"] = -(-pdf["n"] // per_bucket)
        return pdf[["src", "nul", "size", "source_size", "target", "passes", "take", "buckets"]]

    kinds = "src string, nul boolean, size long, source_size long, target double, passes long, take long, buckets long"
    group = ["src", "nul", "size"]
    # What fit gets of a source is its lengths and how many documents have each, not its documents.
    plan = cut(stock.join(spec, ["src", "nul"]).groupBy("src", "nul").applyInPandas(fit, kinds), "mix-plan")
    # Groups that are ranked in several buckets hold over per_bucket rows each, so they are few beside the rows.
    split = F.broadcast(plan.filter("buckets > 1").select(*group, F.col("buckets").cast("int").alias("b")))
    dealt = rows.join(split, group, "left").select(*kept, "id", *group, "tie", F.when(F.col("b").isNull(), 0).otherwise(F.pmod(F.shiftright("tie", 8), F.col("b")).cast("int")).alias("bucket"))
    fills = dealt.join(split, group, "left_semi").groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = fills.select(*group, "bucket", (F.sum("n").over(Window.partitionBy(*group).orderBy("bucket")) - F.col("n")).alias("before"))
    quota = plan.join(before, group, "left").select(*group, F.coalesce("bucket", F.lit(0)).alias("bucket"), "source_size", "target", "passes", (F.col("take") - F.coalesce("before", F.lit(0))).alias("quota"))
    rank = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy("tie", "id"))
    chosen = dealt.select("*", rank.alias("rank")).join(quota, [*group, "bucket"])
    times = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)).otherwise(0)
    return chosen.select(*kept, "id", F.when(~F.col("nul"), F.col("src")).alias("source"), "size", "source_size", "target", times.cast("long").alias("times"), "tie")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs' rows as often as the mix takes them, with docs' columns; whole rows are shuffled once."""
    # columns go by numbers meanwhile, so none can clash with those added here
    at = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    rows = numbered(docs.toDF(*at.values()), "mix-input")
    plan = mix(rows, at[id_col], at[text_col], at[source_col], row_col="__row", **options)
    times = plan.filter("times > 0").select("__row", F.col("times").cast("int").alias("__times"))
    copies = rows.join(times, "__row").select(*at.values(), F.explode(F.sequence(F.lit(1), "__times")).alias("__copy"))
    return copies.drop("__copy").toDF(*docs.columns)
