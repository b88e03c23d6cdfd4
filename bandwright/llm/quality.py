"""Quality scores by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_values, cut, fold

FEATURES = (
    "bias-free length", "word length", "spread of word lengths", "letters", "beyond ASCII", "digits", "stops", "commas",
    "bars", "braces and marks", "capitals", "line ends", "words that repeat the last", "different words", "commonest word",
    "words that end in a mark", "repeated lines", "long words", "short words",
)
_CLASSES = np.zeros(256, np.int64)
for _c in range(256):
    _CLASSES[_c] = (
        1 if _c >= 128 else 2 if 48 <= _c <= 57 else 3 if _c in b".!?" else 4 if _c in b",;:" else 5 if _c == 124 else 7 if 65 <= _c <= 90
        else 8 if 97 <= _c <= 122 else 9 if _c == 10 else 10 if _c in b" \t\r\x0b\x0c" else 6
    )


def features(text: bytes | None) -> list[float]:
    """Shares that describe the whole text's form; all 0 for a text without words."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    kind = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=11)
    lengths = np.fromiter(map(len, words), np.int64, n)
    count = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    solid = size - kind[9] - kind[10]
    share = [kind[8] + kind[7] + kind[1], kind[1], kind[2], kind[3], kind[4], kind[5], kind[6], kind[7], kind[9]]
    letters, beyond, digits, stops, commas, bars, marks, capitals, ends = (float(x) / max(1, solid) for x in share)
    small = lambda x: math.log1p(100 * x)
    return [
        math.log1p(n), float(lengths.mean()), small(float(lengths.std()) / 100), letters, small(beyond), small(digits), small(stops), small(commas),
        small(bars), small(marks), small(capitals), small(ends), small(sum(map(eq, words, words[1:])) / n), len(count) / n, small(count.most_common(1)[0][1] / n),
        small(sum(w[-1] in b"$#%&*@^~|=<>" for w in words) / n), small(1 - len(set(lines)) / max(1, len(lines))), float((lengths > 12).mean()), float((lengths < 4).mean()),
    ]


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int, ridge: float, seed: int) -> np.ndarray:
    """Weights under which the better row of a pair outscores the other: logistic loss on feature differences."""
    draw = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    weight = np.zeros(x.shape[1])
    if not len(better) or not len(worse):
        return weight
    diff = x[draw.choice(better, pairs)] - x[draw.choice(worse, pairs)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(diff @ weight, -40, 40)))
        gradient = diff.T @ (1 - p) / pairs - ridge * weight
        bend = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(weight))
        step = np.linalg.solve(bend, gradient)
        weight += step
        if np.abs(step).max() < 1e-9:
            break
    return weight


def bradley_terry(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    cut_score: float = 0.7,
    sample: int = 20_000,
    pairs: int = 100_000,
    ridge: float = 1e-3,
    seed: int = 42,
    folds: int = 4,
    held: int = 2,
    slack: float = 0.02,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs.

    Weights come from preference pairs of `sample` labelled rows at most, those outside fold `held` with the
    least seeded hash.  The cut is a quantile of all documents' scores: the level that best parts the labels of
    those rows, moved by up to `slack` to where scores are furthest apart.  A score is the logistic of the distance to the cut, moved so that the cut is at cut_score.
    A null or empty text has the features of no text and a score like any other.  Ids without a label, and labels
    that are null or name no document, teach nothing; with one class only, or no labels, every score is
    cut_score.  Repeated rows are each returned; a null id is fold 0 and is not learnt from.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def describe(batches):
        for batch in batches:
            rows = [features(t) for t in byte_values(batch.column(1))]
            flat = pa.array(np.array(rows, np.float64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows) + 1) * len(FEATURES), len(FEATURES), dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "x"])

    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(describe, f"id {kind}, x array<double>"), "quality-features")
    marked = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y"))
    taught = rows.filter((fold("id", folds) != held) & F.col("id").isNotNull()).join(marked, "id")
    taught = taught.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).toPandas()
    weight, centre, level = np.zeros(len(FEATURES)), np.zeros(len(FEATURES)), 0.0
    good = taught["y"].to_numpy() >= 0.5
    if good.any() and not good.all():
        x = np.array(taught["x"].tolist())
        centre, spread = x.mean(0), x.std(0)
        weight = fit_pairs(np.where(spread > 0, (x - centre) / np.maximum(spread, 1e-12), 0), good, pairs, ridge, seed)
        weight = np.where(spread > 0, weight / np.maximum(spread, 1e-12), 0)
        level = best_level((x - centre) @ weight, good)
    raw = F.lit(float(-centre @ weight))
    for k, w in enumerate(weight):
        raw = raw + F.col("x")[k] * F.lit(float(w))
    scored = cut(rows.select("id", raw.alias("raw")), "quality-raw")
    levels = np.clip(level + np.linspace(-slack, slack, 81), 0, 1).tolist()
    at = widest_gap(scored.agg(F.percentile_approx("raw", levels, 100_000)).first()[0])
    score = 1 / (1 + F.exp(-(F.col("raw") - F.lit(at) + math.log(cut_score / (1 - cut_score)))))
    score = F.lit(cut_score) if not weight.any() else F.when(F.col("raw") >= at, F.greatest(score, F.lit(cut_score))).otherwise(F.least(score, F.lit(float(np.nextafter(cut_score, 0)))))
    out = scored.select(F.col("id").alias(id_col), (fold("id", folds) == held).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut_score).cast("int"))


def best_level(raw: np.ndarray, good: np.ndarray) -> float:
    """Share of rows below the cut that puts the fewest rows on the wrong side."""
    order = np.argsort(raw, kind="stable")
    hit = np.cumsum(~good[order]) - np.cumsum(good[order])
    return float((int(hit.argmax()) + 1) / len(raw))


def widest_gap(quantiles: list[float] | None) -> float:
    """The middle between the two neighbouring quantiles that are furthest apart."""
    if not quantiles:
        return 0.0
    q = np.array(quantiles)
    k = int(np.diff(q).argmax())
    return float((q[k] + q[k + 1]) / 2)
