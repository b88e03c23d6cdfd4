"""Language identification by prediction by partial matching over frozen byte statistics."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import byte_chunks, byte_values, cut, fold, small_batches

ORDER = 3
PAD = b"\n" * ORDER
CHUNK = 1 << 19
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_MODELS: dict[str, list[Model]] = {}


def _grams(buffer: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one number; the first ORDER bytes are context only."""
    code = buffer[:-ORDER].astype(np.uint32)
    for k in range(1, ORDER + 1):
        code = (code << np.uint32(8)) | buffer[k : len(buffer) - ORDER + k]
    return code


def text_grams(texts: list[bytes]) -> np.ndarray:
    """Each byte of the texts with the ORDER bytes before it; a text starts in the context of the pad, which itself counts nowhere."""
    sizes = np.array([len(t) for t in texts], np.int64)
    own = np.repeat(np.tile([True, False], len(texts)), np.stack([sizes, np.full(len(texts), ORDER)], 1).reshape(-1))
    return _grams(np.frombuffer(PAD + PAD.join(texts), np.uint8))[own[:-ORDER]]


def _tally(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(codes))) if weights is None else np.add.reduceat(weights, first) if len(codes) else np.zeros(0, np.int64)
    return codes[first], counts.astype(np.int64)


def gather_counts(docs: DataFrame, text_col: str, lang_col: str, hold: int = 1 << 20) -> DataFrame:
    """(lang, code, n): how often each byte follows each context of ORDER bytes, over all texts of a language.

    A task sums what it has read before it gives rows away, at most hold distinct codes a language at a time.
    """

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang):
            parts = held[lang]
            held[lang] = [_tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
            return held[lang][0]

        def rows(lang):
            codes, counts = merged(lang)
            held[lang] = []
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], ["lang", "code", "n"])

        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), byte_values(batch.column(0))
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs) if x == lang and t]
                for a, b in byte_chunks(own, 2 * CHUNK):
                    held.setdefault(lang, []).append(_tally(text_grams(own[a:b])))
                if lang in held and len(held[lang]) > 4 and len(merged(lang)[0]) > hold:
                    yield rows(lang)
        for lang in held:
            if held[lang]:
                yield rows(lang)

    texts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    counted = texts.mapInArrow(count, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def kept_counts(counts: DataFrame, contexts: int) -> DataFrame:
    """(lang, order, code, n): counts after contexts of 1 to ORDER bytes, those of over one byte the `contexts` commonest of each language."""
    counts = cut(counts, "byte-counts")
    out = None
    for k in range(1, ORDER + 1):
        code = F.col("code").bitwiseAND(F.lit((1 << (8 * k + 8)) - 1))
        own = counts.groupBy("lang", code.alias("code")).agg(F.sum("n").alias("n")).withColumn("context", F.shiftright("code", 8))
        if k > 1:
            most = Window.partitionBy("lang").orderBy(F.desc("weight"), "context")
            weights = own.groupBy("lang", "context").agg(F.sum("n").alias("weight"))
            best = weights.withColumn("place", F.row_number().over(most)).filter(F.col("place") <= contexts)
            own = own.join(best.select("lang", "context"), ["lang", "context"], "left_semi")
        own = own.select("lang", F.lit(k).alias("order"), "code", "n")
        out = own if out is None else out.union(own)
    return out


class Model:
    """Context trees of every language as tables: node of each context, and bits for each byte after it.

    A node of the longest context that was kept; a context that was not kept leads to its longest kept suffix.
    Probabilities follow escape method C with exclusion: seen bytes share n / (n + q) by count, and q / (n + q),
    q the number of different bytes seen, goes to the others in the shorter context's proportions.  Below order
    0 all 256 bytes are alike.  orders: the order that each row counts for, rows of order 1 for order 0 too; None:
    every row counts for all.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray, contexts: int, orders: np.ndarray | None = None):
        self.langs = langs
        counts_for = [np.ones(len(code), bool) if orders is None else orders == max(1, k) for k in range(ORDER + 1)]
        code = code.astype(np.int64)
        context = {k: (code >> 8) & ((1 << (8 * k)) - 1) for k in range(ORDER + 1)}
        keep: dict[int, np.ndarray] = {}
        for k in range(2, ORDER + 1):
            ids, inverse = np.unique(context[k][counts_for[k]], return_inverse=True)
            weight = np.bincount(inverse, n[counts_for[k]], len(ids))
            keep[k] = np.sort(ids[np.lexsort((ids, -weight))[:contexts]])
        first = {0: 0, 1: 1, 2: 257, 3: 257 + len(keep[2])}
        total = first[3] + len(keep[3])
        self.two = (1 + (np.arange(1 << 16) & 255)).astype(np.int32)
        self.two[keep[2]] = first[2] + np.arange(len(keep[2]))
        # the third byte back leads on from a kept context of two bytes, by that context's place
        self.place = np.full(1 << 16, -1, np.int64)
        self.place[keep[2]] = np.arange(len(keep[2]))
        self.three = np.repeat(self.two[keep[2]][:, None], 256, 1)
        inside = self.place[keep[3] & 0xFFFF]
        kept = inside >= 0
        self.three[inside[kept], keep[3][kept] >> 16] = first[3] + np.flatnonzero(kept)
        parent = np.zeros(total, np.int64)
        parent[first[2] : first[3]] = 1 + (keep[2] & 255)
        parent[first[3] :] = self.two[keep[3] & 0xFFFF]
        bits = np.empty((total * 256, len(langs)), np.float32)
        symbol = code & 255
        for which in range(len(langs)):
            p = np.empty((total, 256))
            for k in range(ORDER + 1):
                own = (lang == which) & counts_for[k]
                if k < 2:
                    node, ok = first[k] + context[k][own], np.ones(own.sum(), bool)
                    size = 1 if k == 0 else 256
                else:
                    at = np.searchsorted(keep[k], context[k][own])
                    at = np.minimum(at, max(0, len(keep[k]) - 1))
                    ok = keep[k][at] == context[k][own] if len(keep[k]) else np.zeros(own.sum(), bool)
                    node, size = first[k] + at, len(keep[k])
                if not size:
                    continue
                count = np.bincount(((node - first[k]) * 256 + symbol[own])[ok], n[own][ok], size * 256).reshape(size, 256)
                seen = count > 0
                q, all_of = seen.sum(1, keepdims=True), count.sum(1, keepdims=True)
                shorter = np.full((size, 256), 1 / 256) if k == 0 else p[parent[first[k] : first[k] + size]]
                unseen = np.where(seen, 0, shorter)
                rest = unseen.sum(1, keepdims=True)
                escape = np.where(rest > 0, q / np.maximum(1, all_of + q), 0)
                known = np.where(rest > 0, count / np.maximum(1, all_of + q), count / np.maximum(1, all_of))
                p[first[k] : first[k] + size] = np.where(all_of > 0, known + escape * unseen / np.maximum(rest, 1e-300), shorter)
            bits[:, which] = -np.log2(np.maximum(p, 1e-30)).reshape(-1)
        self.bits = bits

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for a, b in byte_chunks(texts, CHUNK):
            sizes = np.array([len(t) for t in texts[a:b]], np.int64)
            buffer = np.frombuffer(PAD + PAD.join(texts[a:b]), np.uint8)
            starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
            for lo in range(0, len(buffer) - ORDER, 4 * CHUNK):
                hi = min(lo + 4 * CHUNK, len(buffer) - ORDER)
                part = buffer[lo : hi + ORDER].astype(np.int64)
                two = (part[1:-2] << 8) | part[2:-1]
                place = self.place[two]
                node = np.where(place >= 0, self.three[np.maximum(place, 0), part[:-3]] if len(self.three) else 0, self.two[two])
                sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.bits[node.astype(np.int64) * 256 + part[3:]], 0, dtype=np.float64)])
                begin, end = np.clip(starts - lo, 0, hi - lo), np.clip(starts + sizes - lo, 0, hi - lo)
                out[a:b] += sums[end] - sums[begin]
        return out


def has_letter(text: bytes | None) -> bool:
    """Whether a character is of one of Unicode's letter categories; numerals such as a half are not."""
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(
    docs: DataFrame,
    train: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    contexts: int = 8192,
    carry: list[str] | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """(id_col, carry..., lang_pred, score) for every row of docs; languages are learned from train alone.

    Counts come from every text of train.  Each language has a tree of its own, of its `contexts` most frequent contexts
    of two and of three bytes and all shorter ones, with all their counts: no language takes another's room.
    lang_pred is the language whose tree codes the whole text in the fewest bits (ties: the first by name),
    score its posterior under equal priors.  Null text, text without a letter, or nothing to learn from: `und`
    with score 0.  carry: columns of docs passed through untouched; keep_text: the text too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = kept_counts(gather_counts(train, text_col, lang_col), contexts).toArrow().combine_chunks()
    name, code, orders, n = (table.column(c).to_numpy() for c in ("lang", "code", "order", "n"))
    langs = sorted(set(name))
    sent = spark.sparkContext.broadcast([(x, code[name == x].astype(np.uint32), n[name == x], orders[name == x]) for x in langs])
    key, carry, kept_from = uuid.uuid4().hex, carry or [], 0 if keep_text else 1
    named = text_col if keep_text else "__text"

    def predict(batches):
        for batch in batches:
            texts = byte_values(batch.column(0))
            good = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if good:
                if key not in _MODELS:
                    _MODELS.clear()
                    _MODELS[key] = [Model([x], np.zeros(len(c), np.int8), c, n, contexts, k) for x, c, n, k in sent.value]
                bits = np.concatenate([m.lengths([texts[i] for i in good]) for m in _MODELS[key]], 1)
                best = bits.argmin(1)
                share = 1 / np.exp2(np.minimum(0, bits[np.arange(len(good)), best][:, None] - bits)).sum(1)
                for i, which, s in zip(good, best, share):
                    pred[i], score[i] = langs[which], s
            yield pa.RecordBatch.from_arrays([*batch.columns[kept_from:], pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names[kept_from:], "lang_pred", "score"])

    kept = docs.select(F.col(text_col).alias(named), F.col(id_col), *[F.col(c) for c in carry])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[kept_from:])
    return kept.mapInArrow(predict, f"{kinds}, lang_pred string, score double")


def learn_rows(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """The rows a model may learn from: those outside fold 0 that name a language."""
    return docs.filter((fold(id_col, folds) != 0) & F.col(lang_col).isNotNull())
