"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
import uuid
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import byte_values, small_batches

#: Fixed masks: 1 is a token that is hashed, 0 one that is ignored.  Any WINDOW tokens with up to two
#: substitutions have a place where one of them meets none (a test tries every such pair).
MASKS = ("11111", "111101", "1101011")
WINDOW = 13
SHARE = 0.8
SHORTEST = 5

#: Marks and spaces beyond ASCII, which part tokens like those of ASCII.
_MARKS = re.compile("[\u00a0\u00a1\u00ab\u00b7\u00bb\u00bf\u2000-\u206f\u3000-\u3004\u3008-\u303f\uff00-\uff0f\uff1a-\uff20]")
#: Scripts written without spaces (Thai, Lao, Myanmar, Khmer, Kana, Han): each character is a token.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INDEX: dict[str, Index] = {}


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of what is beyond ASCII, without its marks.

    In scripts written without spaces each character is a token.
    """
    if not text:
        return []
    if not text.isascii():
        text = _SPACELESS.sub(r" \g<0> ", _MARKS.sub(" ", text.decode("utf-8", "replace").lower())).encode("utf-8")
    return text.lower().translate(_WORD_BYTES).split()


def sure_substitutions(n: int) -> int:
    """Most substitutions in n tokens that leave SHARE of them equal and, wherever they are, a place for a mask."""
    for k in range(int(n * (1 - SHARE) + 1e-9), 0, -1):
        places = [{p + at for at, bit in enumerate(m) if bit == "1"} for m in MASKS for p in range(n - len(m) + 1)]
        if all(any(not place & set(bad) for place in places) for bad in combinations(range(n), k)):
            return k
    return 0


_MAY_DIFFER = [sure_substitutions(n) for n in range(WINDOW + 1)]


def mask_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the unmasked tokens at each place where the mask fits."""
    n = len(ids) - len(mask) + 1
    out = np.full(max(0, n), len(mask), np.uint64)
    if n > 0:
        for k, bit in enumerate(mask):
            if bit == "1":
                out = (out ^ ids[k : k + n]) * _MULT
                out ^= out >> np.uint64(29)
    return out


class Index:
    """The test items' token numbers and, for each mask, their hashes with the place each stands for."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.vocab: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.items = []
        for _, text in items:
            words = tokens(text)
            self.items.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint64))
        self.tables = []
        for mask in MASKS:
            hashes = [mask_hashes(x, mask) if len(x) >= SHORTEST else np.zeros(0, np.uint64) for x in self.items]
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
            at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
            order = np.argsort(flat, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(flat >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((mask, flat[order], item[order], at[order], seen))

    def overlap(self, doc: np.ndarray, item: np.ndarray, shift: int) -> int:
        """Most equal tokens in a window along one alignment, if they are all but the sure substitutions; else 0."""
        width = min(WINDOW, len(item))
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        if b - a < width:
            return 0
        same = np.concatenate([[0], np.cumsum(doc[a + shift : b + shift] == item[a:b])])
        most = int((same[width:] - same[:-width]).max())
        return most if most >= width - _MAY_DIFFER[width] else 0

    def hits(self, texts: list[bytes | None], step: int = 1 << 19) -> list[tuple[int, int, int]]:
        """(row, item, equal tokens) of every row and item that overlap."""
        found: list[tuple[int, int, int]] = []
        start = 0
        while start < len(texts):
            end, held = start, 0
            parts, firsts = [], []
            while end < len(texts) and (end == start or held < step):
                words = tokens(texts[end])
                part = np.zeros(len(words) + 1, np.uint64)  # a number that no item has parts the rows
                part[: len(words)] = np.fromiter(map(self.vocab.get, words, repeat(0)), np.uint64, len(words))
                parts.append(part)
                firsts.append(held)
                held += len(part)
                end += 1
            ids, firsts_of = np.concatenate(parts), np.array(firsts)
            best: dict[tuple[int, int], int] = {}
            for mask, flat, item, at, seen in self.tables:
                if not len(flat):
                    continue
                h = mask_hashes(ids, mask)
                maybe = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
                lo, hi = np.searchsorted(flat, h[maybe], "left"), np.searchsorted(flat, h[maybe], "right")
                hit = hi > lo
                maybe, lo, span = maybe[hit], lo[hit], (hi - lo)[hit]
                ends = np.cumsum(span)
                for a in range(0, int(ends[-1]) if len(ends) else 0, step):  # a very common seed stands for many places
                    flat_at = np.arange(a, min(a + step, int(ends[-1])))
                    which = np.searchsorted(ends, flat_at, "right")
                    where, entry = maybe[which], lo[which] + flat_at - (ends[which] - span[which])
                    row = np.searchsorted(firsts_of, where, "right") - 1
                    lines = np.unique(np.stack([row, item[entry], where - firsts_of[row] - at[entry]]), axis=1)
                    for r, i, shift in lines.T.tolist():
                        if best.get((r, i), 0) < min(WINDOW, len(self.items[i])):
                            equal = self.overlap(parts[r][:-1], self.items[i], shift)
                            if equal:
                                best[r, i] = max(equal, best.get((r, i), 0))
            found += [(start + row, item, equal) for (row, item), equal in sorted(best.items())]
            start = end
        return found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Broadcast indexes of the test items, each of about block_bytes of text at most."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    spark = benchmark.sparkSession
    small_batches(spark)
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        rows = sorted(((r["item"], r["text"].encode("utf-8")) for r in own.collect()), key=lambda r: (r[0] is None, *([] if r[0] is None else [r[0]]), r[1]))
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(rows)


def _index(key: str, sent) -> Index:
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Index(sent.value)
    return _INDEX[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """(id_col, item_id, equal_tokens): each row of docs and test item that share a passage.

    A passage is WINDOW tokens in a row with at least SHARE of them equal, place by place, so substituted words
    are allowed; an item under WINDOW tokens must be met whole, with as many substitutions as sure_substitutions
    gives for its length, and one under SHORTEST, shorter than any mask, is not looked for.  The test
    items are few beside the documents: they go to every task in blocks of bounded size, and rows are not
    shuffled.  Null or empty texts share nothing; repeated rows are each returned; a null id stays null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType
    item_arrow = to_arrow_type(item_kind)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for key, sent in _blocks(benchmark, item_col, item_text_col, block_bytes):

        def search(batches, key=key, sent=sent):
            for batch in batches:
                index = _index(key, sent)
                found = index.hits(byte_values(batch.column(1)))
                if found:
                    ids = batch.column(0).take(pa.array([r for r, _, _ in found]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[i] for _, i, _ in found], item_arrow), pa.array([n for _, _, n in found], pa.int32())], [id_col, "item_id", "equal_tokens"])

        part = rows.mapInArrow(search, f"`{id_col}` {kind}, item_id {item_kind.simpleString()}, equal_tokens int")
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """docs without the rows that share a passage with a test item, in docs' columns; no shuffle."""
    at = docs.columns.index(text_col)
    for key, sent in _blocks(benchmark, item_col, item_text_col, block_bytes):

        def clean(batches, key=key, sent=sent):
            for batch in batches:
                bad = {r for r, _, _ in _index(key, sent).hits(byte_values(batch.column(at)))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
