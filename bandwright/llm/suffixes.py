"""Removal of bytes under long strings that start more than once, by a difference cover of the suffixes.

Suffixes matter only up to `length` bytes, so the sort of a suffix array stops there.  Places whose residue is in a
difference cover are sampled: any two places have a shift, less than the period, that takes both to sampled ones.
Tuples at sampled places are named and sorted; names recur on names, two to a name; names that occur once are
discarded with every suffix that leans on them; the suffixes left are merged by all bytes around their sampled
place, and, where these differ, by their prefixes of `length` bytes: equal neighbours in that order are repeats.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_values, cut, discard, numbered, small_batches, whole_groups

#: Words of names that a task collects before it gives them away, and about how many meet in a task.
CHUNK, MEET = 1 << 19, 3 << 19
ENTRIES, KNOWN, RUNS = 0, 1, 2
_RECORD = "part int, tag int, names binary, rows binary, places binary"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def difference_cover(most: int) -> tuple[int, list[int]]:
    """(period, residues): every number below the period is a difference of two residues, modulo the period.

    The period is q * q + q + 1 for the largest prime q that keeps it within most, and the residues are q + 1: the
    powers of a root of a cubic over q that lie in a plane.
    """
    primes = [q for q in range(2, 1 + int(max(0, most) ** 0.5)) if all(q % p for p in range(2, q)) and q * q + q + 1 <= most]
    if not primes:
        raise ValueError("strings of 20 bytes at least are compared")
    q = primes[-1]
    period = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        power, found = (1, 0, 0), []
        for i in range(period):
            if power[2] == 0:
                found.append(i)
            power = (power[2] * c % q, (power[0] + power[2] * b) % q, (power[1] + power[2] * a) % q)
        if len(found) == q + 1 and len({(i - j) % period for i in found for j in found}) == period:
            return period, found
    raise AssertionError(f"no difference cover of {period}")


def _of_two(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The name of two names one after the other."""
    h = (x ^ (x >> np.uint64(32))) * _M1 + y
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def tuple_names(text: bytes, period: int, residue: int, seed: int = 0) -> np.ndarray:
    """Names of the tuples of `period` bytes at residue, residue + period and so on."""
    name = xxhash.xxh3_64_intdigest
    return np.array([name(text[a : a + period], seed) for a in range(residue, len(text) - period + 1, period)], np.uint64)


def _two_tuples(text: bytes, length: int, period: int, residue: int) -> np.ndarray:
    """Names of two tuples at residue, residue + period and so on, as far as strings lean on the places; nearer the end none does."""
    one = tuple_names(text, period, residue)
    return _of_two(one[:-1], one[1:])[: (len(text) - length - residue + period - 1) // period + 1]


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, by its first bits."""
    return (((key >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int32)


def _of_rows(rows: np.ndarray, parts: int) -> np.ndarray:
    return _part(rows.astype(np.uint64) * _M1, parts)


def _records(names: list[np.ndarray], rows: list[tuple[int, int]], places: list[np.ndarray] | None, parts: int) -> pa.RecordBatch:
    """Names (n, words) of rows (row, how many) for the parts they are sorted in.

    Names that occur twice here are known repeats: their places go on as such, and one of each name to its part, its
    row inverted to say so.  A name stands for its own place where there are no places.
    """
    name = np.concatenate(names)
    row = np.repeat(np.array([r for r, _ in rows], np.int64), [n for _, n in rows])
    place = name[:, 0] if places is None else np.concatenate(places)
    order = np.lexsort(name.T[::-1])
    ranked = name[order]
    same = (ranked[1:] == ranked[:-1]).all(1)
    again, before = np.concatenate([[False], same]), np.concatenate([same, [False]])
    twice = np.empty(len(name), bool)
    twice[order] = again | before
    out: list[tuple] = []
    own = np.flatnonzero(twice)
    if len(own):
        out.append((int(_of_rows(row[own[:1]], parts)[0]), KNOWN, b"", row[own].tobytes(), place[own].tobytes()))
    heads = order[before & ~again]
    kept = np.concatenate([np.flatnonzero(~twice), heads])
    row[heads] = ~row[heads]
    for part, at in _split(_part(name[kept, 0], parts), kept):
        out.append((part, ENTRIES, name[at].tobytes(), row[at].tobytes(), b"" if places is None else place[at].tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [x.split()[0] for x in _RECORD.split(", ")])


def _split(part: np.ndarray, at: np.ndarray):
    """(part, those of at in it), in their order."""
    by = np.argsort(part, kind="stable")
    part, at = part[by], at[by]
    ends = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(ends[:-1], ends[1:]):
        if b > a:
            yield int(part[a]), at[a:b]


class _Sorter:
    """Collects names and gives records of them, CHUNK names at a time."""

    def __init__(self, parts: int, with_places: bool):
        self.parts, self.with_places, self.words = parts, with_places, 1
        self._clear()

    def _clear(self):
        self.names, self.rows, self.places, self.n = [], [], [] if self.with_places else None, 0

    def add(self, row: int, names: np.ndarray, places: np.ndarray | None = None):
        if len(names):
            self.names.append(names)
            self.rows.append((row, len(names)))
            self.n, self.words = self.n + len(names), names.shape[1]
            if self.with_places:
                self.places.append(places.astype(np.uint64))

    def full(self, least: int = CHUNK):
        if self.n * self.words >= max(1, least):
            yield _records(self.names, self.rows, self.places, self.parts)
            self._clear()


def _repeated(records: DataFrame, words: int, parts: int, name: str) -> DataFrame:
    """(row, places, runs), packed: the places, or names, of a row whose name occurs more than once.

    runs: where names that differ begin with the same word, one place of each name.
    """

    def unpacked(table, columns):
        kinds = {"names": np.uint64, "rows": np.int64, "places": np.uint64}
        return [np.frombuffer(b"".join(table.column(c).to_pylist()), kinds[c]) for c in columns]

    def told(tag, rows, places):
        found = list(_split(_of_rows(rows, parts), np.arange(len(rows))))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = zip(*[(part, tag, rows[at].tobytes(), places[at].tobytes()) for part, at in found])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "tag", "rows", "places"])

    def meet(batches):
        for table, at in whole_groups(batches, ["part"]):
            for a, b in zip(at[:-1], at[1:]):
                group = table.slice(a, b - a)
                tags = group.column("tag").to_numpy()
                entries, passed = group.filter(pa.array(tags == ENTRIES)), group.filter(pa.array(tags == KNOWN))
                if len(passed):
                    yield told(KNOWN, *unpacked(passed, ["rows", "places"]))
                if not len(entries):
                    continue
                names, rows, places = unpacked(entries, ["names", "rows", "places"])
                names = names.reshape(-1, words)
                order = np.lexsort(names.T[::-1])
                names, rows, places = names[order], rows[order], (places if len(places) else names[:, 0])[order]
                first = np.concatenate([[True], (names[1:] != names[:-1]).any(1)])
                kind, known = np.cumsum(first) - 1, rows < 0
                count = np.bincount(kind) + np.bincount(kind[known], minlength=kind[-1] + 1)
                fresh = np.flatnonzero((count[kind] > 1) & ~known)
                if len(fresh):
                    yield told(KNOWN, rows[fresh], places[fresh])
                if words > 2:
                    heads = np.flatnonzero(first)
                    core = np.cumsum(np.concatenate([[True], names[heads[1:], 0] != names[heads[:-1], 0]])) - 1
                    heads = heads[np.bincount(core)[core] > 1]
                    if len(heads):
                        yield told(RUNS, np.where(known, ~rows, rows)[heads], places[heads])

    def gather(batches):
        for table, at in whole_groups(batches, ["part"]):
            for a, b in zip(at[:-1], at[1:]):
                group = table.slice(a, b - a)
                tags, own = group.column("tag").to_numpy(), {}
                for tag in (KNOWN, RUNS):
                    rows, places = unpacked(group.filter(pa.array(tags == tag)), ["rows", "places"])
                    by = np.argsort(rows, kind="stable")
                    own[tag] = rows[by], places[by]
                every = np.unique(np.concatenate([rows for rows, _ in own.values()]))
                lists = []
                for rows, places in own.values():
                    ends = np.append(np.searchsorted(rows, every), len(rows)) * 8
                    lists.append(pa.Array.from_buffers(pa.large_binary(), len(every), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(places.tobytes())]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(every), *lists], ["row", "places", "runs"])

    found = records.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "part int, tag int, rows binary, places binary")
    return cut(found.repartition("part").sortWithinPartitions("part").mapInArrow(gather, "row long, places binary, runs binary"), name)


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def _sampled(texts: DataFrame, length: int, period: int, cover: list[int], parts: int) -> DataFrame:
    """Records of the names of two tuples at every sampled place."""

    def name(batches):
        sorter = _Sorter(parts, False)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                for residue in cover:
                    sorter.add(row, _two_tuples(text, length, period, residue)[:, None])
                    yield from sorter.full()
        yield from sorter.full(1)

    return texts.mapInArrow(name, _RECORD)


def _around(met: DataFrame, length: int, period: int, cover: list[int], parts: int) -> DataFrame:
    """Records of the sampled places whose name occurs more than once: that name, and one of all bytes under the strings that lean on it."""

    def name(batches):
        sorter, digest = _Sorter(parts, True), xxhash.xxh3_128_digest
        for batch in batches:
            for row, text, lists in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), batch.column(2).to_pylist()):
                twice = np.unique(_numbers(lists))
                for residue in cover:
                    two = _two_tuples(text, length, period, residue)
                    good = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, two), len(twice) - 1)] == two)
                    place = residue + period * good
                    begin, end = _leaning(place, len(text), length, period)
                    # the place's own offset tells strings cut short by the text's ends from others of the same bytes
                    bytes_of = [digest(text[a : b + length], int(p - a)) for p, a, b in zip(place, begin.tolist(), end.tolist())]
                    around = np.frombuffer(b"".join(bytes_of), np.uint64).reshape(-1, 2)
                    sorter.add(row, np.concatenate([two[good][:, None], around], 1), place)
                    yield from sorter.full()
        yield from sorter.full(1)

    return met.mapInArrow(name, _RECORD)


def _leaning(place: np.ndarray, n: int, length: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, in a text of n bytes, of the strings that lean on a place."""
    return np.maximum(place - period + 1, 0), np.minimum(place, n - length)


def _covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in some range from begin up to, not with, end."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, begin, 1)
    np.add.at(mark, end, -1)
    return np.cumsum(mark[:-1]) > 0


def _prefixes(met: DataFrame, length: int, period: int, parts: int) -> DataFrame:
    """Records of the prefixes of `length` bytes at the starts that lean on the places listed."""

    def name(batches):
        sorter, digest = _Sorter(parts, True), xxhash.xxh3_128_digest
        for batch in batches:
            for row, text, lists in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), batch.column(2).to_pylist()):
                begin, end = _leaning(_numbers(lists).astype(np.int64), len(text), length, period)
                starts = np.flatnonzero(_covered(len(text), begin, end + 1))
                for a in range(0, len(starts), CHUNK // 2):
                    own = starts[a : a + CHUNK // 2]
                    names = b"".join([digest(text[p : p + length]) for p in own.tolist()])
                    sorter.add(row, np.frombuffer(names, np.uint64).reshape(-1, 2), own)
                    yield from sorter.full()
        yield from sorter.full(1)

    return met.mapInArrow(name, _RECORD)


def _with_text(docs: DataFrame, lists: DataFrame, bound: int) -> DataFrame:
    """docs joined to lists by row; docs' other rows are dropped before the shuffle where the rows are few."""
    if lists.count() <= bound:
        docs = docs.join(F.broadcast(lists.select("row")), "row", "left_semi")
    return docs.join(lists, "row")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): row is the id where ids are whole numbers that tell the rows apart, else a number given to each."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    same = not whole or plain.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null or id < 0").limit(1).count()
    return numbered(plain, "suffix-input").withColumnRenamed("__row", "row") if same else plain.select(F.col("id").cast("long").alias("row"), "*")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, bound: int = 4_000_000) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte is removed if a string of `length` bytes over it starts anywhere else in the texts too; strings do not
    cross rows and are judged on the input.  Null text is empty; a text under `length` bytes loses nothing.
    Repeated rows are texts of their own, so each loses what it shares.  Ids may be of any type, null or repeated.

    Equal texts are one text, all of whose bytes go.  Of the others, names at sampled places that occur once are
    discarded.  A place whose name occurs again leads all strings that lean on it: if all bytes under them occur
    again too, every string repeats; of places with one name and other bytes around, one of each kind has its strings
    named one by one.  Names that discard have 64 bits, names that remove 128.  A name that is common in what
    one task reads leaves it once, so that no task gathers a very common string.
    """
    small_batches(docs.sparkSession)
    period, cover = difference_cover((length + 1) // 3)
    plain = _plain(docs, id_col, text_col)
    sizes = plain.select("row", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    sizes = cut(sizes, "suffix-sizes")
    equal = sizes.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = cut(sizes.join(equal.select("sha", "first"), "sha").select("row", "first"), "equal-texts")
    texts, later = plain.select("row", "text").filter(F.octet_length("text") >= length), copies.filter("row <> first").select("row")
    texts = texts.join(F.broadcast(later) if later.count() <= bound else later, "row", "left_anti")
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    # names are dealt by their first bits, so each part gets about as many
    parts = lambda n, words: int(min(1 << 20, max(8, -(-n * words // MEET))))

    halves, several, single = parts(total * len(cover) // period, 1), parts(total * len(cover) // (4 * period), 3), parts(total // 16, 2)
    found = _repeated(_sampled(texts, length, period, cover, halves), 1, halves, "repeated-names").select("row", "places")
    around = _repeated(_around(_with_text(texts, found, bound), length, period, cover, several), 3, several, "repeated-surroundings")
    unlike = around.filter(F.length("runs") > 0).select("row", "runs")
    strings = _repeated(_prefixes(_with_text(texts, unlike, bound), length, period, single), 2, single, "repeated-strings")
    spans = around.select("row", "places", F.lit(False).alias("single")).union(strings.select("row", "places", F.lit(True)))
    spans = spans.filter(F.length("places") > 0).groupBy("row").agg(F.collect_list(F.struct("single", "places")).alias("spans"))
    spans = cut(spans.join(copies.select("row"), "row", "left_anti"), "repeat-spans")

    def strip(batches):
        for batch in batches:
            out = []
            for text, found in zip(byte_values(batch.column(1)), batch.column(2).to_pylist()):
                gone = np.zeros(len(text), bool)
                for part in found:
                    place = _numbers(part["places"]).astype(np.int64)
                    begin, end = (place, place) if part["single"] else _leaning(place, len(text), length, period)
                    gone |= _covered(len(text), begin, end + length)
                data = np.frombuffer(text, np.uint8)
                out.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            removed, n, sha = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["row", "n_removed", "n_spans", "kept_sha256"])

    stripped = cut(_with_text(texts, spans, bound).select("row", "text", "spans").mapInArrow(strip, "row long, n_removed long, n_spans long, kept_sha256 string"), "stripped-texts")
    wholly = copies.select("row", F.lit(True).alias("whole"))
    out = sizes.join(wholly, "row", "left").join(stripped, "row", "left")
    either = lambda whole, c: F.when(F.col("whole"), whole).otherwise(F.coalesce(c, F.lit(0).cast("long")))
    return out.select(
        F.col("id").alias(id_col), "n_bytes", either(F.col("n_bytes"), "n_removed").alias("n_removed"), either(F.lit(1).cast("long"), "n_spans").alias("n_spans"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
