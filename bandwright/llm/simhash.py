"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of their binary trie."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_values, connected_components, cut, numbered, small_batches, whole_groups

BITS = 64
#: Words of a wide fingerprint.
WIDE = 4
#: Ranges of hashes in a sketch: the values of a hash's first byte.
BINS = 256
#: Nodes of at most so many fingerprints are compared at once.
LEAF = 48


def shingle_hashes(text: bytes | None, words_each: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, a block of them at a time; nothing for no words.

    A-Z are lower-cased; fewer words than words_each make one shingle of all of them.
    """
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if 0 < len(words) < words_each:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
    for at in range(0, len(words) - words_each + 1, 1 << 16):
        part = words[at : at + (1 << 16) + words_each - 1]
        yield np.array([digest(b" ".join(x), seed) for x in zip(*(part[k:] for k in range(words_each)))], np.uint64)


def _bits_set(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes | None, words_each: int, seed: int = 42) -> int:
    """Bit i is set if more than half of the shingles' hashes have it; no words: 0."""
    set_in, total = np.zeros(BITS, np.int64), 0
    for values in shingle_hashes(text, words_each, seed):
        set_in += _bits_set(values)
        total += len(values)
    return int(np.packbits(2 * set_in > total, bitorder="little").view(np.uint64)[0]) if total else 0


def wide_fingerprint(text: bytes | None, words_each: int, bands: int, rows: int, seed: int = 42) -> tuple[bytes, list[int]]:
    """A fingerprint of WIDE words of 64 bits, followed by a sketch, and `bands` keys.

    All of them are of the set of the shingles: a repeated one counts once.  The sketch has 16 bits of the least hash in each of BINS ranges of the hashes, 0 for none.  A key stands for the
    least of `rows` hashes of the shingles: texts of Jaccard similarity s share it with chance s ** rows.
    """
    sketch = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    set_in, total = np.zeros((WIDE, BITS), np.int64), 0
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    blocks = list(shingle_hashes(text, words_each, seed))
    distinct = np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)
    del blocks
    for at in range(0, len(distinct), 1 << 16):
        values = distinct[at : at + (1 << 16)]
        for k in range(WIDE):
            mixed = (values ^ (values >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
            set_in[k] += _bits_set(mixed ^ (mixed >> np.uint64(29)))
        for k in range(len(least)):
            mixed = (values ^ (values >> np.uint64(33))) * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) & (2**64 - 1))
            least[k] = min(least[k], (mixed ^ (mixed >> np.uint64(32))).min())
        mixed = np.sort((values ^ (values >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F))
        bins = (mixed >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        sketch[bins[first]] = np.minimum(sketch[bins[first]], mixed[first])
        total += len(values)
    low = np.where(sketch == np.iinfo(np.uint64).max, 0, (sketch & np.uint64(0xFFFF)) | np.uint64(1)).astype("<u2").tobytes()
    keys = [xxhash.xxh64_intdigest(least[k * rows : (k + 1) * rows].tobytes(), k) - (1 << 63) for k in range(bands)]
    return (np.packbits(2 * set_in > total, axis=1, bitorder="little").tobytes() if total else bytes(WIDE * 8)) + low, keys


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words_each: int, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def of(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, words_each, seed) for x in byte_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(of, f"id {kind}, fp long")


def trie_pairs(x: np.ndarray, y: np.ndarray | None, skip: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted arrays (n, words of 64 bits) that differ in at most budget bits below the first skip bits.

    The sorted array is the trie: a node is a range of it.  Pairs of nodes are taken down together, one bit
    a level, with the bits in which they differ so far; a pair over the budget is dropped.  y None: x with
    itself, each pair once.
    """
    own = y is None
    y = x if own else y
    words = x.shape[1]
    pairs = np.array([[0, len(x), 0, len(y), 0]], np.int64)
    found = []
    for depth in range(skip, BITS * words):
        if not len(pairs):
            break
        shift, at = np.uint64(BITS - 1 - depth % BITS), depth // BITS
        ones_x = np.concatenate([[0], np.cumsum((x[:, at] >> shift) & np.uint64(1)).astype(np.int64)])
        ones_y = ones_x if own else np.concatenate([[0], np.cumsum((y[:, at] >> shift) & np.uint64(1)).astype(np.int64)])
        xl, xh, yl, yh, err = pairs.T
        xm, ym = xh - (ones_x[xh] - ones_x[xl]), yh - (ones_y[yh] - ones_y[yl])
        same = (xl == yl) & (xh == yh) if own else np.zeros(len(pairs), bool)
        kids = np.concatenate(
            [
                np.stack([xl, xm, yl, ym, err], 1),
                np.stack([xm, xh, ym, yh, err], 1),
                np.stack([xl, xm, ym, yh, err + 1], 1),
                np.stack([xm, xh, yl, ym, err + 1], 1)[~same],
            ]
        )
        kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= budget)]
        nx, ny = kids[:, 1] - kids[:, 0], kids[:, 3] - kids[:, 2]
        leaf = (nx == 1) & (ny == 1)
        i, j = kids[leaf, 0], kids[leaf, 2]
        if own:
            i, j = i[i != j], j[i != j]
        low = x[i] ^ y[j]
        low[:, 0] &= np.uint64((1 << (BITS - skip)) - 1)
        close = np.bitwise_count(low).sum(1) <= budget
        found.append((i[close], j[close]))
        pairs = kids[~leaf]
    # Distinct inputs leave no range of several values at the last level.
    return tuple(np.concatenate(z) if found else np.zeros(0, np.int64) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the edges (i, j)."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def fingerprint_links(fps: DataFrame, budget: int, per_bucket: int = 2048, levels: int = 8) -> DataFrame:
    """Edges (u, v) between the ids of distinct fingerprints (fp, id) that differ in at most budget bits.

    The top levels of the trie are taken down as a key: a fingerprint goes to each pair of subtrees it can
    have links in, those whose prefixes differ in at most budget bits.  A pair of subtrees that holds much more than
    per_bucket fingerprints is taken down `levels` more, as often as need be, so fingerprints that share a long prefix
    do not meet in one task.  Below, a task walks its pair of subtrees and returns a spanning forest of what it linked,
    not every pair of a dense group; a fingerprint has at most 64 + 64 * 63 / 2 others within two bits.
    """
    n = fps.count()
    depth = min(16, max(0, math.ceil(math.log2(max(1, n / per_bucket)))))
    low = lambda k: F.lit((1 << k) - 1).cast("long")
    flips = lambda k, most: F.array(*[F.struct(F.lit(sum(1 << b for b in c)).cast("long").alias("m"), F.lit(len(c)).alias("e")) for e in range(most + 1) for c in combinations(range(k), e)])
    prefix = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    routed = fps.select("fp", "id", prefix.alias("p"), F.explode(flips(depth, budget)).alias("x"))
    other = F.col("p").bitwiseXOR(F.col("x.m"))
    routed = routed.select("fp", "id", F.lit(depth).alias("depth"), F.least("p", other).alias("a"), F.greatest("p", other).alias("b"), F.col("x.e").alias("err"))
    group, done = ["depth", "a", "b", "err"], None
    while depth + levels < BITS:
        mine = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
        routed = routed.withColumn("left", mine == F.col("a"))
        heavy = routed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if("left").alias("lefts")).filter(F.col("n") > 4 * per_bucket)
        heavy = cut(heavy.select(*group, ((F.col("a") == F.col("b")) | F.col("lefts").between(1, F.col("n") - 1)).alias("both")), "full-subtrees")
        light = routed.join(heavy, group, "left_anti").drop("left")
        done = light if done is None else done.unionByName(light)
        if not heavy.filter("both").limit(1).count():  # a pair with one side empty has no links
            routed = None
            break
        deeper = routed.join(heavy.filter("both"), group, "left_semi")
        own = F.shiftrightunsigned("fp", BITS - depth - levels).bitwiseAND(low(levels))
        deeper = deeper.select("*", own.alias("q"), F.explode(flips(levels, budget)).alias("x")).filter(F.col("err") + F.col("x.e") <= budget)
        down = lambda side, bits: F.shiftleft(side, levels).bitwiseOR(bits)
        turned = F.col("q").bitwiseXOR(F.col("x.m"))
        a, b = down("a", F.when(F.col("left"), F.col("q")).otherwise(turned)), down("b", F.when(F.col("left"), turned).otherwise(F.col("q")))
        depth += levels
        routed = cut(deeper.select("fp", "id", F.lit(depth).alias("depth"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col("err") + F.col("x.e")).alias("err")), "deeper-subtrees")
    routed = done if routed is None else routed if done is None else done.unionByName(routed)

    def walk(key, table):
        depth, a, b, err = (k.as_py() for k in key)
        value = table.column("fp").to_numpy().view(np.uint64)
        ids = table.column("id").to_numpy()
        order = np.argsort(value)
        value, ids = value[order], ids[order]
        if a == b:
            i, j = trie_pairs(value[:, None], None, depth, budget - err)
        else:
            at = np.searchsorted(value, np.uint64(b << (BITS - depth)))
            i, j = trie_pairs(value[:at, None], value[at:, None], depth, budget - err)
            j = j + at
        rank = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[rank] = np.arange(len(ids))
        label = least_labels(len(ids), place[i], place[j]) if len(i) else np.arange(len(ids))
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": pa.array(ids[rank][moved]), "v": pa.array(ids[rank][label[moved]])})

    return routed.groupBy(*group).applyInArrow(walk, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    component_id is the smallest id that a row reaches over links of at most budget differing bits.
    Rows of one fingerprint are one node of the join.  Null text is a text without words: fingerprint 0.
    Rows whose id is null keep their row; they take the component of their fingerprint and never name one,
    unless no row of the fingerprint has an id: then component_id is null.  Repeated rows are returned each.
    Other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    narrow = cut(with_fingerprints(docs, id_col, text_col, words_each, seed), "fingerprints")
    named = narrow.groupBy("fp").agg(F.min("id").alias("least")).filter("least is not null")
    # a node is its fingerprint, so ids may be of any type
    nodes = cut(named.select("fp", F.col("fp").alias("id"), "least"), "fingerprint-nodes")
    component = connected_components(fingerprint_links(nodes.select("fp", "id"), budget)).withColumnRenamed("node", "fp")
    named = nodes.join(component, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "component").select("fp", "component_id"), "fingerprint-components")
    return narrow.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id")
    )


def bit_budget(similarity: float, spare: float = 3.0) -> int:
    """Differing bits to allow a wide fingerprint for a Jaccard similarity: the mean, and `spare` deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = WIDE * BITS
    return round(n * share + spare * math.sqrt(n * share * (1 - share)))


def _agreement(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, deviations: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(sure, open): pairs whose sketches agree by so much that the sets surely are similar, and those that only the sets can tell.

    Of the ranges in which either has a hash the share that agrees estimates the similarity; `deviations` of that
    estimate on either side are open.
    """
    sure, open_ = np.zeros(len(i), bool), np.zeros(len(i), bool)
    for a in range(0, len(i), 4096):
        x, y = sketch[i[a : a + 4096]], sketch[j[a : a + 4096]]
        either = np.maximum(1, ((x != 0) | (y != 0)).sum(1))
        share = ((x == y) & (x != 0)).sum(1) / either
        spread = deviations * np.sqrt(similarity * (1 - similarity) / either)
        sure[a : a + 4096] = share >= similarity + spread
        open_[a : a + 4096] = (share >= similarity - spread) & (share < similarity + spread)
    return sure, open_


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets, as sorted arrays; two empty ones are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _variant_pairs(i: np.ndarray, j: np.ndarray, count: np.ndarray, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of pairs (i, j) of distinct fingerprints, and of the rows of one fingerprint, `step` at a time.

    Rows are in order of fingerprint, count[k] of them with the k-th.
    """
    many = np.flatnonzero(count > 1)
    i, j, start = np.concatenate([i, many]), np.concatenate([j, many]), np.cumsum(count) - count
    ends = np.cumsum(count[i] * count[j])
    for at in range(0, int(ends[-1]) if len(ends) else 0, step):
        flat = np.arange(at, min(at + step, ends[-1]))
        pair = np.searchsorted(ends, flat, side="right")
        flat -= ends[pair] - count[i[pair]] * count[j[pair]]
        u, v = start[i[pair]] + flat // count[j[pair]], start[j[pair]] + flat % count[j[pair]]
        once = (i[pair] != j[pair]) | (u < v)
        yield u[once], v[once]


def _candidates(value: np.ndarray, budget: int):
    """(order, pairs): rows sorted by fingerprint, and an iterator over index pairs, in that order, within the budget."""
    order = np.lexsort(value.T[::-1])
    value = value[order]
    if len(value) <= LEAF:
        i, j = np.triu_indices(len(value), 1)
        close = np.bitwise_count(value[i] ^ value[j]).sum(1) <= budget
        return order, lambda: iter([(i[close], j[close])])
    first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]).any(1)]))
    i, j = trie_pairs(value[first], None, 0, budget)
    return order, lambda: _variant_pairs(i, j, np.diff(np.append(first, len(value))))


class _Forest:
    """Labels of the rows of a group, the least rank of an id reached, and its edges."""

    def __init__(self, ids: np.ndarray):
        self.rank = np.argsort(ids, kind="stable")
        self.ids, self.place = ids, np.empty(len(ids), np.int64)
        self.place[self.rank] = np.arange(len(ids))
        self.label = np.arange(len(ids))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.label[self.place[i]] != self.label[self.place[j]]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.label = least_labels(len(self.ids), self.label[self.place[i]], self.label[self.place[j]])[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.ids)))
        return self.ids[self.rank][moved], self.ids[self.rank][self.label[moved]]


def _group_forest(value: np.ndarray, sketch: np.ndarray, ids: np.ndarray, budget: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, open): a forest of the sure links between some wide fingerprints, equal ones with other sketches among
    them, and the ids that have an open pair across its trees."""
    order, pairs = _candidates(value, budget)
    sketch, ids = sketch[order], ids[order]
    forest, asked = _Forest(ids), np.zeros(len(ids), bool)
    for i, j in pairs():
        apart = forest.apart(i, j)
        i, j = i[apart], j[apart]
        sure, _ = _agreement(sketch, i, j, similarity)
        forest.join(i[sure], j[sure])
    for i, j in pairs():
        apart = forest.apart(i, j)
        i, j = i[apart], j[apart]
        _, open_ = _agreement(sketch, i, j, similarity)
        asked[i[open_]] = asked[j[open_]] = True
    return *forest.edges(), ids[asked]


def _settled_forest(value: np.ndarray, sketch: np.ndarray, ids: np.ndarray, tree: np.ndarray, sets: list[bytes], budget: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links that the sets themselves show between rows of different trees."""
    order, pairs = _candidates(value, budget)
    sketch, ids, tree = sketch[order], ids[order], tree[order]
    own = [np.frombuffer(sets[k], np.uint64) for k in order]
    forest = _Forest(ids)
    for i, j in pairs():
        far = tree[i] != tree[j]
        i, j = i[far], j[far]
        sure, open_ = _agreement(sketch, i, j, similarity)
        for a, b in zip(i[sure | open_].tolist(), j[sure | open_].tolist()):
            if forest.label[forest.place[a]] != forest.label[forest.place[b]] and jaccard(own[a], own[b]) >= similarity:
                forest.join(np.array([a]), np.array([b]))
    return forest.edges()


def _rows(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with `__row`: the id where ids are whole numbers that tell the rows apart, else a number given to each."""
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).filter(F.col(id_col).isNull() | (F.col("__n") > 1)).limit(1).count():
        return docs.withColumn("__row", F.col(id_col).cast("long"))
    return numbered(docs, "near-copy-input")


def keep_one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_each: int = 5,
    similarity: float = 0.8,
    bands: int = 10,
    rows: int = 2,
    per_group: int = 4096,
    seed: int = 42,
    bound: int = 4_000_000,
) -> DataFrame:
    """docs with one row of each group of texts linked by similarity, in docs' columns.

    Similarity is that of the sets of words_each-word shingles.  Wide SimHash fingerprints that differ in at most
    bit_budget(similarity) of WIDE * 64 bits are candidates.  So large a budget prunes little at the top of one trie
    of all fingerprints, so fingerprints are first dealt by keys that similar texts share (one of `bands` keys is
    shared at similarity s with chance 1 - (1 - s ** rows) ** bands), and each key's trie is joined with itself.
    Candidates whose sketches leave no doubt link; texts with a candidate in doubt meet again with their whole sets,
    which decide.  A key with over per_group fingerprints is dealt to tasks as pairs of parts, none left out.

    Texts without words, null ones too, are one group.  The row of the smallest id stays, null ids last; of rows alike
    in text and id any one.  Ids may be of any type, and rows of one id are texts of their own.
    """
    docs = docs.withColumnsRenamed({"__row": "__own_row"}) if "__row" in docs.columns else docs
    back = {"__own_row": "__row"} if "__own_row" in docs.columns else {}
    budget = bit_budget(similarity)
    kind = docs.schema[id_col].dataType.simpleString()

    def describe(batches):
        for batch in batches:
            done = [wide_fingerprint(x, words_each, bands, rows, seed) for x in byte_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.list_(pa.int64()))], ["row", "id", "fp", "keys"])

    small_batches(docs.sparkSession)
    given = _rows(docs, id_col)
    plain = given.select(F.col("__row").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    narrow = cut(plain.mapInArrow(describe, f"row long, id {kind}, fp binary, keys array<long>"), "wide-fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = cut(narrow.groupBy("fp").agg(F.min("row").alias("id"), first, F.min("keys").alias("keys")), "wide-nodes")

    def met(own: DataFrame, more: list[str]) -> DataFrame:
        dealt = own.select("id", "fp", *more, F.explode("keys").alias("key"))
        shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / per_group).alias("parts"))
        dealt = dealt.join(shared, "key").select("*", F.pmod(F.xxhash64("id"), F.col("parts")).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "fp", *more)
        return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def unpacked(table):
        both = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint8).reshape(-1, WIDE * 8 + 2 * BINS)
        return np.ascontiguousarray(both[:, : WIDE * 8]).view(">u8").astype(np.uint64), np.ascontiguousarray(both[:, WIDE * 8 :]).view("<u2"), table.column("id").to_numpy()

    def link(batches):
        for table, at in whole_groups(batches, ["key", "i", "j"]):
            value, sketch, ids = unpacked(table)
            for a, b in zip(at[:-1], at[1:]):
                if b - a > 1:
                    u, v, asked = _group_forest(value[a:b], sketch[a:b], ids[a:b], budget, similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, asked])), pa.array(np.concatenate([v, asked]))], ["u", "v"])

    def settle(batches):
        for table, at in whole_groups(batches, ["key", "i", "j"]):
            value, sketch, ids = unpacked(table)
            tree, sets = table.column("tree").to_numpy(), table.column("shingles").to_pylist()
            for a, b in zip(at[:-1], at[1:]):
                if b - a > 1:
                    u, v = _settled_forest(value[a:b], sketch[a:b], ids[a:b], tree[a:b], sets[a:b], budget, similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def gather(batches):
        for batch in batches:
            sets = []
            for text in byte_values(batch.column(0)):
                blocks = list(shingle_hashes(text, words_each, seed))
                sets.append(np.unique(np.concatenate(blocks)).tobytes() if blocks else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], [*batch.schema.names[1:], "shingles"])

    found = cut(met(nodes, []).mapInArrow(link, "u long, v long"), "near-copies")
    edges = found.filter("u <> v")
    trees = cut(connected_components(edges), "near-copy-trees")
    # texts whose doubt lies inside one tree need no second look
    asked = found.filter("u = v").select(F.col("u").alias("id")).distinct()
    asked = cut(nodes.join(asked, "id").join(trees.withColumnRenamed("node", "id"), "id", "left").select("id", "fp", "keys", F.coalesce("component", "id").alias("tree")), "near-copies-in-doubt")
    texts = plain.select(F.col("row").alias("id"), "text")
    if asked.count() <= bound:
        texts = texts.join(F.broadcast(asked.select("id")), "id", "left_semi")
    carry = texts.join(asked, "id").select("text", "id", "fp", "keys", "tree")
    whole = carry.mapInArrow(gather, "id long, fp binary, keys array<long>, tree long, shingles binary")
    more = cut(met(cut(whole, "near-copy-sets"), ["tree", "shingles"]).mapInArrow(settle, "u long, v long"), "settled-copies")
    component = connected_components(edges.union(more))
    named = nodes.join(component.withColumnRenamed("node", "id"), "id", "left").select("first", F.coalesce("component", "id").alias("component"))
    keep = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    return given.join(keep, "__row", "left_semi").drop("__row").withColumnsRenamed(back)
