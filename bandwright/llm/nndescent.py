"""Embedding near-duplicates by NN-descent."""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import connected_components, cut, whole_groups

log = logging.getLogger(__name__)


def _matrix(column, dim: int, kind) -> np.ndarray:
    """Unit rows in double precision of a column of packed vectors."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, str]:
    """(id, space, dim, vec): vectors as bytes; space, the label and dimension, is null where a row can link with nothing."""
    single = rows.schema[vec_col].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"

    def pack(batches):
        for batch in batches:
            vecs, spaces, dims = [], [], []
            for v, label in zip(batch.column(1), batch.column(2).to_pylist()):
                x = None
                if v.is_valid and label is not None and v.values.null_count == 0 and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    with np.errstate(over="ignore"):
                        length = np.linalg.norm(x.astype(np.float64))
                    if not (np.isfinite(x).all() and np.isfinite(length) and length > 0):
                        x = None
                vecs.append(None if x is None else x.tobytes())
                dims.append(None if x is None else len(x))
                spaces.append(None if x is None else f"{len(x)}:{label}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spaces, pa.string()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["id", "space", "dim", "vec"])

    label = F.col(label_col).cast("string")
    id_kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(vec_col), label.alias("label")).mapInArrow(pack, f"id {id_kind}, space string, dim int, vec binary"), kind


def _first_lists(nodes: DataFrame, kind: str, tables: int, planes: int, width: int, k: int, seed: int) -> DataFrame:
    """(u, v, sim): neighbours among the `width` vectors next to one another in sorts by random signatures."""

    def sign(batches):
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            dims = np.array(at["dim"].to_pylist())
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = _matrix(at["vec"].take(pa.array(own)), int(dim), kind)
                for t in range(tables):
                    draw = np.random.default_rng([seed, t, int(dim)]).standard_normal((int(dim), planes + 1))
                    p = x @ draw
                    sig = (p[:, :planes] > 0) @ (1 << np.arange(planes, dtype=np.int64)) if planes else np.zeros(len(own), np.int64)
                    take = [at[n].take(pa.array(own)) for n in ("node", "space", "dim", "vec")]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(own), pa.int32()), pa.array(sig.astype(np.int64)), pa.array(p[:, -1]), *take], ["t", "sig", "proj", "node", "space", "dim", "vec"])

    def near(batches):
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            while held is not None and (len(held) > width or batch is None):
                part = held.slice(0, width).combine_chunks()
                yield _window_best(part, kind, k)
                if len(held) <= width:
                    held = None
                else:
                    held = held.slice(width // 2)  # the next window holds half of this one

    signed = nodes.select("node", "space", "dim", "vec").mapInArrow(sign, "t int, sig long, proj double, node long, space string, dim int, vec binary")
    dealt = signed.repartitionByRange("t", "space", "sig", "proj", "node").sortWithinPartitions("t", "space", "sig", "proj", "node")
    return dealt.mapInArrow(near, "u long, v long, sim double")


def _with_end(batches):
    yield from batches
    yield None


def _nearest(x: np.ndarray, node: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, sim) of the k nearest to each of some vectors among them, where they beat its worst."""
    s = x @ x.T
    s[(node[:, None] == node[None]) | (s <= worst[:, None])] = -3.0
    most = min(k, len(node) - 1)
    best = np.argpartition(-s, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(s, best, 1)
    good = value > -2.5
    return np.repeat(node, good.sum(1)), node[best[good]], value[good]


def _window_best(part: pa.Table, kind: str, k: int) -> pa.RecordBatch:
    spaces, dims, node = np.array(part.column("space").to_pylist()), part.column("dim").to_numpy(), part.column("node").to_numpy()
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for space in dict.fromkeys(spaces.tolist()):
        own = np.flatnonzero(spaces == space)
        if len(own) > 1:
            x = _matrix(part.column("vec").combine_chunks().take(pa.array(own)), int(dims[own[0]]), kind)
            found.append(_nearest(x, node[own], np.full(len(own), -2.0), k))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*found)], ["u", "v", "sim"])


def _best_lists(found: DataFrame, size: DataFrame) -> DataFrame:
    """Of all that was found the `k` nearest of each node."""
    own = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    one = found.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return one.join(size, "u").select("*", F.row_number().over(own).alias("r")).filter("r <= k").select("u", "v", "sim", "k")


def _refine(lists: DataFrame, nodes: DataFrame, kind: str, k: int, chunk: int) -> DataFrame:
    """(u, v, sim) that beat u's list, from the neighbours of neighbours: each node compares its neighbours, both ways.

    A node with very many neighbours deals them to several comparisons of about `chunk` vectors.
    """
    worst = lists.groupBy("u").agg(F.when(F.count(F.lit(1)) >= F.max("k"), F.min("sim")).otherwise(-2.0).alias("worst"))
    both = lists.select("u", "v").union(lists.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    sent = both.join(degree, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("d") / chunk)).alias("salt"))
    card = nodes.select(F.col("node").alias("v"), "space", "dim", "vec").join(worst.withColumnRenamed("u", "v"), "v", "left").select("v", "space", "dim", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    own = nodes.select(F.col("node").alias("u"), F.lit(0).cast("long").alias("salt"), F.col("node").alias("v"))
    met = sent.union(own.select("u", "v", "salt")).join(card, "v")

    def compare(batches):
        for table, at in whole_groups(batches, ["u", "salt"]):
            node, worst, dims = (table.column(c).to_numpy() for c in ("v", "worst", "dim"))
            vecs = table.column("vec").combine_chunks()
            found = []
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = _matrix(vecs.take(pa.array(own)), int(dim), kind)
                place = np.zeros(len(dims), np.int64)
                place[own] = np.arange(len(own))
                for a, b in zip(at[:-1], at[1:]):
                    if b - a > 1 and dims[a] == dim:
                        found.append(_nearest(x[place[a] : place[a] + b - a], node[a:b], worst[a:b], k))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*found)], ["u", "v", "sim"])

    dealt = met.select("u", "salt", "v", "dim", "vec", "worst").repartition("u", "salt").sortWithinPartitions("u", "salt")
    return dealt.mapInArrow(compare, "u long, v long, sim double")


def _degrees(lists: DataFrame, component: DataFrame, nodes: DataFrame, kind: str, threshold: float, block: int) -> DataFrame:
    """(node, n): copies of other vectors linked to a node.

    Lists that are not full of links hold them all.  A node whose list is full has more links than it can list, and is
    compared with its component, block by block, which gives counts, not pairs.
    """
    linked = lists.filter(F.col("sim") >= threshold)
    full = linked.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).filter("n >= k").select(F.col("u").alias("node"))
    full = cut(full, "full-lists")
    dense = component.join(full, "node").select("component").distinct()
    inside = component.join(dense, "component").select("node", "component").join(full.withColumn("full", F.lit(True)), "node", "left")
    size = inside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    cards = inside.join(size, "component").join(nodes.select("node", "dim", "vec", "copies"), "node")
    cards = cards.select("*", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cards = cards.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "dim", "vec", "copies", "own", F.coalesce("full", F.lit(False)).alias("full"))

    def count(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        x = _matrix(table.column("vec"), table.column("dim")[0].as_py(), kind)
        node, copies, own = table.column("node").to_numpy(), table.column("copies").to_numpy(), table.column("own").to_numpy()
        asked = np.flatnonzero(table.column("full").to_numpy())
        n = np.zeros(len(asked), np.int64)
        for a in range(0, len(asked), 1024):
            at = asked[a : a + 1024]
            near = x[at] @ x.T >= threshold
            near &= (node[at, None] != node[None]) & ((own[at, None] != own[None]) if i != j else True)
            n[a : a + 1024] = near @ copies
        return pa.table({"node": node[asked], "n": n})

    exact = cards.groupBy("component", "i", "j").applyInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    sparse = linked.select("u", "v").union(linked.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    sparse = sparse.join(full.select(F.col("node").alias("u")), "u", "left_anti")
    sparse = sparse.join(nodes.select(F.col("node").alias("v"), "copies"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("n"))
    return exact.union(sparse)


def _audit(nodes: DataFrame, degree: DataFrame, kind: str, threshold: float, sample: int, enough: int, seed: int, most: int = 16) -> tuple[float, int]:
    """(share, links): of the links of hashed nodes, compared with all vectors, the share that degree counts.

    About `sample` nodes are asked at a time, until `enough` links are seen or `most` such blocks have been.
    """
    blocks, links, counted = max(1, -(-nodes.count() // sample)), 0, 0
    for block in range(min(blocks, most)):
        asked = nodes.filter(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(blocks)) == block).select("node", "space", "dim", "vec").toArrow()
        true, found = _asked_links(asked, nodes, degree, kind, threshold) if len(asked) else (0, 0)
        links, counted = links + true, counted + found
        if links >= enough:
            break
    return (counted / links if links else 1.0), links


def _asked_links(asked: pa.Table, nodes: DataFrame, degree: DataFrame, kind: str, threshold: float) -> tuple[int, int]:
    """Links that the asked nodes have, and how many of them degree counts."""
    spaces = asked.column("space").to_pylist()
    sent = {s: [i for i, x in enumerate(spaces) if x == s] for s in set(spaces)}
    query, vecs, dims = asked.column("node").to_numpy(), asked.column("vec").to_pylist(), asked.column("dim").to_pylist()
    unit = {s: _matrix(pa.array([vecs[i] for i in at]), dims[at[0]], kind) for s, at in sent.items()}

    def truth(batches):
        for batch in batches:
            row_spaces = np.array(batch.column(1).to_pylist())
            for s in set(row_spaces.tolist()) & set(unit):
                own = np.flatnonzero(row_spaces == s)
                x = _matrix(batch.column(3).take(pa.array(own)), batch.column(2)[int(own[0])].as_py(), kind)
                node, copies = batch.column(0).to_numpy(zero_copy_only=False)[own], batch.column(4).to_numpy(zero_copy_only=False)[own]
                q = query[sent[s]]
                near = (unit[s] @ x.T >= threshold) & (q[:, None] != node[None])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(near @ copies)], ["node", "t"])

    true = nodes.select("node", "space", "dim", "vec", "copies").mapInArrow(truth, "node long, t long").groupBy("node").agg(F.sum("t").alias("t"))
    both = true.join(degree, "node", "left").agg(F.sum("t"), F.sum(F.least("t", F.coalesce("n", F.lit(0))))).first()
    return both[0] or 0, both[1] or 0


def near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    k: int = 12,
    longest: int = 48,
    rounds: int = 3,
    recall: float = 0.95,
    seed: int = 42,
    audit: int = 256,
    enough: int = 2000,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links of cosine >= threshold inside a label.

    Equal vectors of a label are one node, with a count of copies.  Nodes start from neighbours in random
    signature sorts; each round compares the neighbours of every node with one another and keeps the nearest.
    A list that is full of links is doubled, up to `longest`; a node whose list still is full is counted against its
    component.  An audit compares hashed nodes with all vectors until `enough` links are seen; below `recall`, more
    random sorts and two more rounds follow, and an answer that stays below it is an error, not a result.

    Rows whose vector is null, empty, zero or has null or non-finite components, or whose label is null, link
    with nothing: 0 links, their own id as component, kept.  Vectors of different lengths do not link.  Repeated
    rows are other vectors of the same id.  Rows with null ids link but name no component.
    """
    packed, kind = _packed(rows, id_col, vec_col, label_col)
    packed = cut(packed, "vectors")
    classes = cut(packed.filter("space is not null").groupBy("space", "dim", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    nodes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "vector-nodes")
    largest = nodes.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    planes = max(0, min(40, round(math.log2(max(1, largest / 64)))))
    found = _first_lists(nodes, kind, 8, planes, 128, k, seed)
    size = nodes.select(F.col("node").alias("u"), F.lit(k).alias("k"))
    lists = cut(_best_lists(found, size), "neighbours")
    done, extra = 0, rounds
    while True:
        for _ in range(extra):
            grown = lists.groupBy("u").agg(F.max("k").alias("k"), F.sum((F.col("sim") >= threshold).cast("long")).alias("n"))
            grown = grown.select("u", F.when((F.col("n") >= F.col("k")) & (F.col("k") < longest), F.col("k") * 2).otherwise(F.col("k")).alias("k"))
            fresh = _refine(lists.join(grown.withColumnRenamed("k", "bigger"), "u").select("u", "v", "sim", F.col("bigger").alias("k")), nodes, kind, longest, 64)
            now = cut(_best_lists(lists.select("u", "v", "sim").union(fresh), size.join(grown.select("u", F.col("k").alias("g")), "u", "left").select("u", F.coalesce("g", "k").alias("k"))), "neighbours")
            done += 1
            stable = now.join(lists.select("u", "v"), ["u", "v"], "left_anti").count() <= 0.002 * max(1, now.count())
            lists = now
            if stable:
                break
        component = cut(connected_components(lists.filter(F.col("sim") >= threshold), "u", "v"), "vector-components")
        degree = cut(_degrees(lists, component, nodes, kind, threshold, 256), "degrees")
        got, links = _audit(nodes, degree, kind, threshold, audit, enough, seed)
        log.info("nn-descent: %d rounds, recall %.4f on %d links", done, got, links)
        if got >= recall:
            break
        if done >= rounds + 8:
            raise RuntimeError(f"recall {got:.4f} on {links} links is below {recall} after {done} rounds")
        fresh = _first_lists(nodes, kind, 8, planes, 128, longest, seed + done)
        sizes = lists.groupBy("u").agg(F.max("k").alias("g"))
        lists = cut(_best_lists(lists.select("u", "v", "sim").union(fresh), size.join(sizes, "u", "left").select("u", F.coalesce("g", "k").alias("k"))), "neighbours")
        extra = 2
    least = component.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    least = component.join(least, "component").select("node", "least")
    named = nodes.join(least, "node", "left").join(degree, "node", "left").select("space", "vec", F.coalesce("least", "first").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = packed.join(named, ["space", "vec"], "left")
    group = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(False)).alias("kept"))
