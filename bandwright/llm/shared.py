"""What several training-data operators use: the shared folder, lineage cuts, components, text bytes."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's bytes.split() splits on exactly these bytes, so it and this pattern agree.
WORD = r"[^\x20\x09-\x0D]+"


_OWN: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or on one machine, where that is unset, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="bandwright-")
    return _OWN[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/bandwright/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut wrote and that nothing reads again."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            remove(df.sparkSession, path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with `__row`, a number of its own for each row, frozen by writing it."""
    return cut(docs.select("*", F.monotonically_increasing_id().alias("__row")), name)


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of 8 MB, not 64: two workers then fit beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo: the fixed fold of a row.  A null id counts as crc32 of no bytes, 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0).cast("long")) % modulus


def byte_values(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def byte_chunks(values: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of values of about limit bytes each; at least one value in each."""
    start, held = 0, 0
    for i, value in enumerate(values):
        if held and held + len(value) > limit:
            yield start, i
            start, held = i, 0
        held += len(value)
    if start < len(values):
        yield start, len(values)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Alternating large-star and small-star steps.  Each step takes the least neighbour of a node by a
    partially aggregated min and joins it back, so a node with very many edges is never gathered in a
    task; every round is written to the shared folder.  Nodes without edges are not returned.
    """
    stars = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v")
    stars = cut(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = print_of(stars)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large.union(stars.join(least, "u").filter("u <> m").select("u", F.col("m").alias("v"))).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        stars = cut(small.distinct(), "small-star")
        after = print_of(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def whole_groups(batches, keys: list[str]):
    """From batches sorted by whole-number keys: tables that end where a group ends, and each group's bounds."""
    import numpy as np
    import pyarrow as pa

    def bounds(table):
        changed = np.zeros(max(0, len(table) - 1), bool)
        for k in keys:
            v = table.column(k).to_numpy()
            changed |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(changed) + 1, [len(table)]])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        at = bounds(held)
        if len(at) > 2:
            yield held.slice(0, at[-2]).combine_chunks(), at[:-1]
            held = held.slice(at[-2])
    if held is not None and len(held):
        yield held.combine_chunks(), bounds(held)
