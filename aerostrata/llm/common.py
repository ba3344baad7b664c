"""What several operators share: settings, scratch tables, groups in sorted partitions, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from aerostrata.session import configure, materialize, scratch_dir

# Texts come in small Arrow batches, so that a Python worker holds a few MB of them at a time.
_ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    configure(spark)
    for key, value in _ARROW.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` as a zstd table in the shared folder, and the table's path (see `drop`)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def tidily_written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `written`; the write's shuffle files go with it, not when the driver next collects garbage."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that no result reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh_id() -> int:
    """A random non-negative long; used only for rows that are written before they are read."""
    return uuid.uuid4().int >> 65


def pieces_of(n: int, size: int) -> int:
    return max(1, -(-n // size))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches of a partition sorted by integer `keys`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            change[0] = any(last.column(k)[last.num_rows - 1].as_py() != c[0] for k, c in zip(keys, columns))
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        cut = int(cuts[-1])
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of `a` and `b`, element by element; `parent` stays flat, roots smallest."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


_SLOTS = 1 << 18


def likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of `df` whose SQL expression `key`, a long, may be among the longs `key` of `keys`.

    A bitmap of `_SLOTS` x 64 bits goes to all tasks, at most `_SLOTS` rows of two longs whatever the
    input; rows that meet no set bit need no shuffle. It only spares work: a join has to follow.
    """
    def slot(k: str) -> str:
        return f"pmod(shiftright({k}, 6), {_SLOTS}L)"

    bits = keys.groupBy(F.expr(slot("key")).alias("_bitmap_slot")).agg(
        F.expr("bit_or(shiftleft(1L, int(key & 63)))").alias("_bitmap_bits")
    )
    keyed = df.withColumn("_bitmap_key", F.expr(key)).withColumn("_bitmap_slot", F.expr(slot("_bitmap_key")))
    met = keyed.join(F.broadcast(bits), "_bitmap_slot").filter("shiftright(_bitmap_bits, int(_bitmap_key & 63)) & 1 = 1")
    return met.select(*df.columns)


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: the larger (or smaller) neighbours of a node link to its smallest one."""
    if large:
        near = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """Connected components of links `a`, `b` (longs): rows (node, root), roots left out.

    Alternating star steps: each halves the distance to the smallest member, no step makes more
    links than it had, and a round is written to the shared folder before the next one. The root is
    the smallest node of its component. Returns the table and its path.
    """
    spark = edges.sparkSession
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, path = written(ordered.distinct(), "links")
    before = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(a % 1000003)")).first()
        if sums == before or sums[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")), path
        before = sums
        stepped, to = written(_round(_round(now, True), False), "links")
        drop(spark, path)
        now, path = stepped, to


__all__ = [
    "components", "drop", "fresh_id", "likely", "link", "materialize", "pieces_of", "prepared",
    "tidily_written", "whole_groups", "written",
]
