"""Turns of conversations in order, whatever the length of one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerostrata.llm.common import drop, written

WORDS = r"[^\x20\x09-\x0D]+"


def text_key(role: Column, text: Column) -> Column:
    """A digest of role and text; the role's length keeps the two apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def in_parts(rows: DataFrame, conv: str, order: list[str], name: str) -> tuple[DataFrame, str]:
    """`rows`, written in ranges of (conv, *order), and the range's number `part`.

    A long conversation covers several ranges. They are written, so that a row's range stays the same
    however often its task runs. Returns the table and its path.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, conv, *order).withColumn("part", F.spark_partition_id()), name)


def numbered(rows: DataFrame, conv: str, order: list[str]) -> tuple[DataFrame, str]:
    """`rows` with `pos`, a row's place in its conversation by `order` (nulls first), from 0.

    Rows are numbered inside their range; the rows of the ranges before are added to that. `conv`
    holds no nulls. Returns the table and its path.
    """
    dealt, path = in_parts(rows, conv, order, "turn-ranges")
    before = Window.partitionBy(conv).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(conv, "part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(conv, "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(conv, "part").orderBy(*order)
    own = dealt.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, [conv, "part"])
    out = own.withColumn("pos", F.col("_place") + F.col("_before")).drop("_place", "_before", "part")
    table, to = written(out, "turns")
    drop(rows.sparkSession, path)
    return table, to
