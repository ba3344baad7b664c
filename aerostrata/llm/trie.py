"""Prefix trie of conversations by van Emde Boas recursion.

A trie of depth below 2^J is cut at half its depth into one upper trie and the lower forests that
hang below the cut, and each of them is cut again. All parts of one size are handled together, so
there are J rounds whatever the number of conversations:

* up: the names of blocks of 2^j turns, from the names of their two halves;
* down: the part above a cut names the prefix at the cut, with which the forests below it begin;
  after the last round every depth of every conversation has the name of its prefix;
* graft: a lower tree's totals are added to the nodes above its root inside the part that was cut
  there, from the smallest parts to the whole trie.

Parts are aligned to multiples of their size, so a prefix has the same name in every conversation.
Names are 128 bits of hashes. Rounds are joins and aggregates of small rows with map-side partials;
the turns of one conversation or the members of one node are never gathered. The ids that end in a
node are hashed as a stream of sorted chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aerostrata.llm.common import drop, prepared, written
from aerostrata.llm.turns import WORDS, numbered, text_key

CHUNK = 16_384   # ids that one row of sorted chunks holds
_ROOT = (0, 0)


def _name(kind: int, *of: Column | str) -> list[Column]:
    """Columns a, b: two hashes of `of`, apart from those of other kinds."""
    return [F.xxhash64(F.lit(2 * kind + k), *of).alias(c) for k, c in enumerate("ab")]


def shared_starts(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame, list[str]]:
    """Conversations that share first turns, rebuilt from a table conv_id, turn, role, text.

    Conversation c gets the first h turns of c - c % every (all if fewer), then its own turns after
    its first h; h = crc32(decimal c) % most. Returns the turns (conv, depth from 1, a, b, words),
    all conversations (conv, len) and the paths of the tables.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text_key(role, text).alias("key"), F.regexp_count(text, F.lit(WORDS)).alias("words"),
    ).filter("conv IS NOT NULL")
    own, path = numbered(rows, "conv", ["turn", "role", "key"])
    own = own.select("conv", "pos", "words", *_name(0, "key"))
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    convs = convs.withColumn("base", F.expr(f"conv - conv % {every}"))
    bases = convs.select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs, convs_path = written(convs.withColumn("len", F.expr("taken + greatest(n - h, 0)")), "conversations")
    firsts = own.filter(F.col("pos") < most).withColumnRenamed("conv", "base")
    taken = convs.filter("taken > 0").join(firsts, "base").filter("pos < taken")
    after = own.filter(F.col("pos") >= F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    after = after.join(convs.select("conv", "h", "taken"), "conv").withColumn("pos", F.expr("pos - h + taken"))
    columns = ["conv", F.expr("pos + 1").alias("depth"), "a", "b", "words"]
    rebuilt, rebuilt_path = written(taken.select(columns).unionAll(after.select(columns)), "rebuilt")
    drop(turns.sparkSession, path)
    return rebuilt, convs.select("conv", "len"), [convs_path, rebuilt_path]


def _prefixes(turns: DataFrame, convs: DataFrame, rounds: int) -> tuple[DataFrame, list[str]]:
    """The name of every prefix: conv, len, depth (0 to len), a, b."""
    blocks, paths = [turns.select("conv", F.expr("depth - 1").alias("k"), "a", "b")], []
    for _ in range(1, rounds):
        pick = {f"{s}{c}": F.max(F.when(F.expr(f"k % 2 = {i}"), F.col(c))) for i, s in enumerate(("l", "r")) for c in "ab"}
        halves = blocks[-1].groupBy("conv", F.expr("k div 2").alias("k")).agg(*[v.alias(k) for k, v in pick.items()])
        whole = halves.filter("la IS NOT NULL AND ra IS NOT NULL")
        table, path = written(whole.select("conv", "k", *_name(1, "la", "lb", "ra", "rb")), "blocks")
        blocks.append(table)
        paths.append(path)
    parts = convs.select("conv", "len", F.lit(0).cast("long").alias("m"), *[F.lit(v).cast("long").alias(c) for v, c in zip(_ROOT, "ab")])
    for j in reversed(range(rounds)):
        upper = blocks[j].filter("k % 2 = 0").select("conv", F.expr("k div 2").alias("m"), F.col("a").alias("ua"), F.col("b").alias("ub"))
        cut = parts.join(upper, ["conv", "m"], "left")
        a, b = _name(2, "a", "b", "ua", "ub")
        here = F.struct((F.col("m") * 2).alias("m"), "a", "b")
        below = F.struct((F.col("m") * 2 + 1).alias("m"), a, b)
        both = F.when(F.expr(f"len >= (2 * m + 1) * {1 << j}"), F.array(here, below)).otherwise(F.array(here))
        parts = cut.select("conv", "len", F.explode(both).alias("p")).select("conv", "len", "p.m", "p.a", "p.b")
    return parts.withColumnRenamed("m", "depth"), paths


def _grafted(nodes: DataFrame, path: DataFrame, rounds: int) -> tuple[DataFrame, list[str]]:
    """Subtree totals of every node: a, b, n_leaves, saved_tokens."""
    own = nodes.select("a", "b", F.expr("CAST(n_children = 0 AS LONG)").alias("n_leaves"), F.expr("(n_convs - 1) * words").alias("saved_tokens"))
    grafts: list[tuple[int, DataFrame]] = []
    paths = []
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    for j in range(rounds):
        size = 2 << j
        cut = f"depth % {size} = {size >> 1}"
        roots = nodes.filter(cut).select("a", "b", "conv_id", "depth")
        # Only cuts that were in an upper part in all rounds before can be a root now.
        values = roots.join(own, ["a", "b"]).select("a", "b", "n_leaves", "saved_tokens")
        for _, table in grafts:
            values = values.unionAll(table.filter(cut).select("a", "b", "n_leaves", "saved_tokens"))
        values = values.groupBy("a", "b").agg(*sums)
        roots = roots.join(values, ["a", "b"]).select(
            F.col("conv_id").alias("conv"), F.expr(f"depth div {size}").alias("m"), "n_leaves", "saved_tokens"
        )
        above = path.filter(f"len >= {size >> 1} AND depth % {size} < {size >> 1}")
        above = above.select("conv", F.expr(f"depth div {size}").alias("m"), "a", "b", "depth")
        found = above.join(roots, ["conv", "m"]).groupBy("a", "b", "depth").agg(*sums)
        table, where = written(found, "grafts")
        grafts.append((j, table))
        paths.append(where)
    for _, table in grafts:
        own = own.unionAll(table.select("a", "b", "n_leaves", "saved_tokens"))
    return own.groupBy("a", "b").agg(*sums), paths


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of rows sorted by (a, b, conv): at most CHUNK of a node in one row."""
    held: list = [None, []]

    def flush() -> list:
        (a, b), ids = held
        return [(a, b, ids[0], ",".join(map(str, ids)))]

    def table(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["a", "b", "first", "ids"])

    for batch in batches:
        out = []
        for a, b, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if held[0] != (a, b) or len(held[1]) == CHUNK:
                if held[1]:
                    out += flush()
                held[:] = [(a, b), []]
            held[1].append(conv)
        if out:
            yield table(out)
    if held[1]:
        yield table(flush())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come sorted; only the hash's state is kept."""
    key, state, out = None, None, []

    def table() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["a", "b", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if (a, b) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        if len(out) >= 4096:
            yield table()
            out.clear()
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield table()


def _end_digests(ends: DataFrame) -> DataFrame:
    """a, b and ends_sha256 of nodes in which some conversation ends."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ends.repartitionByRange(n, "a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    chunks = ranges.mapInArrow(_chunks, "a long, b long, first long, ids string")
    return chunks.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of conversations given by `turns` (conv, depth from 1, a, b: the turn's name, words) and
    `convs` (conv, len).

    One row per node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, each node's members but one times the words
    of its last turn) and ends_sha256.
    """
    spark = prepared(turns.sparkSession)
    rounds = int(convs.agg(F.max("len")).first()[0] or 0).bit_length()
    names, block_paths = _prefixes(turns, convs, rounds)
    names, names_path = written(names, "prefixes")
    drop(spark, *block_paths)
    # Name, parent's name and last words of a conversation's depth meet in one shuffle.
    none = [F.lit(None).cast("long").alias(c) for c in ("pa", "pb")]
    met = names.select("conv", "depth", "len", "a", "b", *none, F.lit(None).cast("long").alias("words")).unionAll(
        names.select("conv", F.expr("depth + 1"), F.lit(None), F.lit(None), F.lit(None), "a", "b", F.lit(None))
    ).unionAll(turns.select("conv", "depth", F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None), "words"))
    path = met.groupBy("conv", "depth").agg(*[F.max(c).alias(c) for c in ("len", "a", "b", "pa", "pb", "words")]).filter("a IS NOT NULL")
    path, path_path = written(path, "paths")
    drop(spark, names_path)
    nodes = path.groupBy("a", "b").agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.coalesce(F.max("words"), F.lit(0)).alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
    )
    nodes, nodes_path = written(nodes, "trie-nodes")
    children = nodes.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children")).filter("pa IS NOT NULL")
    children = children.withColumnsRenamed({"pa": "a", "pb": "b"})
    full = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    full, full_path = written(full, "trie-nodes")
    drop(spark, nodes_path)
    totals, graft_paths = _grafted(full, path, rounds)
    ends = _end_digests(path.filter("depth = len").select("a", "b", "conv"))
    parents = full.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = full.join(parents, ["pa", "pb"], "left").join(totals, ["a", "b"]).join(ends, ["a", "b"], "left")
    out = out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    out, _ = written(out, "trie")
    drop(spark, path_path, full_path, *graft_paths)
    return out


def shared_trie(table: DataFrame) -> DataFrame:
    """The prefix trie of a table conv_id, turn, role, text after `shared_starts`.

    Turns are ordered by turn, a null one first, then by role and a digest of role and text; each row is
    a turn, repeated rows too. A null or empty role or text is empty. Rows without conv_id belong to no
    conversation and are left out. A conversation without turns ends in the root. An empty table has
    no nodes. Other columns are not read.
    """
    spark = prepared(table.sparkSession)
    turns, convs, paths = shared_starts(table)
    out = prefix_trie(turns, convs)
    drop(spark, *paths)
    return out
