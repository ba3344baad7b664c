"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest reference points. Two vectors are compared if their nearest
eight have at least three points in common. Instead of one inverted list per point, which a large part
of all vectors would share, the index keeps a list for every three of a vector's points: vectors with
three points in common meet there. In a list the shared points are counted, a pair is taken up only
in the list of its three smallest common points, and its cosine is computed in double precision.

Equal vectors are one class with a count. A long list is dealt out in tiles, pairs of chunks of
bounded size, and a tile reports sums and a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aerostrata.llm.common import components, drop, link, prepared, whole_groups, written

POINTS = 256         # reference points; their numbers fit in a byte
NEAREST = 8
SHARED = 3
COSINE = 0.93
CLOSE = 0.7          # largest cosine of two reference points
SAMPLE = 4096        # vectors from which reference points are chosen; all vectors are indexed
CHUNK = 512          # vectors of a long list that meet the same number of others in one tile
_TRIPLES = np.array(list(combinations(range(NEAREST), SHARED)))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares cannot overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def reference_points(sample: np.ndarray, width: int, points: int = POINTS) -> np.ndarray:
    """Vectors of the sample far from each other, then random directions, none close to another one.

    Close points would split a group of near copies by chance; where there is no room for `points`
    of them, as in few dimensions, there are fewer.
    """
    found = np.zeros((0, width))
    rng = np.random.default_rng(width)
    for rows in (np.unique(sample, axis=0), rng.normal(size=(4 * points, width))):
        if not len(rows):
            continue
        own = unit(rows)
        near = np.max(own @ found.T, axis=1, initial=-2.0)
        while len(found) < points:
            k = int(near.argmin())
            if near[k] > CLOSE:
                break
            found = np.concatenate([found, own[k:k + 1]])
            near = np.maximum(near, own @ own[k])
    return np.concatenate([found, np.zeros((max(0, NEAREST - len(found)), width))])


def nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Numbers of each row's nearest points, ascending."""
    order = np.argsort(-(rows @ points.T), axis=1, kind="stable")[:, :NEAREST]
    return np.sort(order, axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _described(points_of: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = np.array([len(v) for v in b.column(1)])
            for width in np.unique(widths):
                own = b.filter(pa.array(widths == width))
                near = points_of.get(int(width))
                if near is None:
                    near = reference_points(np.zeros((0, width)), int(width))
                top = nearest(unit(_matrix(own.column(1))), near)
                three = top[:, _TRIPLES].astype(np.int64)
                keys = (three[:, :, 0] << 16) + (three[:, :, 1] << 8) + three[:, :, 2]
                yield pa.RecordBatch.from_arrays([
                    own.column(0), pa.array([t.astype(np.uint8).tobytes() for t in top], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())),
                ], ["node", "top", "keys"])

    return run


def _tile_links(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["label", "width", "key", "lo", "hi"]):
            fields = {k: table[k].to_numpy() for k in ("label", "width", "key", "lo", "hi", "chunk", "node", "n")}
            change = np.zeros(table.num_rows, bool)
            for k in ("label", "width", "key", "lo", "hi"):
                change[1:] |= fields[k][1:] != fields[k][:-1]
            starts = np.r_[0, np.flatnonzero(change)]
            for lo, hi in zip(starts, np.r_[starts[1:], table.num_rows]):
                if hi - lo < 2:
                    continue
                part = table.slice(lo, hi - lo)
                rows, node, count = unit(_matrix(part["embedding"])), fields["node"][lo:hi], fields["n"][lo:hi]
                # Points up to the key's third: a pair has just the key's three of them in common.
                last = int(fields["key"][lo]) & 255
                member = np.zeros((hi - lo, POINTS), np.float32)
                top = np.frombuffer(b"".join(part["top"].to_pylist()), np.uint8).reshape(-1, NEAREST)
                np.put_along_axis(member, top.astype(np.int64), 1, axis=1)
                shared = member[:, :last + 1] @ member[:, :last + 1].T
                hit = (shared == SHARED) & (rows @ rows.T >= cosine)
                np.fill_diagonal(hit, False)
                if fields["lo"][lo] != fields["hi"][lo]:  # pairs inside a chunk have a tile of their own
                    chunk = fields["chunk"][lo:hi]
                    hit &= chunk[:, None] != chunk[None, :]
                if not hit.any():
                    continue
                parent = np.arange(hi - lo)
                link(parent, *np.nonzero(np.triu(hit)))
                linked = np.flatnonzero(hit.any(axis=1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(node[linked]), pa.array((hit @ count)[linked].astype(np.int64)), pa.array(node[parent[linked]]),
                ], ["node", "links", "root"])

    return run


def near_groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links and groups of all vectors: vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null and they have as many components.
    Those that are null, empty, zero, or hold null or non-finite components link with nothing, and
    neither does a null label; such a row is its own group. n_links counts rows, copies and repeated
    rows included. A null vec_id counts as a row but never names a group that has another id. An
    empty table gives no rows; other columns are not read.
    """
    spark = prepared(vectors.sparkSession)
    sound = (
        "label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0"
        " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(embedding, x -> x <> 0)"
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False))).withColumn(
        "h1", F.when(F.col("sound"), F.xxhash64("embedding"))
    ).withColumn("h2", F.when(F.col("sound"), F.xxhash64(F.lit(1), "embedding")))
    keys = ["label", "h1", "h2"]
    classes = rows.filter("sound").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding")
    )
    nodes, _ = written(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("embedding").cast("long")), "vectors")
    sample: dict[int, list] = {}
    for row in nodes.orderBy("h1", "h2").select("embedding").limit(SAMPLE).collect():
        sample.setdefault(len(row[0]), []).append(row[0])
    points = {w: reference_points(np.array(v, np.float64), w) for w, v in sample.items()}
    described, index_path = written(
        nodes.select("node", "embedding").mapInArrow(_described(points), "node long, top binary, keys array<long>"), "pivot-index"
    )
    postings = nodes.select("node", "label", "width").join(described.select("node", F.explode("keys").alias("key")), "node")
    lists = postings.groupBy("label", "width", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = postings.join(lists, ["label", "width", "key"]).withColumn("chunks", chunks).withColumn(
        "chunk", F.expr("int(pmod(xxhash64(node), chunks))")
    ).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    tiles = dealt.select(
        "node", "label", "width", "key", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")
    ).join(described.select("node", "top"), "node").join(nodes.select("node", "n", "embedding"), "node")
    order = ["label", "width", "key", "lo", "hi"]
    found, found_path = written(
        tiles.repartition(*order).sortWithinPartitions(*order).mapInArrow(_tile_links(cosine), "node long, links long, root long"), "vector-links"
    )
    member, _ = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted, _ = written(found.groupBy("node").agg(F.sum("links").alias("links")), "vector-counts")
    drop(spark, index_path, found_path)
    rooted = nodes.select(*keys, "n", "least", "node").join(counted, "node", "left").join(member, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(ids, "root").select(*keys, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    out = rows.drop("embedding").join(named, keys, "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("sound"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
