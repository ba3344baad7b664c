"""Exact k nearest neighbours as Spark joins over a tree of pivots.

Points are dealt to the nearest of a few pivots, crowded cells to pivots of their own, and so on: a
tree whose leaves hold a bounded number of points and whose number of leaves grows with the input.
Every node knows how near and how far its points are from its pivot. A leaf is a folder of its own
below the shared folder.

Queries start in their home leaf, which bounds their answers, and are grouped by neighbouring home
leaves: small leaves share a group, a crowded one fills several. The task of a group goes down the tree; the triangle inequality and the bisecting planes between sibling pivots rule out what cannot hold
anything nearer. Leaves that are left are opened one after the other, the nearest first, each only for
the queries that may still find something in it. So vectors are shuffled once for a search, however
many leaves are visited, each leaf is read once for a whole group, and a task holds one group, one leaf
and the nodes (one row for some thousand points). (After Brin, "Near neighbor search in large metric spaces", 1995.) Nothing is
capped: the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aerostrata.session import materialize

BLOCK_ROWS = 10_000  # points of one leaf
VISIT_ROWS = 5_000  # points of one group that goes down a level
SEARCH_ROWS = 10_000  # queries of one group that opens leaves
FANOUT = 32  # pivots of a node, about; twice as many at most
DEEPEST = 16  # a cell that pivots did not divide by then is cut by hash
_SLACK = 1e-6  # covers rounding in the bounds, relative to the vectors' length
_PAIRS = 1 << 16  # pairs whose exact distances are taken at a time
_TOP = "0"
_POINTS = "vid string, v array<double>, m bigint, leaf string"


@dataclass
class PivotTree:
    """`points` (vid, v, m, leaf) and `nodes` (parent, node, v, low, high, n, m, leaf, parts).

    Points of a node with several parts are dealt to them by hash: its leaves are node-part.
    """

    points: DataFrame
    nodes: DataFrame
    levels: int
    root: str

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def _names(table: pa.Table) -> np.ndarray:
    """The vids as one array of bytes."""
    vids = table["vid"].combine_chunks()
    longest = pc.max(pc.binary_length(vids)).as_py() if len(vids) else None
    if not longest:
        return np.zeros(len(vids), "S1")
    if pc.any(pc.not_equal(pc.binary_length(vids), pc.utf8_length(vids))).as_py():  # padding counts characters
        return np.array(vids.cast(pa.binary()).to_pylist())
    padded = pc.utf8_rpad(vids, width=longest, padding="\0").cast(pa.binary(longest))
    return np.frombuffer(padded.buffers()[1], f"S{longest}", len(vids), padded.offset * longest)


def _parts(rows: DataFrame, on: str, visit_rows: int) -> DataFrame:
    """(on, _parts): how many groups of about `visit_rows` rows the rows of a key make."""
    return rows.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / visit_rows).alias("_parts"))


def _dealt(rows: DataFrame, parts: DataFrame, on: str) -> DataFrame:
    """Rows with their group `_part` within the key; `parts` has one small row per node or leaf."""
    part = F.pmod(F.xxhash64("vid", F.lit(3)), F.col("_parts")).alias("_part")
    return rows.join(F.broadcast(parts), on).select(*rows.columns, part)


def _nearest_child(left: pa.Table, right: pa.Table) -> pa.Table:
    kept = left.drop_columns(["node", "_part"])
    names = right["child"].to_pylist()
    if not left.num_rows or not names:
        return kept.slice(0, 0).append_column("child", pa.array([], pa.string())).append_column("dist", pa.array([], pa.float64()))
    order = np.argsort(names)  # the same pivot wins a tie in every part
    x, pivots = _matrix(left, "v"), _matrix(right, "p")[order]
    cell = _distances(x, pivots).argmin(1)
    exact = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
    return kept.append_column("child", pa.array([names[order[c]] for c in cell], pa.string())).append_column("dist", pa.array(exact))


def _assigned(points: DataFrame, pivots: DataFrame, visit_rows: int = VISIT_ROWS) -> DataFrame:
    """The points with the nearest pivot (node, child, p) of their node, as `child` and `dist`."""
    parts = _parts(points, "node", visit_rows)
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part")
    copied = pivots.join(F.broadcast(parts), "node").select("node", "child", "p", each)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema if f.name != "node")
    dealt = _dealt(points, parts, "node")
    return dealt.groupBy("node", "_part").cogroup(copied.groupBy("node", "_part")).applyInArrow(
        _nearest_child, f"{kinds}, child string, dist double"
    )


def _pivots(open_: DataFrame, sizes: DataFrame, level: int, block_rows: int) -> DataFrame:
    """About as many points of each open node as it needs children, chosen by hash: (node, child, p)."""
    wanted = F.least(F.lit(FANOUT), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / block_rows)))
    place = F.pmod(F.xxhash64("vid", F.lit(level)), F.lit(1 << 40))
    at = open_.join(F.broadcast(sizes.select("node", "n")), "node").withColumn("c", F.struct(place.alias("h"), "vid", "v"))
    some = F.when(F.col("c.h") * F.col("n") < wanted * float(1 << 40), F.col("c"))
    chosen = at.groupBy("node").agg(F.min("c").alias("least"), F.collect_list(some).alias("some"))
    every = F.slice(F.array_sort(F.array_union(F.array("least"), "some")), 1, 2 * FANOUT)
    return chosen.select("node", F.posexplode(every).alias("i", "c")).select(
        "node", F.concat("node", F.lit("."), F.col("i").cast("string")).alias("child"), F.col("c.v").alias("p")
    )


def write_points(points: DataFrame, root: str) -> None:
    """Add points (vid, v, m, leaf) to the folders of their leaves."""
    points.repartition("leaf").sortWithinPartitions("leaf", "vid").write.mode("append").partitionBy("leaf").parquet(f"{root}/points")


def read_points(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_POINTS).parquet(f"{root}/points")


def load_index(spark: SparkSession, root: str) -> PivotTree:
    nodes = spark.read.parquet(f"{root}/nodes")
    levels = nodes.agg(F.max(F.size(F.split("node", r"\.")))).first()[0] - 1
    return PivotTree(read_points(spark, root), nodes, levels, root)


def build_index(points: DataFrame, root: str, block_rows: int = BLOCK_ROWS) -> PivotTree:
    """Index distinct vectors (vid, v) with multiplicity m as tables below `root`."""
    spark = points.sparkSession
    points = materialize(spark, points.select("vid", "v", F.col("m").cast("bigint").alias("m")), "points")
    n, m = points.agg(F.count(F.lit(1)), F.sum("m")).first()
    if n == 0:
        raise ValueError("no points to index")
    part = F.concat("node", F.lit("-"), F.pmod(F.xxhash64("vid", F.lit(1)), F.col("parts")).cast("string"))
    kinds = "parent string, node string, v array<double>, low double, high double, n bigint, m bigint, leaf boolean, parts bigint"
    top = spark.createDataFrame([("", _TOP, None, 0.0, float("inf"), n, m, n <= block_rows, 1)], kinds)
    top.write.parquet(f"{root}/nodes")
    if n <= block_rows:
        write_points(points.withColumn("leaf", F.lit(f"{_TOP}-0")), root)
        return load_index(spark, root)
    open_, sizes = points.withColumn("node", F.lit(_TOP)), top
    for level in range(1, DEEPEST + 1):
        pivots = materialize(spark, _pivots(open_, sizes, level, block_rows), "pivots")
        placed = materialize(spark, _assigned(open_, pivots).withColumnRenamed("child", "node"), "placed")
        sizes = placed.groupBy("node").agg(
            F.min("dist").alias("low"), F.max("dist").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("m").alias("m")
        ).withColumn("leaf", (F.col("n") <= block_rows) | F.lit(level == DEEPEST))
        sizes = sizes.withColumn("parts", F.when(F.col("leaf"), F.ceil(F.col("n") / block_rows)).otherwise(1))
        below = pivots.select(F.col("node").alias("parent"), F.col("child").alias("node"), F.col("p").alias("v"))
        sizes = materialize(spark, below.join(sizes, "node").select("parent", "node", "v", "low", "high", "n", "m", "leaf", "parts"), "nodes")
        sizes.write.mode("append").parquet(f"{root}/nodes")
        near = placed.select("vid", "v", "m", "node")
        ends = sizes.filter("leaf").select("node", "parts")
        write_points(near.join(F.broadcast(ends), "node").select("vid", "v", "m", part.alias("leaf")), root)
        sizes = sizes.filter("NOT leaf")
        if sizes.isEmpty():
            break
        open_ = near.join(F.broadcast(sizes.select("node")), "node")
    return load_index(spark, root)


def _routed(queries: DataFrame, tree: PivotTree) -> DataFrame:
    """Queries (vid, v) with the leaf their nearest pivots lead to."""
    spark = tree.spark
    now, done = queries.select("vid", "v").withColumn("node", F.lit(_TOP)), []
    ends = tree.nodes.filter("leaf").select("node", "parts")
    inner = tree.nodes.filter("NOT leaf").select("node")
    leaf = F.concat("node", F.lit("-"), F.pmod(F.xxhash64("vid", F.lit(1)), F.col("parts")).cast("string")).alias("leaf")
    if tree.levels == 0:
        return now.join(ends, "node").select("vid", "v", leaf)
    children = tree.nodes.select(F.col("parent").alias("node"), F.col("node").alias("child"), F.col("v").alias("p"))
    for _ in range(tree.levels):
        found = _assigned(now, children).withColumnRenamed("child", "node").drop("dist")
        found = materialize(spark, found, "routed")
        done.append(found.join(F.broadcast(ends), "node").select("vid", "v", leaf))
        now = found.join(F.broadcast(inner), "node")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if ":" in path.split("/")[0]:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class _Nearest:
    """The k nearest points so far of a group of queries, as flat arrays; equal distances go by name."""

    def __init__(self, vids: np.ndarray, x: np.ndarray, k: int):
        self.vids, self.x, self.k = vids, x, k
        self.square = (x * x).sum(1)
        self.slack = _SLACK * (1.0 + np.sqrt(self.square))
        self.limit = np.full(len(x), np.inf)  # nothing farther can be among the k nearest
        self.visits = np.zeros(len(x), np.int64)
        self.q, self.d = np.empty(0, np.int64), np.empty(0)
        self.o, self.m = np.empty(0, "S1"), np.empty(0, np.int64)

    def visit(self, rows: np.ndarray, names: np.ndarray, points: np.ndarray, copies: np.ndarray) -> None:
        """Let some queries look at all points of a leaf, which come in order of names."""
        self.visits[rows] += 1
        # |x - p|^2 = |x|^2 - 2 (x.p - |p|^2 / 2): one product tells what is near enough.
        half = (points * points).sum(1) * (0.5 - 5e-13)
        wide = np.column_stack([points, -half]).T
        for lo in range(0, len(rows), 512):
            q = rows[lo:lo + 512]
            near = np.column_stack([self.x[q], np.ones(len(q))]) @ wide
            at = np.minimum(np.searchsorted(names, self.vids[q]), len(names) - 1)
            same = np.flatnonzero(names[at] == self.vids[q])
            near[same, at[same]] = -np.inf
            bound = self.limit[q] ** 2
            free = np.flatnonzero(np.isinf(bound))
            if len(free) and self.k <= len(names):
                kth = -np.partition(-near[free], self.k - 1, axis=1)[:, self.k - 1]
                bound[free] = np.maximum(self.square[q[free]] - 2.0 * kth, 0.0)
            least = 0.5 * (self.square[q] * (1.0 - 1e-12) - bound * (1.0 + 1e-9))
            i, c = np.divmod(np.flatnonzero(near >= least[:, None]), len(names))
            found = np.isfinite(near[i, c])
            if found.any():
                self._add(q[i[found]], c[found], names, points, copies)

    def _add(self, q, c, names, points, copies) -> None:
        d = np.empty(len(q))
        for lo in range(0, len(q), _PAIRS):
            part = slice(lo, lo + _PAIRS)
            d[part] = np.sqrt(((points[c[part]] - self.x[q[part]]) ** 2).sum(1))
        hit = np.zeros(len(self.x), bool)
        hit[q] = True
        old = hit[self.q]
        q, d = np.concatenate([self.q[old], q]), np.concatenate([self.d[old], d])
        o, m = np.concatenate([self.o[old], names[c]]), np.concatenate([self.m[old], copies[c]])
        order = np.lexsort((o, d, q))
        q, d, o, m = q[order], d[order], o[order], m[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.k - 1
        self.limit[q[last]] = np.minimum(self.limit[q[last]], d[last])
        kept, rest = nth < self.k, ~old
        self.q, self.d = np.concatenate([self.q[rest], q[kept]]), np.concatenate([self.d[rest], d[kept]])
        self.o, self.m = np.concatenate([self.o[rest], o[kept]]), np.concatenate([self.m[rest], m[kept]])


def _reachable(best: _Nearest, nodes: pa.Table):
    """Leaves (name, queries, gaps) that may hold a point within the bounds of some queries."""
    below: dict[str, list[int]] = {}
    for i, parent in enumerate(nodes["parent"].to_pylist()):
        below.setdefault(parent, []).append(i)
    names, ends = nodes["node"].to_pylist(), nodes["leaf"].to_pylist()
    low, high, many, parts = (nodes[c].to_numpy() for c in ("low", "high", "n", "parts"))
    every = np.arange(len(best.x))
    left, out = [(_TOP, every, np.zeros(len(every)))], []
    while left:
        node, q, gap = left.pop()
        children = below.get(node)
        if not children:
            continue
        pivots = _matrix(nodes.take(children), "v")
        d, between = _distances(best.x[q], pivots), _distances(pivots, pivots)
        # A cell with more than k points bounds the answer by its farthest point. The query itself
        # may be among them, hence "more than".
        far = np.where(many[children] > best.k, d + high[children], np.inf).min(1) + best.slack[q]
        best.limit[q] = np.minimum(best.limit[q], far)
        near = np.maximum(np.maximum(d - high[children], low[children] - d), gap[:, None])
        own = d.argmin(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            side = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2.0 * between[own])
        near = np.fmax(near, np.where(np.isfinite(side), side, 0.0))
        open_ = near <= (best.limit + best.slack)[q][:, None]
        for j, child in enumerate(children):
            some = np.flatnonzero(open_[:, j])
            if not len(some):
                continue
            if ends[child]:
                out += [(f"{names[child]}-{part}", q[some], near[some, j]) for part in range(parts[child])]
            else:
                left.append((names[child], q[some], near[some, j]))
    return sorted(out, key=lambda x: (float(x[2].mean()), x[0]))


def _search(root: str, k: int):
    """Search for a group of queries (vid, v, leaf: their home) among the leaves below `root`."""

    def run(group: pa.Table) -> pa.Table:
        store, path = _open_store(root)

        def leaf(name: str):
            rows = pq.read_table(f"{path}/points/leaf={name}", filesystem=store, columns=["vid", "v", "m"], partitioning=None)
            names, points, copies = _names(rows), _matrix(rows, "v"), rows["m"].to_numpy()
            if (names[1:] >= names[:-1]).all():  # a leaf of one file is in order
                return names, points, copies
            order = np.argsort(names)
            return names[order], points[order], copies[order]

        vids = _names(group)
        best = _Nearest(vids, _matrix(group, "v"), k)
        homes = group["leaf"].combine_chunks().dictionary_encode()
        own = homes.indices.to_numpy()
        home = {name: i for i, name in enumerate(homes.dictionary.to_pylist())}
        for name, i in home.items():
            best.visit(np.flatnonzero(own == i), *leaf(name))
        kinds = ["parent", "node", "v", "low", "high", "n", "leaf", "parts"]
        for name, q, gap in _reachable(best, pq.read_table(f"{path}/nodes", filesystem=store, columns=kinds).sort_by("node")):
            open_ = q[(gap <= (best.limit + best.slack)[q]) & (own[q] != home.get(name, -1))]
            if len(open_):
                best.visit(open_, *leaf(name))
        return pa.table({
            "vid": pa.array(vids[best.q], pa.binary()).cast(pa.string()), "o": pa.array(best.o, pa.binary()).cast(pa.string()),
            "d": best.d, "m": best.m, "visits": best.visits[best.q],
        })

    return run


def _grouped(home: DataFrame, visit_rows: int) -> tuple[DataFrame, int]:
    """Queries with their group `_part`, about `visit_rows` of neighbouring leaves each, and the number of groups.

    The leaves are laid end to end in the order of their names, and the groups are cut out of that.
    """
    # narrow: a row per leaf
    before = Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    leaves = home.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_first") + F.pmod(F.xxhash64("vid", F.lit(3)), F.col("_n"))
    part = F.floor(place / visit_rows).alias("_part")
    total = home.count()
    return home.join(F.broadcast(leaves), "leaf").select(*home.columns, part), max(1, -(-total // visit_rows))


def knn_join(
    queries: DataFrame, tree: PivotTree, k: int, visit_rows: int = SEARCH_ROWS, stats: dict[str, int] | None = None
) -> DataFrame:
    """The k nearest points with another vid for each query (vid, v): rows (vid, o, d, m).

    Queries that know their home `leaf`, such as the tree's own points, are not sent down for it.
    `stats` receives the number of visits and of leaves.
    """
    home = (queries if "leaf" in queries.columns else _routed(queries, tree)).select("vid", "v", "leaf")
    grouped, groups = _grouped(home, visit_rows)
    # Partitions by the number of groups: merged by their size in bytes, they would be too few tasks.
    found = grouped.repartition(4 * groups, "_part").groupBy("_part").applyInArrow(
        _search(tree.root, k), "vid string, o string, d double, m bigint, visits bigint"
    )
    if stats is not None:
        found = materialize(tree.spark, found, "near")
        each = found.groupBy("vid").agg(F.max("visits").alias("visits"))
        stats.update(
            visits=each.agg(F.sum("visits")).first()[0], leaves=tree.nodes.filter("leaf").agg(F.sum("parts")).first()[0]
        )
    return found.drop("visits")


__all__ = ["BLOCK_ROWS", "PivotTree", "build_index", "knn_join", "load_index", "read_points", "write_points"]
