"""SimHash near-duplicates: fingerprints, a byte-position inverted index, groups.

A 64-bit fingerprint is eight bytes at eight positions. Fingerprints that differ in at most three
bits differ in at most three bytes, so they share at least five positional bytes. One posting list
per (position, byte) would hold a 256th of all fingerprints; the index therefore keeps lists of
positional byte *quadruples*: the 14 quadruples of positions whose numbers XOR to zero are such that
any three positions lie in one of them, hence any two fingerprints with five shared bytes share one
whole quadruple. Within a list the shared positional bytes of a pair are tallied, pairs with five or
more are kept, and their bits are compared. Lists that are still long are dealt on by a fifth
shared byte, which every wanted pair has; such a list cannot hold more than 2^24 fingerprints.

Equal fingerprints are one node, and a list reports only the links of a spanning forest, so neither
copies nor near copies make rows that grow with the square of their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from aerostrata.llm.common import components, drop, link, whole_groups, written

SEED = 42
LONG_LIST = 4096      # longer lists are dealt on by a fifth byte
_NEAR = 48            # lists up to this length compare all their pairs at once
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_QUADRUPLES = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a text, as an unsigned number."""
    if not text:
        return 0
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[i:j], SEED) for i, j in zip((ends - sizes).tolist(), ends[width - 1:].tolist())],
            np.uint64,
        )
    bytes_ = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(bytes_[:, k], minlength=256) @ _BITS for k in range(8)])
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, `th` (a hash of the text) and `fp`, the fingerprint's 64 bits as a long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"]
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"
    ).mapInArrow(run, "doc_id long, th long, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def _similar(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Pairs with enough shared positional bytes whose bits then differ in `most` places or fewer."""
    diff = np.ascontiguousarray(x ^ y)
    shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= 8 - most
    ok[ok] = np.bitwise_count(diff[ok]) <= most
    return ok


def _by_flips(values: np.ndarray, free: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a long list whose members differ only in the bits of `free`: look flipped bits up."""
    bits = [np.uint64(1 << k) for k in range(64) if free >> k & 1]
    order = np.argsort(values)
    ranked = values[order]
    for k in range(1, most + 1):
        for chosen in combinations(bits, k):
            other = values ^ np.bitwise_or.reduce(np.array(chosen))
            at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
            hit = ranked[at] == other
            yield np.flatnonzero(hit), order[at[hit]]


def _by_rows(values: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a list: from each member reached, to the members not reached yet."""
    rest = np.arange(len(values))
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            i = stack.pop()
            near = _similar(values[rest], np.full(len(rest), values[i]), most)
            if near.any():
                yield np.full(int(near.sum()), i), rest[near]
                stack.extend(rest[near])
                rest = rest[~near]


def _list_links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["mask", "key"]):
            mask = table["mask"].to_numpy()
            key = table["key"].to_numpy()
            fp = np.ascontiguousarray(table["fp"].to_numpy()).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[starts, len(fp)])
            parent = np.arange(len(fp))
            group = np.repeat(np.arange(len(starts)), sizes)
            small = sizes <= _NEAR
            rows = np.flatnonzero(small[group])
            for lag in range(1, int(sizes[small].max(initial=1))):
                i = rows[rows + lag < len(fp)]
                i = i[group[i] == group[i + lag]]
                i = i[_similar(fp[i], fp[i + lag], most)]
                link(parent, i, i + lag)
            for g in np.flatnonzero(~small):
                lo, hi = starts[g], starts[g] + sizes[g]
                free = ~int(mask[lo]) & (1 << 64) - 1
                if sizes[g] > LONG_LIST and free.bit_count() <= 24:
                    found = _by_flips(fp[lo:hi], free, most)
                else:
                    found = _by_rows(fp[lo:hi], most)
                own = np.arange(hi - lo)
                for i, j in found:
                    link(own, i, j)
                parent[lo:hi] = lo + own
            linked = np.flatnonzero(parent != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[linked].view(np.int64)), pa.array(fp[parent[linked]].view(np.int64))], ["a", "b"]
            )

    return run


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fp` differing in `most` bits or fewer."""
    if not 1 <= most <= 3:
        raise ValueError("the index of byte quadruples serves 1 to 3 differing bits")
    masks = F.array(*[F.lit(_mask(q)) for q in _QUADRUPLES])
    postings = prints.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.expr("fp & mask"))
    lists = postings.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    fifth = F.array(*[
        F.struct(F.lit(_mask(q)).alias("mask"), F.array(*[F.lit(_mask((*q, p))) for p in range(8) if p not in q]).alias("on"))
        for q in _QUADRUPLES
    ])
    dealt = postings.join(lists, ["mask", "key"]).withColumn(
        "mask",
        F.explode(F.when(F.col("n") <= LONG_LIST, F.array("mask")).otherwise(
            F.filter(fifth, lambda x: x["mask"] == F.col("mask"))[0]["on"]
        )),
    ).select("fp", "mask", F.expr("fp & mask").alias("key"))
    return dealt.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(
        _list_links(most), "a long, b long"
    )


def _grouped(docs: DataFrame, width: int, most: int) -> DataFrame:
    prints, _ = written(fingerprints(docs, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found, path = written(links(nodes.select("fp"), most), "near")
    member, _ = components(found)
    drop(docs.sparkSession, path)
    rooted = nodes.join(member, nodes["fp"] == member["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_groups(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id that is reachable over links. A null or empty text, or one
    without words, has fingerprint zero and links like any other. A null doc_id stays null and
    belongs to its text's component, whose id is null only if it holds no other. Repeated rows stay
    repeated, an empty table gives none. Other columns are not read.
    """
    return _grouped(docs, width, most).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """One row of `docs` of each near-duplicate group, with all columns.

    It is that of the smallest doc_id, a null one last, then of the smallest hash of the text; of rows
    equal in both, any one.
    """
    rows = _grouped(docs, width, most).groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("copies"))
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "copies")).alias("s"))
    stays = stays.select(F.col("s.doc_id").alias("_near_doc"), F.col("s.th").alias("_near_hash"), F.col("s.copies").alias("_near_copies"))
    stays, _ = written(stays, "near-kept")
    stays = stays.hint("shuffle_hash")
    own = docs["doc_id"].cast("long").eqNullSafe(stays["_near_doc"]) & (F.xxhash64(docs["text"]) == stays["_near_hash"])
    kept = docs.join(stays, own)
    # An aggregate with map-side partials, so that a row repeated very often is not one task's.
    once = kept.filter("_near_copies > 1").dropDuplicates(["_near_doc", "_near_hash"])
    return kept.filter("_near_copies = 1").unionAll(once).select(*[F.col(f"`{c}`") for c in docs.columns])
