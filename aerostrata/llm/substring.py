"""Substring dedup: repeated word windows found through difference-cover anchors.

A window of `window` words is a repeat if its word sequence also starts earlier. Hashing every window
is avoided: anchors of window - m + 1 words are hashed only where the word position modulo m lies in a
difference cover of m. Whatever the two places of a repeated window, some offset below m puts both on
cover positions, so both hold an anchor that occurs twice. Only windows that hold such an anchor are
extended to their full length and compared by a 96-bit fingerprint of their words.

Documents are written as blocks of bounded size. What crosses the network is packed by block and by
range of hash values: one entry per block for an anchor or window however often the block repeats it,
so a passage that a third of all documents share costs no more than a rare one, and a range holds a
bounded number of entries because the number of ranges follows the number of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from aerostrata.llm.common import drop, fresh_id, prepared, written

WINDOW = 20
_BLOCK_BYTES = 3 << 19     # of text; a longer document is a block by itself
_RANGE_ENTRIES = 1 << 19   # entries of a hash range, about
# Perfect difference sets, each with its modulus.
_COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """Modulus and cover for a window: the largest that leaves anchors a third of the window long."""
    m = max(m for m in _COVERS if m <= max(1, 2 * window // 3))
    return m, _COVERS[m]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _GOLDEN
    return x ^ (x >> np.uint64(29))


def _joined(hashes: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of the `width` word hashes from each place in `at`."""
    factors = np.random.default_rng(seed).integers(1, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out += hashes[at + k] * factors[k]
    return _mixed(out)


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as blocks: block, words at most, an Arrow table of the rows."""

    def row(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
        body = pa.array([_pack(pa.Table.from_batches(held))], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([fresh_id()]), pa.array([size // 2 + 1]), body], ["block", "most", "body"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        done = 0
        while done < b.num_rows:
            base = int(sizes[done - 1]) if done else 0
            n = max(1, int(np.searchsorted(sizes, base + _BLOCK_BYTES - size, side="right")) - done)
            held.append(b.slice(done, n))
            size += int(sizes[done + n - 1]) - base
            done += n
            if size >= _BLOCK_BYTES or done < b.num_rows:
                yield row(held, size)
                held, size = [], 0
    if held:
        yield row(held, size)


class _Block:
    """A block's documents in order of (doc_id, text), equal rows once, as one run of word hashes."""

    def __init__(self, body: bytes):
        self.table = pa.ipc.open_stream(body).read_all()
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in self.table["text"].combine_chunks()]
        ids = self.table["doc_id"].to_pylist()
        ties = [xxhash.xxh3_64_intdigest(t) >> 1 for t in texts]
        order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, ties[i]))
        self.place = [0] * len(texts)  # of each row, its document
        self.docs: list[list[bytes]] = []
        keys: list[tuple[bool, int, int]] = []
        for i in order:
            key = ids[i] is None, ids[i] or 0, ties[i]
            if not keys or key != keys[-1]:
                keys.append(key)
                self.docs.append(texts[i].split())
            self.place[i] = len(keys) - 1
        # A null doc_id comes after all others.
        self.null = np.array([k[0] for k in keys], np.int64)
        self.ids = np.array([k[1] for k in keys], np.int64)
        self.ties = np.array([k[2] for k in keys], np.int64)
        self.sizes = np.array([len(d) for d in self.docs], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        digest = xxhash.xxh3_64_intdigest
        self.hashes = np.fromiter((digest(w) for d in self.docs for w in d), np.uint64, int(self.sizes.sum()))
        self.doc_of = np.repeat(np.arange(len(keys)), self.sizes)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes in order; of each anchor its place and its hash's number; counts."""
        m, chosen = cover(window)
        width = window - m + 1
        in_doc = np.arange(len(self.hashes)) - self.starts[self.doc_of]
        at = np.flatnonzero(np.isin(in_doc % m, chosen) & (in_doc + width <= self.sizes[self.doc_of]))
        distinct, number, counts = np.unique(_joined(self.hashes, at, width, 1), return_inverse=True, return_counts=True)
        return distinct, at, number, counts

    def candidates(self, window: int, anchored: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the anchors at `anchored`."""
        m, _ = cover(window)
        delta = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(delta, np.maximum(anchored - m + 1, self.starts[self.doc_of[anchored]]), 1)
        np.add.at(delta, anchored + 1, -1)
        at = np.flatnonzero(np.cumsum(delta)[:-1] > 0)
        return at[at + window <= self.ends[self.doc_of[at]]]


def _cut(values: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the 2^bits equal ranges in sorted 64-bit `values`."""
    if not bits:
        return np.array([0, len(values)])
    borders = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.r_[0, np.searchsorted(values, borders), len(values)]


def _anchor_rows(window: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1)):
                distinct, *_ = _Block(body.as_py()).anchors(window)
                cut = _cut(distinct, bits)
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array(np.full(len(full), block)),
                     pa.array([distinct[cut[r]:cut[r + 1]].tobytes() for r in full], pa.binary())],
                    ["part", "block", "data"],
                )

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of each block's distinct anchors in a range, a bit for those that another block has too."""
    own = [np.frombuffer(d.as_buffer(), np.uint64) for c in table["data"].chunks for d in c]
    every = np.concatenate(own)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(every), bool)
    twice[order] = np.r_[False, same] | np.r_[same, False]
    bits = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum([len(x) for x in own])[:-1])]
    return pa.table({"block": table["block"], "part": table["part"], "data": pa.array(bits, pa.binary())})


def _window_rows(window: int, anchor_bits: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, (block, body) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                held = _Block(body.as_py())
                distinct, at, which, counts = held.anchors(window)
                twice, cut = counts > 1, _cut(distinct, anchor_bits)
                for mark in b.column(2)[number].as_py() or []:
                    lo, hi = cut[mark["part"]], cut[mark["part"] + 1]
                    twice[lo:hi] |= np.unpackbits(np.frombuffer(mark["data"], np.uint8), count=hi - lo).astype(bool)
                starts = held.candidates(window, at[twice[which]])
                if not len(starts):
                    continue
                print_, more = _joined(held.hashes, starts, window, 2), _joined(held.hashes, starts, window, 3).astype(np.uint32)
                order = np.lexsort((starts, more, print_))
                print_, more, starts = print_[order], more[order], starts[order]
                first = np.r_[True, (print_[1:] != print_[:-1]) | (more[1:] != more[:-1])]
                local = starts[~first].astype(np.uint32).tobytes()
                print_, more, starts = print_[first], more[first], starts[first].astype(np.uint32)
                cut, rows = _cut(print_, bits), []
                for r in np.flatnonzero(np.diff(cut)):
                    part = slice(cut[r], cut[r + 1])
                    docs, doc = np.unique(held.doc_of[starts[part]], return_inverse=True)
                    keys = np.stack([held.null[docs], held.ids[docs], held.ties[docs]])
                    rows.append((
                        int(r), block, print_[part].tobytes() + more[part].tobytes(), starts[part].tobytes(),
                        doc.astype(np.uint32).tobytes(), keys.tobytes(), local,
                    ))
                    local = b""
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                    ["part", "block", "prints", "starts", "doc", "keys", "local"],
                )

    return run


def _late(table: pa.Table) -> pa.Table:
    """Of each block's windows in a range, the starts of those that another document has earlier."""
    prints, more, keys = [], [], []
    for p, d, k in zip(table["prints"].to_pylist(), table["doc"].to_pylist(), table["keys"].to_pylist()):
        n = len(d) // 4
        prints.append(np.frombuffer(p, np.uint64, n))
        more.append(np.frombuffer(p, np.uint32, n, 8 * n))
        keys.append(np.frombuffer(k, np.int64).reshape(3, -1)[:, np.frombuffer(d, np.uint32)])
    cuts = np.cumsum([len(p) for p in prints])[:-1]
    prints, more, keys = np.concatenate(prints), np.concatenate(more), np.concatenate(keys, axis=1)
    order = np.lexsort((keys[2], keys[1], keys[0], more, prints))
    ranked, also, key = prints[order], more[order], keys[:, order]
    first = np.r_[True, (ranked[1:] != ranked[:-1]) | (also[1:] != also[:-1])]
    least = np.flatnonzero(first)[np.cumsum(first) - 1]
    late = np.zeros(len(prints), bool)
    late[order] = (key != key[:, least]).any(axis=0)
    starts = [
        np.frombuffer(s, np.uint32)[own].tobytes() + local
        for s, own, local in zip(table["starts"].to_pylist(), np.split(late, cuts), table["local"].to_pylist())
    ]
    return pa.table({"block": table["block"], "data": pa.array(starts, pa.binary())})


def _rows_out(window: int, build: Callable[[pa.Table, list, list], pa.Table]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, body in enumerate(b.column(1)):
                held = _Block(body.as_py())
                gone = [np.frombuffer(x, np.uint32) for x in b.column(2)[number].as_py() or []]
                starts = np.concatenate(gone) if gone else np.zeros(0, np.uint32)
                delta = np.zeros(len(held.hashes) + 1, np.int64)
                delta[starts] += 1
                np.add.at(delta, starts.astype(np.int64) + window, -1)
                kept = np.cumsum(delta)[:-1] == 0
                left = []
                for words, lo, hi in zip(held.docs, held.starts, held.ends):
                    own = kept[lo:hi]
                    left.append(words if own.all() else [w for w, k in zip(words, own.tolist()) if k])
                rows = [(len(held.docs[p]), left[p]) for p in held.place]
                yield from build(held.table, [n for n, _ in rows], [w for _, w in rows]).to_batches()

    return run


def _deduplicated(docs: DataFrame, window: int, build: Callable, schema: StructType | str) -> DataFrame:
    spark = prepared(docs.sparkSession)
    raw = "block long, most long, body binary"
    blocks, _ = written(docs.mapInArrow(_blocks, raw), "blocks")
    most = blocks.agg(F.sum("most")).first()[0] or 0
    m, chosen = cover(window)
    # `most` counts words of one byte; the texts' words are rather six bytes long.
    bits = max(0, (most // 3 // _RANGE_ENTRIES).bit_length())
    anchor_bits = max(0, (most // 3 * len(chosen) // m // _RANGE_ENTRIES).bit_length())
    sent = blocks.select("block", "body").mapInArrow(_anchor_rows(window, anchor_bits), "part long, block long, data binary")
    marks = sent.groupBy("part").applyInArrow(_repeated, "block long, part long, data binary")
    marked, path = written(
        marks.groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias("marks")), "anchors"
    )
    open_ = blocks.join(marked.hint("shuffle_hash"), "block", "left").select("block", "body", "marks")
    windows = open_.mapInArrow(
        _window_rows(window, anchor_bits, bits),
        "part long, block long, prints binary, starts binary, doc binary, keys binary, local binary",
    )
    late = windows.groupBy("part").applyInArrow(_late, "block long, data binary")
    gone, _ = written(late.groupBy("block").agg(F.collect_list("data").alias("gone")), "windows")
    drop(spark, path)
    closed = blocks.join(gone.hint("shuffle_hash"), "block", "left").select("block", "body", "gone")
    return closed.mapInArrow(_rows_out(window, build), schema)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts and digest of what stays of every document: doc_id, n_words, n_removed, kept_sha256.

    Words lie between ASCII white space. Every word covered by a window that also starts earlier (in
    a smaller doc_id, or further ahead in the same document) is removed; windows are judged on the
    input. A null or empty text has no words. A null doc_id comes after all others. Rows of one
    doc_id with different texts are documents in the order of a hash of the text; rows equal in both
    are one document and give equal rows. An empty table gives none; other columns are not read.
    """

    def build(table: pa.Table, sizes: list[int], left: list[list[bytes]]) -> pa.Table:
        return pa.table({
            "doc_id": table["doc_id"], "n_words": pa.array(sizes, pa.int64()),
            "n_removed": pa.array([n - len(w) for n, w in zip(sizes, left)], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in left], pa.string()),
        })

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _deduplicated(own, window, build, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs`, all columns, with the words that `deduplicated` keeps as text.

    A text that loses nothing stays as it is, white space included. n_chars, where there is such a
    column of integers, is counted anew for the others.
    """
    fields = {f.name: f.dataType for f in docs.schema.fields}

    def build(table: pa.Table, sizes: list[int], left: list[list[bytes]]) -> pa.Table:
        texts = [t if n == len(w) else b" ".join(w).decode() for t, n, w in zip(table["text"].to_pylist(), sizes, left)]
        changed = pa.array(texts, pa.string())
        table = table.set_column(table.schema.get_field_index("text"), "text", changed)
        at = table.schema.get_field_index("n_chars")
        if at >= 0 and pa.types.is_integer(table.schema.field(at).type):
            counts = [c if n == len(w) else len(t) for c, t, n, w in zip(table["n_chars"].to_pylist(), texts, sizes, left)]
            table = table.set_column(at, "n_chars", pa.array(counts, table.schema.field(at).type))
        return table

    if not isinstance(fields["doc_id"], LongType):
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return _deduplicated(docs, window, build, schema)
