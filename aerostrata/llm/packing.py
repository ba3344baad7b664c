"""Packing token sequences by minimum bin slack.

Documents become token ids plus an end id; only longer ones are cut, into pieces of the sequence
size. Packing needs no more than the number of pieces of each length, a table of at most `size`
entries however many pieces there are. For each bin a bitset holds every fill that the lengths still
available can sum to, its highest bit is the fullest feasible combination, and walking the bitsets
back names its lengths. The same combination is taken as often as the counts allow, so the number of
distinct combinations depends on the number of lengths, not of pieces. Pieces then find their bin by
their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aerostrata.llm.common import fresh_id, prepared, written

SIZE = 4096
END_ID = 1
_KEPT_WORDS = 600_000
_CLOSING = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'  # ASCII signs but the apostrophe, which begins tokens like 's
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, rank_in_block long"


class _Numbers(dict):
    """Numbers for words in the order they are met; `new` lists those to be learned."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordIds:
    """Token ids of whole texts through a table of the words met so far.

    For a tokenizer that drops white space and never lets a token cross it, the ids of a text are
    those of its parts between ASCII white space. Each distinct part is tokenized once. Parts are
    mostly letters and closing signs, which the tokenizer keeps apart and takes in lower case, so
    such a part is put together from its letters and its signs. Many letter groups are tokenized as
    one text; the tokens that end a word tell them apart.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark shares out the cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = Tokenizer.from_str(spec)  # for letter groups that need no normalizing
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.known: dict[bytes, list[int]] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _tokenize(self, parts: list[bytes]) -> None:
        """Ids of new letter groups and other parts into `known`."""
        known, plain, other = self.known, [], []
        for p in parts:
            text = p.decode()
            ready = text.isalpha() and (text.isascii() or text == text.lower() and unicodedata.is_normalized("NFC", text))
            (plain if ready else other).append(p)
        groups = [plain[i:i + 64] for i in range(0, len(plain), 64)]
        found = self.model.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found):
            ids = e.ids
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):
                start = 0
                for p, end in zip(group, ends.tolist()):
                    known[p] = ids[start:end]
                    start = end
            else:
                other += group
        found = self.tokenizer.encode_batch_fast([p.decode() for p in other], add_special_tokens=False)
        for p, e in zip(other, found):
            known[p] = e.ids

    def learn(self, words: list[bytes]) -> None:
        known, split = self.known, []
        for w in words:
            low = w.lower()
            letters = low.rstrip(_CLOSING)
            if letters and len(letters) < len(low) and letters.decode().lower().isalpha():
                split.append((letters, low[len(letters):]))
            else:
                split.append((low, b""))
        new = dict.fromkeys(p for pair in split for p in pair if p and p not in known)
        self._tokenize(list(new))
        known[b""] = []
        ids = [known[a] + known[b] if b else known[a] for a, b in split]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(sizes.sum()), len(self.index) - len(words)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.count[n:n + len(words)] = sizes
        self.first[n:n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > _KEPT_WORDS:
            self.clear()
        found: list[np.ndarray] = []
        for text in texts:
            if any(s in text for s in self.special):  # a special token may touch a word
                found.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                words = text.encode().split()
                found.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        self.learn(self.index.new)
        self.index.new = []
        return [at if at.dtype == np.uint32 else self._gather(at) for at in found]

    def _gather(self, at: np.ndarray) -> np.ndarray:
        sizes = self.count[at]
        shift = self.first[at] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


def tokenized(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, with a block and a rank among the block's pieces of that length."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, block, seen = WordIds(spec.value), fresh_id(), Counter()
        for b in batches:
            rows = []
            for doc_id, found in zip(b.column(0).to_pylist(), worker.encode([t or "" for t in b.column(1).to_pylist()])):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), size)):
                    own = ids[start:start + size]
                    rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), block, seen[len(own)]))
                    seen[len(own)] += 1
            if rows:
                names = [c.split()[0] for c in _PIECES.split(", ")]
                kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in _PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths (descending `lengths`, at most `counts` of each) whose sum comes closest to `room`."""
    reach, steps, mask = 1, [], (2 << room) - 1
    for n in lengths:
        if n > room or not counts[n]:
            continue
        steps.append((n, reach))
        left, k = min(counts[n], room // n), 1
        while left:  # so many copies of n, doubling
            k = min(k, left)
            reach |= (reach << (k * n)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        while not before >> fill & 1:
            chosen.append(n)
            fill -= n
    return chosen[::-1]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how many bins take each, until no piece is left.

    A bin starts with the largest length left and is filled by the fullest combination of the others.
    Every combination is repeated while its lengths last, after which one of them can no longer occur
    as often in a bin; so there are at most sum(size / length) of them, about 34,000 for 4,096.
    """
    counts = {n: c for n, c in counts.items() if c}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        chosen = [top, *fullest(counts, lengths, size - top)]
        counts[top] += 1
        need = Counter(chosen)
        times = min(counts[n] // k for n, k in need.items())
        for n, k in need.items():
            counts[n] -= k * times
        out.append((chosen, times))
        lengths = [n for n in lengths if counts[n]]
    return out


def _slots(found: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, offset) in order: where the pieces of a length go."""
    used: Counter = Counter()
    rows, first_bin = [], 0
    for chosen, times in found:
        offset = 0
        for n in chosen:
            rows.append((n, used[n], first_bin, offset))
            used[n] += times
            offset += n
        first_bin += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 4)


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Place every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. A null doc_id stays null, repeated rows are documents
    of their own, an empty table gives no rows, other columns are not read. Pieces of equal length
    are interchangeable, so which of them shares a bin with which is open; the number of sequences is
    not. `tokenizer` is the path of a tokenizer file that drops white space; its content is broadcast.
    """
    spark = prepared(docs.sparkSession)
    pieces, _ = written(tokenized(docs, tokenizer, size, end_id), "pieces")
    per_block = pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in per_block.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    slots = spark.sparkContext.broadcast(_slots(plan(counts, size)))
    placed = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        step = int(table[:, 1].max(initial=0)) + 1
        order = table[:, 0] * step + table[:, 1]
        for b in batches:
            rank, length = b.column(5).to_numpy(), b.column(3).to_numpy()
            at = np.searchsorted(order, length * step + np.minimum(rank, step - 1), side="right") - 1
            bins = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(bins), pa.array(table[at, 3])], [c.split()[0] for c in placed.split(", ")]
            )

    ranked = pieces.join(starts, ["block", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank_in_block")).alias("rank")
    )
    return ranked.mapInArrow(place, placed)
