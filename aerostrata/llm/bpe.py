"""Byte-level BPE by a backtracking encoder, and decoding by an offset table.

One Aho-Corasick pass over a pre-token's bytes gives the longest vocabulary entry that starts at
each byte. The encoder takes the longest entry that may stand next to the previous token, falls back
to the entry's longest proper prefix, and steps back when no prefix fits; a bit per byte keeps it
from trying a place twice, so the time is linear. Two tokens may stand side by side when merging
their joined bytes gives the two back, which is read off the merges along the seam and kept in a
table. The result is what the merges give in rank order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# The pre-token pattern of the byte-level vocabulary, and the printable bytes that
# stand for themselves in its file (the others are numbered from 256 on).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

_KEPT_WORDS = 300_000    # pre-tokens whose ids a worker keeps
_KEPT_PAIRS = 2_000_000  # pairs whose answer a worker keeps
_NONE = -1


def byte_of_char() -> dict[str, int]:
    """The file's character for each byte."""
    table, extra = {chr(b): b for b in _PRINTABLE}, 256
    for b in range(256):
        if b not in _PRINTABLE:
            table[chr(extra)] = b
            extra += 1
    return table


class ByteBPE:
    """Encoder and decoder over a tokenizer file's vocabulary, merges and special tokens."""

    def __init__(self, spec: dict):
        to_byte = byte_of_char()
        model = spec["model"]
        self.text_of = {i: bytes(to_byte[c] for c in t) for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text_of |= {i: t.encode() for t, i in self.special.items()}
        size = max(self.text_of) + 1
        self.length = [len(self.text_of.get(i, b"")) for i in range(size)]
        self.born, self.left, self.right = [_NONE] * size, [_NONE] * size, [_NONE] * size
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = (model["vocab"][x] for x in (a, b, a + b))
            self.rank[i << 20 | j] = r
            if self.born[k] == _NONE and self.length[k] > 1:
                self.born[k], self.left[k], self.right[k] = r, i, j
        entries = {self.text_of[i].decode("latin-1"): i for t, i in model["vocab"].items() if t not in self.special}
        self.machine = ahocorasick.Automaton()
        for text, i in entries.items():
            self.machine.add_word(text, (i, len(text) - 1))
        self.machine.make_automaton()
        self.shorter = [_NONE] * size  # the longest entry that is a proper prefix
        for text, i in entries.items():
            self.shorter[i] = next((entries[p] for n in range(len(text) - 1, 0, -1) if (p := text[:n]) in entries), _NONE)
        self.pairs: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        flat = [self.text_of.get(i, b"") for i in range(size)]
        self.bytes = np.frombuffer(b"".join(flat), np.uint8)
        self.sizes = np.array(self.length, np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def _fit(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the seam of `a` and `b`: undo the latest merge beside it."""
        limit = len(self.rank)
        born, rank = self.born, self.rank
        while True:
            if rank.get(a << 20 | b, limit) < limit:
                return False
            if born[a] > born[b]:
                limit, a = born[a], self.right[a]
            elif born[b] != _NONE:
                limit, b = born[b] + 1, self.left[b]  # of two equal merges the left one comes first
            else:
                return True

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        n, text = len(word), word.decode("latin-1")
        longest = [_NONE] * n
        for end, (token, back) in self.machine.iter(text):
            longest[end - back] = token  # ends ascend, so the last match from a start is the longest
        length, shorter, pairs, fit = self.length, self.shorter, self.pairs, self._fit
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else _NONE
            while token != _NONE:
                end = at + length[token]
                if not dead[end]:
                    if last == _NONE:
                        break
                    key = last << 20 | token
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= _KEPT_PAIRS:
                            pairs.clear()
                        ok = pairs[key] = fit(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token == _NONE:
                if last == _NONE:
                    raise ValueError(f"the vocabulary cannot spell {word[:40]!r}")
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
            else:
                out.append(token)
                at = end
                token = longest[at] if at < n else _NONE
        return out

    def split(self, text: str) -> Iterator[tuple[str, int]]:
        """Pre-tokens (text, -1) and special tokens (text, id) in order."""
        if self.cut is None or not any(s in text for s in self.special):
            yield from ((p, _NONE) for p in self.pattern.findall(text))
            return
        for part in self.cut.split(text):
            if part in self.special:
                yield part, self.special[part]
            else:
                yield from ((p, _NONE) for p in self.pattern.findall(part))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, gathered through the offset table."""
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        shift = self.offsets[ids] - (np.cumsum(sizes) - sizes)
        return self.bytes[np.repeat(shift, sizes) + np.arange(total)].tobytes()


class _Worker:
    """A worker's encoder with the pre-tokens it has met, as slices of one id array."""

    def __init__(self, spec: str):
        self.bpe = ByteBPE(json.loads(spec))
        self.words = _Words(self.bpe)

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a text, and the same as decimals joined by commas."""
        words, bpe = self.words, self.bpe
        if len(words) > _KEPT_WORDS:
            words.clear()
        if any(s in text for s in bpe.special):
            found = [(str(i), (i,)) if i != _NONE else words[p] for p, i in bpe.split(text)]
        else:
            found = list(map(words.__getitem__, bpe.pattern.findall(text)))
        ids = [i for _, own in found for i in own]
        return np.array(ids, np.int64), ",".join([s for s, _ in found])


class _Words(dict):
    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[str, tuple[int, ...]]:
        ids = tuple(self.bpe.merge(word.encode()))
        found = ",".join(map(str, ids)), ids
        if len(word) <= 64:
            self[word] = found
        return found


def encoded(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: one row per row of `docs`.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    decoded text in UTF-8) and, with `with_ids`, the ids. A null or empty text has no tokens; a null
    doc_id stays null; repeated rows stay repeated; an empty table gives none; other columns are not
    read. `tokenizer` is the path of a byte-level BPE file; its content (a few MB) is broadcast, so
    executors need not have the file. One text is in memory at a time, besides its Arrow batch.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(spec.value)
        for b in batches:
            rows = []
            for text in b.column(1):
                ids, written = worker.encode(text.as_py() or "")
                # Ids of whole texts spell valid UTF-8; other ids would give replacement characters.
                plain = worker.bpe.decode(ids).decode("utf-8", "replace").encode()
                rows.append((
                    len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(plain).hexdigest(),
                    *([ids.astype(np.int32)] * with_ids),
                ))
            if not rows:
                continue
            columns = [pa.array(list(c)) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
