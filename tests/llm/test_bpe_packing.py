import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerostrata.llm import bpe, packing
from aerostrata.llm.queries import tokenizer_path
from tests.llm import brute

PARTS = [
    "a", "B", " ", "  ", "\n", "é", "É", "中", "'s", "'LL", "1", "22", "<|endoftext|>", "<|startoftext|>", "!", "...", "Σ", "aaaa",
    "\xa0", "the", "ing", "\U0001F600", "\x1c", "\x85", "é", "İ", "ﬁ", "ß", "-", "_", "'", "ab" * 5,
]


def odd_texts(seed, n):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*made, "a" * 5000, " " * 3000, "ab" * 3000, "é" * 2000, "", "\n" * 77, "x" * 70000, brute.LONG_TEXT]


def test_bpe_equals_the_library(docs_of, corpus):
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*corpus, *enumerate(odd_texts(1, 400), 1000), (7, corpus[0][1])]
    docs = docs_of(rows).withColumn("n_tokens", F.lit("clash"))
    got = sorted(map(tuple, bpe.encoded(docs, path).collect()), key=repr)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), brute.digest(",".join(map(str, ids))), hashlib.sha256(plain.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encoded(docs_of([]), path).collect() == []


def test_bpe_ids_decode_to_the_text(docs_of):
    path = tokenizer_path("byte_bpe_50k.json")
    row = bpe.encoded(docs_of([(1, "naïve 中文 <|endoftext|> x")]), path, with_ids=True).first()
    with open(path, encoding="utf-8") as f:
        import json

        coder = bpe.ByteBPE(json.load(f))
    assert coder.decode(np.array(row["ids"])).decode() == "naïve 中文 <|endoftext|> x"


def test_bpe_vocabulary_that_cannot_spell_a_text():
    coder = bpe.ByteBPE({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "added_tokens": []})
    assert coder.merge(b"aab") == [0, 2]
    with pytest.raises(ValueError):
        coder.merge(b"abc")


def pieces(library, rows, size):
    found = Counter()
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), size):
            own = np.array(ids[p:p + size], "<u4")
            found[d, p // size, p, len(own), zlib.crc32(own.tobytes())] += 1
    return found


@pytest.mark.parametrize("size", [4096, 64])
def test_packing_places_every_piece(docs_of, corpus, size):
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [*corpus, *enumerate(odd_texts(2, 300), 1000), corpus[0], (None, "x")]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("block", "length", "rank_in_block", "base")})
    got = packing.packed(docs, path, size).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces(library, rows, size)
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= size
    assert len(bins) <= -(-sum(r.length for r in got) // size) + 1


def test_packing_an_empty_table(docs_of):
    assert packing.packed(docs_of([]), tokenizer_path("word_bpe_49k.json")).collect() == []


def test_fullest_combination_against_all_subsets():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        chosen = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(chosen) == max(sums) and all(k <= counts[n] for n, k in Counter(chosen).items())


def test_plan_uses_all_pieces_and_few_combinations():
    rng = random.Random(6)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(50_000))
    found = packing.plan(counts)
    used = Counter()
    for chosen, times in found:
        assert sum(chosen) <= 4096
        for n in chosen:
            used[n] += times
    assert used == counts
    assert sum(t for _, t in found) <= -(-sum(n * c for n, c in counts.items()) // 4096) + 2
    many = packing.plan({n: c * 1000 for n, c in counts.items()})
    assert len(many) < 34_000
