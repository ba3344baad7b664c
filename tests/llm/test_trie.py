import hashlib
import random
import re
import zlib
from collections import defaultdict

from aerostrata.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            convs[conv].append((turn, role or "", text or ""))
    for own in convs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(r[1:] for r in convs.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * words
    return [
        (own[0], len(node), members[node[:-1]][0] if node else None, len(own), children.get(node, 0), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in own if len(rebuilt[c]) == len(node)).encode()).hexdigest())
        for node, own in members.items()
    ]


def nodes(spark, rows, extra=False):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    if extra:
        table = table.selectExpr("*", *[f"7 AS {c}" for c in ("conv", "a", "b", "depth", "words", "n", "h", "base", "len")])
    return [tuple(r) for r in trie.shared_trie(table).select(COLUMNS).collect()]


def conversations(seed, sizes, vocabulary=3):
    rng = random.Random(seed)
    rows = []
    for c, n in sizes:
        for t in range(n):
            text = " ".join(rng.choice("xyz") for _ in range(rng.randrange(vocabulary)))
            rows.append((c, rng.choice([t, t, t, None]) if vocabulary > 2 else t, rng.choice(["user", "assistant", None, ""]), text or None))
    return rows


def test_trie_matches_brute_force(spark):
    rng = random.Random(5)
    rows = conversations(6, [(c, rng.randrange(1, 9)) for c in range(90)])
    rows += conversations(7, [(c, rng.randrange(1, 5)) for c in range(200, 260, 3)], 2)
    rows += rows[:30] + [(None, 1, "user", "lost"), (-25, 0, "user", "a\x0bb\x1cc"), (990, 1, "user", "w " * 50_000)]
    assert sorted(nodes(spark, rows, True), key=repr) == sorted(brute(rows), key=repr)


def test_copies_deep_conversations_and_no_turns(spark):
    deep = [(0, t, "user", f"{t}") for t in range(70)]
    rows = [*deep, *[(c, t, r, x) for c in (20, 40, 60) for _, t, r, x in deep[: 33 + c // 20]]]
    rows += [(c, 0, "user", "hello") for c in range(100, 400)]  # many are left without turns or with one
    rows += [(c, t, "user", "same") for c in range(500, 600) for t in range(4)]
    assert sorted(nodes(spark, rows), key=repr) == sorted(brute(rows), key=repr)


def test_no_conversation_has_no_node(spark):
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "user", "x")]) == []


def test_chunks_of_ids_give_one_digest(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(trie, "CHUNK", 3)
    ids = [(1, 1, c) for c in range(10)] + [(1, 2, 5)] + [(2, 0, c) for c in range(3)]
    kinds = [pa.int64()] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*ids[lo:lo + 4]), kinds)], ["a", "b", "conv"]) for lo in range(0, len(ids), 4)]
    got = [tuple(r.values()) for b in trie._digests(trie._chunks(iter(batches))) for r in b.to_pylist()]
    want = [(a, b, hashlib.sha256(",".join(str(c) for x, y, c in ids if (x, y) == (a, b)).encode()).hexdigest()) for a, b in ((1, 1), (1, 2), (2, 0))]
    assert got == want
