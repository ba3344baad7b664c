import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerostrata.llm import pivots, search
from tests.llm import brute


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_matches_scoring_everything(docs_of, corpus, monkeypatch, k):
    monkeypatch.setattr(search, "SHARD_TOKENS", 1500)  # several shards a task
    rows = [*corpus, corpus[5], (None, corpus[6][1]), (7000, brute.LONG_TEXT)]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("shard", "terms", "score", "rank", "query_id", "th")})
    queries = [(i, t) for i, (_, t) in enumerate(corpus[:25])] + [(90, ""), (91, None), (92, "unknown-word"), (0, corpus[0][1]), (93, brute.LONG_TEXT)]
    asked = docs.sparkSession.createDataFrame(queries, "query_id long, text string")
    got = {tuple(r) for r in search.search(docs, asked, k).collect()}
    want = brute.bm25(rows, queries, k)
    # Repeated rows tie with themselves: the same (rank, doc_id, score) rows come out.
    assert {(q, r, d) for q, r, d, _ in got} == {(q, r, d) for q, r, d, _ in want}
    assert all(any(abs(s - t) < 2e-6 for a, b, c, t in want if (a, b, c) == (q, r, d)) for q, r, d, s in got)


def test_search_prunes_only_what_cannot_win():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(200)], k=rng.randrange(5, 80))) for _ in range(700)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(texts)], ["doc_id", "text"])
    row = next(search._shards(iter([batch]))).to_pylist()[0]
    shard = search.Shard(row, sum(len(t.split()) for t in texts) / 700)
    for _ in range(60):
        words = rng.sample(vocabulary, rng.randrange(1, 40))
        weights = np.array([rng.random() * 5 for _ in words])
        places, scores = shard.top(words, weights, 10)
        every = [(i, shard._scores(np.array([i]), *_known(shard, words), weights)[0]) for i in range(700)]
        best = sorted((s for _, s in every if s > 0), reverse=True)[:10]
        assert np.allclose(sorted(scores, reverse=True)[:10], best)


def _known(shard, words):
    found = [(shard.number[w], p) for p, w in enumerate(words) if w in shard.number]
    return np.array(found, np.int64).reshape(-1, 2).T


def test_search_empty_tables(docs_of, corpus):
    docs = docs_of(corpus[:5])
    none = docs.sparkSession.createDataFrame([], "query_id long, text string")
    assert search.search(docs, none).collect() == []
    assert search.search(docs_of([]), search.query_set(docs_of([(50, "a b")]))).collect() == []


def groups(rows, cosine=0.93):
    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    sets, links = brute.Sets(len(rows)), [0] * len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v) else None for _, v, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][2] is not None and rows[i][2] == rows[j][2]
            if same and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                sets.join(i, j)
    out = []
    for i, (d, _, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if sets.find(j) == sets.find(i) and rows[j][0] is not None]
        least = min(own, default=None)
        out.append((d, links[i], least, d == least))
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, node int, key int, n int"


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        centre = rng.normal(size=16)
        for j in range(rng.integers(1, 6)):
            v = centre + rng.normal(size=16) * rng.choice([0.05, 0.1, 0.3])
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(i % 3) if i % 7 else None))
    near = rng.normal(size=16)
    for j in range(80):  # a large group
        rows.append((len(rows), [float(x) for x in (near + rng.normal(size=16) * 0.05).astype(np.float32)], 1))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[1][1], 1), (1001, rows[1][1], 1), (None, rows[70][1], rows[70][2])]
    rows += [(1100, None, 1), (1101, [], 1), (1102, [0.0] * 16, 1), (1103, [float("nan")] * 16, 1), (1104, [float("inf")] + [0.0] * 15, 1)]
    rows += [(1105, [None] + [1.0] * 15, 1), (1106, [1.0, 2.0], 1), (1107, [2.0, 4.0], 1), (1108, [1.0, 2.0], None), (1109, [3e38] * 16, 2), (1110, [1e-38] * 16, 2)]
    want = sorted(groups(rows), key=repr)
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    for chunk in (512, 16):
        monkeypatch.setattr(pivots, "CHUNK", chunk)
        got = sorted(map(tuple, pivots.near_groups(table).collect()), key=repr)
        found, true = sum(r[1] for r in got), sum(r[1] for r in want)
        assert 0.97 * true <= found <= true
        assert sum(a == b for a, b in zip(got, want)) >= 0.95 * len(want)
        assert [r for r in got if r[0] is None or r[0] >= 1100] == [r for r in want if r[0] is None or r[0] >= 1100]


def test_vectors_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(31)
    # The table has no near pairs of one label: plant some, at cosines from just above the limit upward.
    for i, (_, vector, label) in enumerate(rows[:600:2]):
        own = np.array(vector, float) / np.linalg.norm(vector)
        away = rng.normal(size=len(own))
        away -= (away @ own) * own
        cosine = rng.uniform(0.932, 0.99)
        near = cosine * own + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
        rows.append((1_000_000 + i, near.astype(np.float32).tolist(), label))
    table = spark.createDataFrame(rows, table.select("vec_id", "embedding", "label").schema)
    values = np.array([r[1] for r in rows], float)
    values /= np.linalg.norm(values, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    linked = (values @ values.T >= 0.93) & (labels[:, None] == labels[None, :])
    true = linked.sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in pivots.near_groups(table).collect()}
    found = np.array([got[r[0]] for r in rows])
    assert true.sum() >= 600
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()


def test_vectors_empty_table(spark):
    assert pivots.near_groups(spark.createDataFrame([], SCHEMA)).collect() == []
