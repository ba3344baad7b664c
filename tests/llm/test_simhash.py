import random

import numpy as np
from pyspark.sql import functions as F

from aerostrata.llm import simhash
from aerostrata.llm.common import components, link
from tests.llm import brute


def test_groups_match_brute_force(docs_of, corpus):
    got = sorted(map(tuple, simhash.near_groups(docs_of(corpus)).collect()), key=repr)
    assert got == sorted(brute.near_groups(corpus), key=repr)


def test_repeated_rows_null_ids_clashing_columns(docs_of, corpus):
    rows = [*corpus[:20], *corpus[:3], (None, corpus[0][1]), (5000, brute.LONG_TEXT), (4999, brute.LONG_TEXT)]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("fp", "th", "key", "mask", "component_id", "_id")})
    got = sorted(map(tuple, simhash.near_groups(docs).collect()), key=repr)
    assert got == sorted(brute.near_groups(rows), key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    # One row of each group, of its smallest doc_id.
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted({c for _, _, c in brute.near_groups(rows)}, key=repr)


def test_empty_table(docs_of):
    assert simhash.near_groups(docs_of([])).collect() == []
    assert simhash.one_of_each(docs_of([])).collect() == []


def _linked(values, pairs):
    parent = np.arange(len(values))
    for a, b in pairs:
        link(parent, np.asarray(a), np.asarray(b))
    return parent.tolist()


def test_long_lists_by_rows_and_by_flips_agree():
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = set()
    while len(values) < 400:
        v = base
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(24)
        values.add(v)
    values = np.array(sorted(values), np.uint64)
    want = brute.Sets(len(values))
    for i in range(len(values)):
        for j in range(i):
            if int(values[i] ^ values[j]).bit_count() <= 3:
                want.join(i, j)
    expected = [want.find(i) for i in range(len(values))]
    assert _linked(values, simhash._by_rows(values, 3)) == expected
    assert _linked(values, simhash._by_flips(values, 0xFFFFFF, 3)) == expected


def test_a_long_list_is_dealt_on_by_a_fifth_byte(spark, monkeypatch):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(50)}
    for v in list(values):
        for _ in range(20):
            w = v
            for _ in range(rng.randrange(1, 5)):
                w ^= 1 << rng.randrange(64)
            values.add(w)
    values = sorted(values)
    want = brute.Sets(len(values))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                want.join(i, j)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    expected = {frozenset(s for k, s in enumerate(signed) if want.find(k) == g) for g in {want.find(i) for i in range(len(values))}}
    for limit in (4096, 4):
        monkeypatch.setattr(simhash, "LONG_LIST", limit)
        found, _ = components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")))
        root = dict(map(tuple, found.collect()))
        groups = {}
        for s in signed:
            groups.setdefault(root.get(s, s), set()).add(s)
        assert {frozenset(g) for g in groups.values()} == expected


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7)]
    found, _ = components(spark.createDataFrame(edges, "a long, b long"))
    root = dict(map(tuple, found.collect()))
    assert root == {**{i: 0 for i in range(1, 41)}, **{j: 100 for j in range(101, 140)}}
