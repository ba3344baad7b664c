import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aerostrata.llm import hmm, quality
from tests.llm import brute


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def test_base_scores_and_counts(docs_of, corpus):
    rows = [*corpus, corpus[0], (9000, brute.LONG_TEXT), (9001, "never seen before words only here")]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("block", "words", "counts", "held", "score")})
    bags = [(d, [*brute.words(brute.lower(t)), ""]) for d, t in rows]
    counts = Counter(w for d, own in bags if not held(d) for w in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((
        d, held(d), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)
    ) for d, own in bags), key=repr)
    got = hmm.scored(docs, rounds=1).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.scored(docs_of([])).collect() == []


def brute_likelihood(classes, model):
    alpha = [math.log(p) for p in model.start]
    alpha = [a + math.log(model.emit[classes[0], k]) for k, a in enumerate(alpha)]
    for c in classes[1:]:
        alpha = [
            np.logaddexp.reduce([alpha[j] + math.log(model.move[j, k]) for j in range(len(alpha))]) + math.log(model.emit[c, k])
            for k in range(len(alpha))
        ]
    return np.logaddexp.reduce(alpha) / math.log(10)


def small_model(seed, states, classes):
    rng = np.random.default_rng(seed)

    def shares(*shape):
        x = rng.random(shape) + 0.05
        return x / x.sum(axis=-1, keepdims=True)

    return hmm.Model(shares(states), shares(states, states), shares(states, classes).T.copy(), np.ones(classes))


def test_forward_recursion_is_exact():
    model, rng = small_model(1, 3, 11), np.random.default_rng(2)
    sizes = np.array([1, 5, 0 + 2, 40, 5, 1])
    classes = rng.integers(0, 11, sizes.sum())
    got = hmm.log_likelihoods(classes, sizes, model)
    for i, (lo, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
        assert math.isclose(got[i], brute_likelihood(classes[lo:lo + n], model), rel_tol=1e-9)


def test_expected_counts_match_enumeration():
    from itertools import product

    model, rng = small_model(3, 2, 5), np.random.default_rng(4)
    sizes = np.array([4, 1, 3])
    classes = rng.integers(0, 5, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    emissions, moves, first, likelihood = np.zeros((5, 2)), np.zeros((2, 2)), np.zeros(2), 0.0
    for lo, n in zip(starts, sizes):
        own, weights = classes[lo:lo + n], {}
        for path in product(range(2), repeat=int(n)):
            p = model.start[path[0]]
            for t in range(n):
                p *= model.emit[own[t], path[t]] * (model.move[path[t - 1], path[t]] if t else 1)
            weights[path] = p
        total = sum(weights.values())
        likelihood += math.log10(total)
        for path, p in weights.items():
            first[path[0]] += p / total
            for t in range(n):
                emissions[own[t], path[t]] += p / total
                if t:
                    moves[path[t - 1], path[t]] += p / total
    got = hmm.expected_counts(classes, starts, sizes, model)
    assert np.allclose(got[0], emissions) and np.allclose(got[1], moves) and np.allclose(got[2], first) and math.isclose(got[3], likelihood)


def test_states_are_carried_over_the_cuts_of_long_texts(monkeypatch):
    model, rng = small_model(5, 4, 9), np.random.default_rng(6)
    sizes = np.array([700, 3, 129, 128, 1, 260])
    classes = rng.integers(0, 9, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    whole = hmm.expected_counts(classes, starts, sizes, model)
    assert math.isclose(whole[3], hmm.log_likelihoods(classes, sizes, model).sum(), rel_tol=1e-9)
    for segment, together in ((128, 1 << 18), (7, 1 << 18), (16, 64)):
        monkeypatch.setattr(hmm, "LONG", 2)
        monkeypatch.setattr(hmm, "SEGMENT", segment)
        monkeypatch.setattr(hmm, "_TOGETHER", together)
        cut = hmm.expected_counts(classes, starts, sizes, model)
        assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(whole, cut))


def test_totals_of_words_in_many_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(hmm, "_BLOCK_TOKENS", 20)
    monkeypatch.setattr(hmm, "_SALTED", 3)
    docs = docs_of([(i, f"common word{i % 7}") for i in range(300)])
    rows = hmm.scored(docs, states=2, rounds=1).collect()
    train = [i for i in range(300) if not held(i)]
    counts = Counter(w for i in train for w in ("common", f"word{i % 7}", ""))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ("common", f"word{r.doc_id % 7}", ""))
        assert r.train_tokens == n and math.isclose(r.base_score, want, abs_tol=1e-9)


def two_kinds(n):
    rng = random.Random(11)
    kinds = [[f"{p}{i}" for i in range(150)] for p in "xy"]
    return [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60))) for i in range(n)]


def test_training_beats_the_unigram_on_held_out_texts_and_grows(docs_of):
    docs = docs_of(two_kinds(300))
    once = {r.doc_id: r for r in hmm.scored(docs, states=4, rounds=1).collect()}
    rows = hmm.scored(docs, states=4, rounds=4, gain=-math.inf).collect()
    out = [r for r in rows if r.held_out]
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.2
    train = [r for r in rows if not r.held_out]
    assert sum(r.score for r in train) >= sum(once[r.doc_id].score for r in train) - 1e-6


def test_word_probabilities_sum_to_one_in_each_class():
    mass = np.array([3 + 0.5 * 3, 0.5])  # counts 2 and 1, and no word at all
    assert math.isclose((2.5 + 1.5 + 0.5) / mass[0], 1.0) and math.isclose(0.5 / mass[1], 1.0)
    assert np.allclose(hmm._emission(np.random.default_rng(0).random((2, 3)), mass).sum(axis=0), 1)


# --- quality -----------------------------------------------------------------------------------

def labelled_corpus(seed=12, n=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        poor = i % 6 == 0
        if poor:
            words = [w.upper() + "!!" for w in words] if i % 12 else [words[0]] * len(words)
        docs.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not poor), 0))
    return docs, labels


def test_poor_documents_go_and_good_ones_stay(spark, docs_of):
    docs, labels = labelled_corpus()
    rows = [*docs, (None, docs[1][1]), docs[1], (7777, None), (7778, ""), (7779, brute.LONG_TEXT)]
    table = docs_of(rows).withColumns({c: F.lit(1) for c in ("kept", "bucket", "key", "good")})
    known = spark.createDataFrame([*labels, (None, 0, 0), (3, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(table, known)
    got = quality.resampled(table, model).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows)
    assert [i for i, _ in docs if kept[i] == (i % 6 == 0)] == []
    left = quality.filtered(table, model)
    assert left.columns == table.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.kept)


def test_weights_match_plain_counts(spark, docs_of):
    docs, labels = labelled_corpus(13, 120)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs_of(docs), known)
    target = {i for i, good, inside in quality.labelled(known) if good and inside}
    raw, good = Counter(), Counter()
    for d, t in docs:
        raw.update(quality.features(t).tolist())
        if d in target:
            good.update(quality.features(t).tolist())
    share = sum(good.values()) / sum(raw.values())
    for r in quality.scored(docs_of(docs), model).collect():
        own = quality.features(docs[r.doc_id][1]).tolist()
        weight = sum(math.log((good[b] + 1) / (raw[b] * share + 1)) for b in own) * quality.SCALE / (quality.SCALE + len(own))
        assert r.n_features == len(own) and math.isclose(r.log_weight, weight, abs_tol=1e-9)
        assert math.isclose(r.gumbel_key, weight + quality.gumbel(r.doc_id, docs[r.doc_id][1]), abs_tol=1e-9)


def test_the_k_largest_keys_are_drawn(spark, docs_of):
    docs, labels = labelled_corpus(14, 150)
    model = quality.fit(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    keys = {r.doc_id: r.gumbel_key for r in quality.scored(docs_of(docs), model).collect()}
    for k in (0, 1, 37, 149, 150, 500):
        drawn = {r.doc_id for r in quality.resampled(docs_of(docs), model, k).collect() if r.kept}
        assert drawn == set(sorted(keys, key=keys.get, reverse=True)[:k])


def test_kth_largest_with_ties_and_near_numbers(spark):
    rng = random.Random(15)
    for values in ([1.0] * 50, [float(i % 7) for i in range(100)], [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0)] * 5, [rng.gauss(0, 1e6) for _ in range(300)], [-1e300, 1e300, 0.0]):
        keys = spark.createDataFrame([(float(v),) for v in values], "key double")
        for k in (1, len(values) // 2, len(values)):
            assert quality.kth_largest(keys, k) == sorted(values, reverse=True)[max(k, 1) - 1]


def test_without_labels_nothing_goes(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    assert all(r.kept for r in quality.resampled(docs, model).collect())
    assert quality.resampled(docs_of([]), quality.fit(docs_of([]), none)).collect() == []


def test_good_documents_are_estimated_by_adjusted_counting():
    model = quality.Model(np.zeros(quality.BUCKETS), 0.0, 0.9, 0.2)
    assert model.good(1000, 550) == 500  # 0.9 x 500 + 0.2 x 500 lie above the cut
    assert model.good(1000, 950) == 1000 and model.good(1000, 100) == 0 and model.good(0, 0) == 0
    assert quality.Model(model.ratio, 0.0, 0.3, 0.3).good(10, 4) == 10
    assert quality.Model(model.ratio, -np.inf).good(10, 10) == 10


def test_the_filter_draws_k_documents_too(spark, docs_of):
    docs, labels = labelled_corpus(16, 150)
    model = quality.fit(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for k in (0, 40, 150):
        drawn = {r.doc_id for r in quality.resampled(docs_of(docs), model, k).collect() if r.kept}
        assert len(drawn) == k and {r.doc_id for r in quality.filtered(docs_of(docs), model, k).collect()} == drawn
