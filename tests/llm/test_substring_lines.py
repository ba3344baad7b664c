import pytest
from pyspark.sql import functions as F

from aerostrata.llm import lines, substring
from tests.llm import brute


def unique(corpus):
    """One row for each doc_id."""
    return list({d: (d, t) for d, t in corpus}.values())


def test_substring_matches_brute_force(docs_of, corpus):
    rows = [*unique(corpus), (5000, brute.LONG_TEXT), (5001, "x " + brute.LONG_TEXT)]
    got = {r.doc_id: tuple(r)[1:] for r in substring.deduplicated(docs_of(rows).withColumn("block", F.lit(1))).collect()}
    for (d, t), kept in zip(rows, brute.windows_kept(rows)):
        n = len(brute.words(t))
        assert got[d] == (n, n - len(kept), brute.digest(" ".join(kept))), d


@pytest.mark.parametrize("window", [1, 2, 3, 8, 33, 50])
def test_substring_other_windows(docs_of, corpus, window):
    rows = unique(corpus)
    got = {r.doc_id: r.kept_sha256 for r in substring.deduplicated(docs_of(rows), window).collect()}
    assert got == {d: brute.digest(" ".join(k)) for (d, _), k in zip(rows, brute.windows_kept(rows, window))}


def test_covers_cover_every_distance():
    for m, chosen in substring._COVERS.items():
        assert {(a - b) % m for a in chosen for b in chosen} == set(range(m))


def test_substring_over_many_small_blocks_and_ranges(docs_of, corpus, monkeypatch):
    rows = unique(corpus)
    want = {r.doc_id: tuple(r) for r in substring.deduplicated(docs_of(rows)).collect()}
    monkeypatch.setattr(substring, "_RANGE_ENTRIES", 64)
    split = {r.doc_id: tuple(r) for r in substring.deduplicated(docs_of(rows).repartition(17)).collect()}
    assert split == want


def test_substring_equal_rows_are_one_document(docs_of, corpus):
    rows = [(1, corpus[0][1] + " x" * 40), (1, corpus[0][1] + " x" * 40), (2, corpus[0][1])]
    once = {r.doc_id: tuple(r) for r in substring.deduplicated(docs_of([rows[0], rows[2]])).collect()}
    got = sorted(map(tuple, substring.deduplicated(docs_of(rows)).collect()))
    assert got == sorted([once[1], once[1], once[2]])


def test_substring_keeps_columns(docs_of, corpus):
    rows = unique(corpus)
    docs = docs_of(rows).withColumn("extra", F.array(F.lit("a"), F.lit(None)))
    out = substring.without_repeats(docs)
    assert out.dtypes == docs.dtypes
    for (d, t), kept in zip(rows, brute.windows_kept(rows)):
        row = [r for r in out.filter(F.col("doc_id").eqNullSafe(F.lit(d))).collect()] if d in (None, 90, 91) else []
        for r in row:
            same = len(kept) == len(brute.words(t))
            assert r["text"] == (t if same else " ".join(kept)) and r["extra"] == ["a", None]
            assert r["n_chars"] == (None if t is None else len(r["text"]))
    assert substring.without_repeats(docs_of([])).collect() == []


def test_lines_match_brute_force(docs_of, corpus):
    rows = [*unique(corpus), (5000, brute.LONG_TEXT), (5001, brute.LONG_TEXT + " more"), (5002, "Copy 12 of this long line here\nCopy 7 of this long line here")]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("pos", "th", "k1", "line", "gone", "_id")})
    got = {r.doc_id: tuple(r)[1:] for r in lines.deduplicated(docs).collect()}
    texts = brute.lines_kept(rows)
    for (d, t), kept in zip(rows, texts):
        n = 0 if t is None else len(t.split("\n"))
        assert got[d][0] == n and got[d][2] == brute.digest(kept or ""), d
    out = {r.doc_id: r for r in lines.without_repeats(docs).collect()}
    assert {d: r.text for d, r in out.items()} == {d: k for (d, _), k in zip(rows, texts)}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.values())
    assert lines.without_repeats(docs).columns == docs.columns


def test_lines_empty_table_and_repeated_rows(docs_of):
    assert lines.deduplicated(docs_of([])).collect() == []
    line = "one two three four five six"
    got = sorted(map(tuple, lines.deduplicated(docs_of([(1, line), (1, line), (2, line), (None, line)])).collect()), key=repr)
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (2, 1), (None, 1)]


def test_lines_of_a_large_group_of_near_copies(docs_of):
    base = [f"token{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = list(base)
        own[i % 60] = f"other{'abcdefghij'[i % 10]}{'abcdefghijkl'[i // 10]}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.n_removed for r in lines.deduplicated(docs_of(rows)).collect()}
    kept = brute.lines_kept(rows)
    assert got == {d: int(k == "") for (d, _), k in zip(rows, kept)}
    assert sum(got.values()) > 20


def test_words_are_told_apart_when_lines_are_compared(docs_of):
    """Two words whose short hashes once met, and one other: a similarity of 4 in 6."""
    rows = [(1, "wordbbjf alpha beta gamma delta one"), (2, "worddcaa alpha beta gamma delta two"),
            (3, "wordbbjf alpha beta gamma delta six")]
    got = {r.doc_id: r.n_removed for r in lines.deduplicated(docs_of(rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 1}
