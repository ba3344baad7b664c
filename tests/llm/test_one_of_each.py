from aerostrata.llm import simhash


def test_one_row_of_each_group_without_or_with_repeated_ids(docs_of):
    a = "alpha beta gamma delta epsilon zeta eta theta"
    b = "one two three four five six seven eight nine"
    c = "red green blue black white brown pink grey"
    rows = [(None, a), (None, a), (5, b), (5, b), (5, b), (7, b), (None, c), (9, c), (11, None), (11, "")]
    docs = docs_of(rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
    assert got == sorted([(None, a), (5, b), (9, c), (11, "")], key=repr)
