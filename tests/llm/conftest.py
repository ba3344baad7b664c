import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with near copies, shared passages, repeated lines, odd and missing texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéñü") for _ in range(rng.randrange(2, 8))) for _ in range(300)]

    def line(n):
        return " ".join(rng.choice(vocabulary).title() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(n)) + "."

    def text(n):
        return "\n".join(line(rng.randrange(3, 40)) for _ in range(n))

    passage, footer = line(60), line(12)
    docs = [(i, text(rng.randrange(1, 8))) for i in range(60)]
    for i in range(60, 75):  # near copies with one word changed
        words = docs[i - 60][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words)))
    docs += [(i, docs[3][1]) for i in range(75, 80)]
    docs += [(i, text(2) + "\n" + passage + "\n" + footer) for i in range(80, 90)]
    docs += [(90, line(25) + " " + passage + " " + passage), (91, None), (92, ""), (93, " \t\n "), (94, "short"), (95, "\x0b\x0c a \x1c b   c")]
    docs += [(96, "same word " * 200), (None, text(3)), (97, footer.upper() + "\n" + footer.replace(".", " !"))]
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with the usual further columns, from (doc_id, text)."""

    def make(rows):
        full = [(d, t, "en", "src", None if t is None else len(t)) for d, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    return make
