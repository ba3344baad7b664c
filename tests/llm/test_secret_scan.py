import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerostrata.llm import secret_scan
from tests.llm import brute

ALNUM = string.ascii_letters + string.digits


def prose(rng, words):
    vocabulary = "the of and to in that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    return " ".join(rng.choice(vocabulary).title() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(words))


def known(text):
    """Spans of the contract's patterns, by plain re with a test of each match."""
    text, out = text or "", []
    forms = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    for k, (kind, form, ok) in enumerate(forms):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(form, text, re.A) if ok(m)]
    return [s for _, _, s in sorted(out)]


def planted(seed=21, n=150):
    rng = random.Random(seed)
    key = lambda letters, size: "".join(rng.choice(letters) for _ in range(size))
    rows, secrets = [], {}
    for i in range(n):
        text = prose(rng, rng.randrange(50, 200))
        if i % 5 == 0:
            secrets[i] = key(ALNUM, rng.choice([32, 40, 64]))
            text = f"{text} é {secrets[i]} {prose(rng, 20)}"
        elif i % 5 == 1:
            text += f' token = "{key("0123456789abcdef", 40)}" or Api_Key: {key(ALNUM, 20)}'
        elif i % 5 == 2:
            text += " https://example.org/the/way/people/find/water/and/words/called/little " + "InternationalBusinessMeetingOfTheNations"
        elif i % 5 == 3:
            text += " AKIA" + key(string.ascii_uppercase + string.digits, 16) + " " + "=" * 50 + "a" * 60 + " antidisestablishmentarianism"
        rows.append((i, text))
    return rows, secrets


def test_known_forms_and_random_strings(docs_of):
    rows, secrets = planted()
    odd = [(None, rows[0][1]), rows[1], (500, None), (501, ""), (502, brute.LONG_TEXT), (503, "ſecret=abcdefghijklmnop passwd: 'short' TOKEN='token=abcdefghijklm'")]
    docs = docs_of(rows + odd).withColumns({c: F.lit(1) for c in ("base", "candidates", "decoys", "spans", "k")})
    got = secret_scan.scanned(docs).collect()
    assert len(got) == len(rows) + len(odd)
    texts = dict(rows + odd)
    for r in got:
        want = known(texts[r.doc_id])
        assert r.base == ",".join(want) and r.base_sha256 == hashlib.sha256(r.base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random")] == want
        more = [texts[r.doc_id][int(i):int(j)] for k, i, j in (s.split(":") for s in spans) if k == "random"]
        assert r.random == len(more)
        if r.doc_id is not None and r.doc_id < 500:
            assert set(more) <= {secrets.get(r.doc_id)}, more
    hit = {r.doc_id for r in got if r.random and r.doc_id in secrets}
    assert len(hit) >= 0.85 * len(secrets)
    assert secret_scan.scanned(docs_of([])).collect() == []


def test_battery_is_even_on_random_strings_and_near_zero_on_prose():
    rng = np.random.default_rng(22)
    letters = np.frombuffer(ALNUM.encode(), np.uint8)
    for n in (24, 40, 64):
        _, p, case = secret_scan.battery(letters[rng.integers(0, 62, (20_000, n))])
        assert (case >= 0).all() and 0.85 < (p > 0.1).mean() <= 1 and 0.35 < (p > 0.5).mean() < 0.75
    text = prose(random.Random(23), 20_000).replace(" ", "").encode()
    rows = np.frombuffer(text[: len(text) // 64 * 64], np.uint8).reshape(-1, 64)
    assert (secret_scan.battery(rows)[1] > 0.05).mean() < 0.05


@pytest.mark.parametrize("letters,size", [("0123456789abcdef", 16), (string.ascii_lowercase, 26), (string.ascii_uppercase + "234567", 32), (ALNUM, 62), (ALNUM + "+/", 64), (ALNUM + "-_", 64)])
def test_encodings_are_inferred(letters, size):
    codes = np.frombuffer((letters * 2).encode(), np.uint8)[None]
    assert secret_scan._SIZES[secret_scan.battery(codes)[0]] == size


def test_levels_keep_the_false_share():
    rng = np.random.default_rng(24)
    bins = secret_scan.BINS
    ordinary = np.bincount(np.minimum(rng.exponential(2, 100_000).astype(int), bins - 1), minlength=bins)
    plain = np.bincount(np.minimum(rng.exponential(2, 1000).astype(int), bins - 1), minlength=bins)
    secrets = np.bincount(rng.integers(0, bins, 100), minlength=bins)
    at = secret_scan.levels((plain + secrets)[None], ordinary[None])[0]
    assert plain[at:].sum() <= 0.1 * (plain + secrets)[at:].sum() and secrets[at:].sum() > 60
    assert secret_scan.levels(plain[None], ordinary[None])[0] == bins or plain[secret_scan.levels(plain[None], ordinary[None])[0]:].sum() <= 3
    assert secret_scan.levels(secrets[None], np.zeros((1, bins), int))[0] == bins


def test_decoys_do_not_depend_on_batches():
    rows, _ = planted(25, 20)
    texts = [t for _, t in rows]
    assert np.array_equal(secret_scan.decoys(texts), sum(secret_scan.decoys([t]) for t in texts))
