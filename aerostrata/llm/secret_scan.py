"""Secrets in texts: known forms, and strings that pass a battery of randomness tests.

Known forms are patterns. Every other long run of key characters is a candidate. Its encoding is
inferred from its characters (digits of base 16, 26, 32, 36, 52, 62 or 64), its symbols become numbers,
and three tests ask whether they could be drawn evenly and independently: chi-squared uniformity of
the alphabet, runs above and below the middle of the alphabet, and correlation of neighbours. A
candidate's p-value is the smallest of the three times three.

Random strings have even p-values, so high ones speak for a secret; but short ordinary strings reach
high ones too. How often is measured: the prose of all texts, its words run together, is cut into
decoys of the same lengths, which go through the same battery. For each class of letter case and each
class of length, candidates at or above a level are reported if decoys say that at most
`FALSE_SHARE` of them are ordinary; the level is the lowest for which this holds. Where lengths are too short to tell, no
level does.

One pass over the texts writes spans, candidates and counts of decoys; levels come from a table of at most
CLASSES x BINS counts, and the second pass reads the written candidates only.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aerostrata.llm.common import prepared, written

KINDS = ("assign", "access", "hex", "random")
SHORTEST = 20                      # candidates and decoys have this many characters at least
LENGTHS = (20, 24, 28, 32, 40, 48, 64)  # lower ends of the classes of length; decoys have these lengths
FALSE_SHARE = 0.05
BINS = 64                          # of p-values, for levels
_TOGETHER = 1 << 18                # characters that are tested in one go
CLASSES = 2 * len(LENGTHS)         # one or two letter cases, by length

# Fixed values of the query's contract: forms of secrets and the least length of what they find.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGNED, _ACCESS_LENGTH = 12, 18

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % SHORTEST)
_PROSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]+(?![A-Za-z0-9+/_=-])")  # words, not the letters of a key

# Alphabets from the narrowest to the widest; a string is in the first that holds all of it.
_ALPHABETS = [
    string.digits + "abcdef", string.digits + "ABCDEF", string.ascii_lowercase, string.ascii_uppercase,
    string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase,
    string.ascii_letters, string.digits + string.ascii_letters, string.ascii_letters + string.digits + "+/",
    string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits + "+/-_",
]
_PLACES = np.full((len(_ALPHABETS), 128), -1)
for _k, _letters in enumerate(_ALPHABETS):
    _PLACES[_k, [ord(c) for c in _letters]] = np.arange(len(_letters))
_SIZES = np.array([len(a) for a in _ALPHABETS])
_WITHIN = ((_PLACES >= 0).T.astype(np.int64) << np.arange(len(_ALPHABETS))).sum(axis=1)  # alphabets that hold a character
_LOWER, _UPPER, _DIGIT = (np.isin(np.arange(128), [ord(c) for c in s]) for s in (string.ascii_lowercase, string.ascii_uppercase, string.digits))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, sorted; kinds by their place in KINDS."""
    small = text.lower()
    named = any(w in small for w in ("passw", "secret", "token", "api"))  # spares most texts the slow pattern
    found = [(m.start(), 0, m.end()) for m in (_ASSIGN.finditer(text) if named else ()) if m.end(2) - m.start(2) >= _ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """Share of the normal distribution above z, to about 1e-7."""
    x = np.abs(z) / np.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    # A rational Chebyshev fit of the complementary error function.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    tail = 0.5 * t * np.exp(-x * x + np.polyval(fit[::-1], t))
    return np.where(z >= 0, tail, 1.0 - tail)


def _two_sided(z: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, 2.0 * _upper_tail(np.abs(z)))


def battery(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tests of equally long strings, one per row of ASCII `codes`.

    Returns the alphabet of each, its p-value, and its class of letter case: 0 one case, 1 both, -1 for
    strings without a letter, which are no candidates.
    """
    rows, n = codes.shape
    within = np.bitwise_and.reduce(_WITHIN[codes], axis=1)
    kind = np.log2(within & -within).astype(np.int64)
    size = _SIZES[kind]
    own = _PLACES[kind[:, None], codes]
    counts = np.bincount((own + 64 * np.arange(rows)[:, None]).ravel(), minlength=64 * rows).reshape(rows, 64)
    # Chi-squared, with the exact moments of n draws, by the cube root's normal approximation.
    chi = (counts.astype(float) ** 2).sum(axis=1) * size / n - n
    mean, variance = size - 1.0, 2.0 * (size - 1.0) * (n - 1.0) / n
    freedom, scale = 2 * mean ** 2 / variance, variance / (2 * mean)
    root = np.cbrt(chi / (scale * freedom))
    uniform = _upper_tail((root - 1 + 2 / (9 * freedom)) / np.sqrt(2 / (9 * freedom)))
    # Runs of symbols above and below the middle of the alphabet.
    high = own >= (size // 2)[:, None]
    above = high.sum(axis=1).astype(float)
    below = n - above
    runs = 1.0 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    expected = 2 * above * below / n + 1
    spread = np.sqrt(np.maximum((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    run = np.where(above * below > 0, _two_sided((runs - expected) / spread), 0.0)
    # Correlation of neighbouring symbols.
    off = own - own.mean(axis=1, keepdims=True)
    power = (off ** 2).sum(axis=1)
    serial = (off[:, 1:] * off[:, :-1]).sum(axis=1) / np.maximum(power, 1e-9)
    z = (serial + 1.0 / n) * np.sqrt(n)
    neighbours = np.where(power > 0, _two_sided(z), 0.0)
    p = np.minimum(1.0, 3 * np.minimum(np.minimum(uniform, run), neighbours))
    lower, upper, digit = (t[codes].any(axis=1) for t in (_LOWER, _UPPER, _DIGIT))
    case = np.where(lower & upper, 1, np.where(lower | upper, 0, -1))
    return kind, p, case


def _class(case: np.ndarray, n: int) -> np.ndarray:
    at = max(k for k, least in enumerate(LENGTHS) if n >= least)
    return np.where(case < 0, -1, case * len(LENGTHS) + at)


def _bin(p: np.ndarray) -> np.ndarray:
    return np.minimum((p * BINS).astype(np.int64), BINS - 1)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the runs of key characters that meet none of the spans `taken`."""
    out, at, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        i, j = m.span()
        while at < len(taken) and taken[at][0] < j:
            reach = max(reach, taken[at][2])
            at += 1
        if reach <= i:
            out.append((i, j))
    return out


def classed(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class (-1: no candidate) and bin of each string; strings of one length are tested together."""
    cls, at = np.full(len(strings), -1), np.zeros(len(strings), np.int64)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for lo in range(0, len(rows), max(1, _TOGETHER // n)):
            some = rows[lo:lo + max(1, _TOGETHER // n)]
            codes = np.frombuffer("".join(strings[k] for k in some).encode(), np.uint8).reshape(-1, n)
            _, p, case = battery(codes)
            cls[some], at[some] = _class(case, n), _bin(p)
    return cls, at


def decoys(texts: list[str]) -> np.ndarray:
    """Numbers of decoys by class and bin: each text's prose, run together and cut to LENGTHS in turn."""
    counts = np.zeros(CLASSES * BINS, np.int64)
    prose = [np.frombuffer("".join(w for w in _PROSE.findall(t) if len(w) < SHORTEST).encode(), np.uint8) for t in texts]
    turn, at = sum(LENGTHS), 0
    for n in LENGTHS:
        whole = [x[: len(x) // turn * turn].reshape(-1, turn)[:, at:at + n] for x in prose]
        rest = [x[None, lo:lo + n] for x in prose if (lo := len(x) // turn * turn + at) + n <= len(x)]
        rows = np.concatenate([np.zeros((0, n), np.uint8), *whole, *rest])
        for lo in range(0, len(rows), _TOGETHER // n):
            _, p, case = battery(rows[lo:lo + _TOGETHER // n])
            cls = _class(case, n)
            counts += np.bincount((cls * BINS + _bin(p))[cls >= 0], minlength=len(counts))
        at += n
    return counts


_CAND = "array<struct<start:long,stop:long,cls:int,bin:int>>"
_SCHEMA = f"doc_id long, n_assign long, n_access long, n_hex long, base string, candidates {_CAND}, decoys array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one for each batch with its counts of decoys."""
    item = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("cls", pa.int32()), ("bin", pa.int32())])
    kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(item), pa.list_(pa.int64())]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "candidates", "decoys"]
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        base = [base_spans(t) for t in texts]
        places = [candidates(t, known) for t, known in zip(texts, base)]
        cls, at = classed([t[i:j] for t, own in zip(texts, places) for i, j in own])
        rows, k = [], 0
        for doc_id, known, own in zip(b.column(0).to_pylist(), base, places):
            n = np.bincount([kind for _, kind, _ in known], minlength=3).tolist()
            found = [{"start": i, "stop": j, "cls": int(cls[k + m]), "bin": int(at[k + m])} for m, (i, j) in enumerate(own) if cls[k + m] >= 0]
            k += len(own)
            rows.append((doc_id, *n, joined(known), found, None))
        rows.append((None, 0, 0, 0, None, [], decoys(texts).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def levels(found: np.ndarray, ordinary: np.ndarray, share: float = FALSE_SHARE) -> np.ndarray:
    """The lowest bin of each class from which candidates count as random; BINS where none does.

    Both arguments are counts by class and bin. Of the candidates at or above a bin, as many are taken
    to be ordinary as all candidates of the class would give at the decoys' rate; one decoy more is
    counted than was seen, so a class without decoys reports nothing.
    """
    passed = ordinary[:, ::-1].cumsum(axis=1)[:, ::-1] + 1
    rate = passed / (ordinary.sum(axis=1, keepdims=True) + 1)
    reported = found[:, ::-1].cumsum(axis=1)[:, ::-1]
    ok = (rate * found.sum(axis=1, keepdims=True) <= share * reported) & (reported > 0)
    return np.where(ok.any(axis=1), ok.argmax(axis=1), BINS)


def scanned(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """Spans of secrets of every document: doc_id, n_assign, n_access, n_hex, base, random, base_sha256, spans.

    `base` holds the spans of the known forms and `spans` these and the random ones, as kind:start:end
    in code points, by start, then kind; `random` is their number. Random spans meet no known one. A
    null or empty text has none. A null doc_id stays null, repeated rows are scanned and counted
    alike, an empty table gives no rows; other columns are not read.
    """
    prepared(docs.sparkSession)
    table, _ = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _SCHEMA), "secret-spans")
    ordinary, found = np.zeros((2, CLASSES, BINS), np.int64)
    counted = table.filter("decoys IS NOT NULL").select(F.posexplode("decoys").alias("k", "n")).filter("n > 0").groupBy("k").agg(F.sum("n"))
    for k, n in counted.collect():  # at most CLASSES x BINS rows
        ordinary[divmod(k, BINS)] = n
    counted = table.select(F.explode("candidates").alias("c")).groupBy("c.cls", "c.bin").agg(F.count(F.lit(1)))
    for cls, at, n in counted.collect():  # as many at most
        found[cls, at] = n
    least = F.array(*[F.lit(int(x)) for x in levels(found, ordinary, share)])
    random = F.filter("candidates", lambda c: c["bin"] >= F.element_at(least, c["cls"] + 1))
    rows = table.filter("decoys IS NULL").withColumn("more", random)
    # Sorted by start, then kind: known spans as they were written, random ones after those of equal start.
    known = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("start"), F.array_position(F.lit(list(KINDS)), F.split_part(s, F.lit(":"), F.lit(1))).alias("kind"), s.alias("span")),
    )
    extra = F.transform("more", lambda c: F.struct(
        c["start"].alias("start"), F.lit(len(KINDS)).cast("long").alias("kind"),
        F.concat(F.lit(f"{KINDS[-1]}:"), c["start"].cast("string"), F.lit(":"), c["stop"].cast("string")).alias("span"),
    ))
    spans = F.array_join(F.transform(F.array_sort(F.concat(known, extra)), lambda s: s["span"]), ",")
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base", F.size("more").cast("long").alias("random"),
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"),
    )


__all__ = ["base_spans", "battery", "candidates", "classed", "decoys", "joined", "levels", "scanned"]
