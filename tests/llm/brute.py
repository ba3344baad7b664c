"""Plain versions of the operators over Python lists, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex
import xxhash

LONG_TEXT = " ".join(f"w{i % 977}" for i in range(30_000))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def simhash(tokens: list[str], hashes=None) -> int:
    found = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def fingerprint(text: str | None) -> int:
    own = words(lower(text))
    if not own:
        return 0
    return simhash([" ".join(own[i:i + 3]) for i in range(max(1, len(own) - 2))])


def near_groups(docs: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component) of every (doc_id, text)."""
    prints = [fingerprint(t) for _, t in docs]
    sets = Sets(len(docs))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                sets.join(i, j)
    least: dict[int, list] = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[sets.find(i)].append(d)
    named = {r: min((d for d in own if d is not None), default=None) for r, own in least.items()}
    return [(d, f"{prints[i]:016x}", named[sets.find(i)]) for i, (d, _) in enumerate(docs)]


def one_of_each(docs: list[tuple]) -> list[tuple]:
    """The (doc_id, text) of each near-duplicate group that stays; doc_ids are different or null once."""
    return [(d, t) for (d, t), (_, _, c) in zip(docs, near_groups(docs)) if d == c]


def windows_kept(docs: list[tuple], window: int = 20) -> list[list[str]]:
    """Words that stay of each (doc_id, text); doc_ids are different."""
    first: dict[tuple, tuple] = {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    rank = {i: r for r, i in enumerate(order)}
    for i in order:
        own = words(docs[i][1])
        for s in range(len(own) - window + 1):
            first.setdefault(tuple(own[s:s + window]), (rank[i], s))
    out = []
    for i, (_, text) in enumerate(docs):
        own = words(text)
        gone = set()
        for s in range(len(own) - window + 1):
            if first[tuple(own[s:s + window])] != (rank[i], s):
                gone.update(range(s, s + window))
        out.append([w for k, w in enumerate(own) if k not in gone])
    return out


def normalised(line: str) -> str:
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).translate(str.maketrans("123456789", "0" * 9)).strip(" ")


def edits(a: list[str], b: list[str]) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def lines_kept(docs: list[tuple]) -> list[str | None]:
    """Texts after line dedup by edit similarity of all pairs of lines; doc_ids are different."""
    places, first = [], {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    for r, i in enumerate(order):
        for p, line in enumerate((docs[i][1] or "").split("\n")):
            shown = regex.sub(r"[\s\p{Z}\p{Cc}]+", " ", line).strip(" ")
            if shown:
                own = normalised(line) or shown
                first.setdefault(own, (r, p))
                places.append((i, r, p, own))
    nodes = list(first)
    units = [n.split(" ") for n in nodes]
    sets = Sets(len(nodes))
    for a in range(len(nodes)):
        for b in range(a):
            most = math.floor(max(len(units[a]), len(units[b])) * 0.2 + 1e-9)
            if most and abs(len(units[a]) - len(units[b])) <= most:
                common = sum((Counter(units[a]) & Counter(units[b])).values())
                if max(len(units[a]), len(units[b])) - common <= most and edits(units[a], units[b]) <= most:
                    sets.join(a, b)
    number = {n: k for k, n in enumerate(nodes)}
    stays: dict[int, tuple] = {}
    for n in nodes:
        g = sets.find(number[n])
        stays[g] = min(stays.get(g, (1 << 60, 0)), first[n])
    gone = defaultdict(set)
    for i, r, p, own in places:
        if stays[sets.find(number[own])] != (r, p):
            gone[i].add(p)
    return [t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, (_, t) in enumerate(docs)]


def bm25(docs: list[tuple], queries: list[tuple], k: int) -> set[tuple]:
    """(query_id, rank, doc_id, score) by scoring everything."""
    bags = [Counter(words(lower(t))) for _, t in docs]
    df = Counter(w for b in bags for w in b)
    mean = sum(sum(b.values()) for b in bags) / max(1, len(bags))
    out = set()
    for q, text in queries:
        scored = []
        for (d, _), bag in zip(docs, bags):
            size, total, hit = sum(bag.values()), 0.0, False
            for w, n in Counter(words(lower(text))).items():
                if bag[w]:
                    hit = True
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    total += n * idf * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * size / mean))
            if hit:
                scored.append((-round(total, 6), d is None, d or 0, d))
        for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out.add((q, r, d, -s))
    return out
