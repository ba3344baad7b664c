import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np

from aerostrata.llm import repair

AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def options(role, fault, state):
    """(letter, cost, next state) of a row, from the contract."""
    yield "D", 3, state
    if fault not in ("blank", "duplicate"):
        extra = fault == "truncated"
        r = role[:1]
        if r and (r == AFTER[state] or (r == "s" and state == "")):
            yield "K", extra, r
        yield "R", 2 + extra, AFTER[state]


def cheapest(rows):
    """Smallest cost and, of all edits of that cost, the ASCII-least; every one is written out."""

    @cache
    def cost(i, state, inserted=0):
        best = 0 if i == len(rows) and state in ("", "a") else 1 << 20
        if inserted < 3:
            best = min(best, 2 + cost(i, AFTER[state], inserted + 1))
        if i < len(rows):
            best = min([best, *(c + cost(i + 1, s) for _, c, s in options(rows[i][0], rows[i][2], state))])
        return best

    def all_of(i, state, left, inserted=0):
        if i == len(rows) and state in ("", "a") and left == 0:
            yield ""
        if inserted < 3 and 2 + cost(i, AFTER[state], inserted + 1) <= left:
            yield from ("I" + x for x in all_of(i, AFTER[state], left - 2, inserted + 1))
        if i < len(rows):
            for letter, c, s in options(rows[i][0], rows[i][2], state):
                if c + cost(i + 1, s) <= left:
                    yield from (letter + x for x in all_of(i + 1, s, left - c))

    least = cost(0, "")
    return least, min(all_of(0, "", least))


def brute(table):
    convs, all_ids = defaultdict(list), {r[0] for r in table}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        act = zlib.crc32(key.encode()) % 20
        if act == 1:
            text = ""
        if act == 2:
            text = re.sub("[.!?]", "", text)
        if act == 4:
            role = "user"
        for _ in range((act != 0) + (act == 3)):
            convs[conv].append((turn, role, text))
    out = []
    for conv in all_ids:
        own = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, rows = set(), []
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated"
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = cheapest(tuple(rows))
        state, mended, todo = "", [], iter(rows)
        for edit in audit:
            role, text, _ = ("", "", "") if edit == "I" else next(todo)
            if edit == "K":
                state = role[0]
            elif edit in "IR":
                state = AFTER[state]
                role = NAME[state]
            if edit != "D":
                mended.append(f"{role}:{text}")
        counts = [sum(f == k for _, _, f in rows) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(mended).encode()).hexdigest()))
    return out


COLUMNS = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def mended(spark, rows, extra=False):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    if extra:
        for c in ("conv", "key", "first", "symbol", "part"):
            table = table.selectExpr("*", f"1 AS {c}")
    got = repair.repaired(repair.damaged(table))
    return [tuple(r) for r in got.select(COLUMNS).collect()]


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "Why? ", "same.", "a\x0b.\x0c", "é…", "end.\nmore", "\x1c"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, most)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice([*texts, f"text {rng.random()}.", None])))
    return rows


def test_blocks_give_the_cheapest_and_least_edits():
    rng, own = random.Random(1), repair.tables()
    roles = ["system", "user", "assistant", "tool"]
    for _ in range(1500):
        rows = tuple((rng.choice(roles), "", rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randrange(0, 11)))
        classes = np.array([8 if f == "blank" else 2 * roles.index(r) + (f == "truncated") for r, _, f in rows], np.int64)
        assert own.solve(classes) == cheapest(rows)


def test_every_block_length_gives_the_same():
    rng = random.Random(2)
    kinds = [repair.Tables(k) for k in (1, 2, 3, 5)]
    for _ in range(200):
        classes = np.array([rng.randrange(9) for _ in range(rng.randrange(60))], np.int64)
        assert len({k.solve(classes) for k in kinds}) == 1


def test_conversations_match_brute_force(spark):
    rows = conversations(3, 60, 9)
    rows += [(None, 1, "user", "x."), (None, 2, None, None), (777, None, None, None), (778, 5, "user", "Only."), (778, 5, "user", "Only.")]
    rows += rows[:40]
    assert sorted(mended(spark, rows, True), key=repr) == sorted(brute(rows), key=repr)
    assert mended(spark, []) == []


def test_long_conversation_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(5, t, rng.choice(["user", "assistant"]), f"turn {t % 211}" + rng.choice([".", ""])) for t in range(1500)]
    rows += [(9, t, "user", "again and again.") for t in range(300)]
    got = {r[0]: r for r in mended(spark, rows)}
    plain = {c: [r for r in rows if r[0] == c] for c in (5, 9)}
    assert set(got) == {5, 9}
    for c, own in plain.items():
        kept = [r for r in own if zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20]
        assert got[c][1] == kept[-1][1] - kept[0][1] + 1 - len(kept)
        assert len(got[c][7].replace("I", "")) == len(own) + sum((zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 == 3) - (zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 == 0) for r in own)
        cost = {"K": 0, "D": 3, "R": 2, "I": 2}
        assert 0 <= got[c][6] - sum(cost[e] for e in got[c][7]) <= got[c][4]


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert mended(spark, [(1, turn, "user", "Hi.")]) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_very_long_text_and_extreme_turns(spark):
    rows = [(1, -(1 << 63), "user", "word " * 200_000 + "."), (1, (1 << 63) - 1, "assistant", "Fine.")]
    got = mended(spark, rows)
    assert got[0][0] == 1 and len(got) == 1
