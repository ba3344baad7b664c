"""Repair of the structure of conversations by Four-Russians block tables.

A conversation is a string of symbols, one per row: the role's initial and the row's fault. The
cheapest edits that give an allowed order of roles are found by dynamic programming over four states
(nothing yet, system last, user last, assistant last) from the last row to the first. A vector of
costs, less its smallest, takes few values, so its transition over every block of BLOCK symbols is
computed once; a conversation is then read a block at a time by lookup. For the edits, blocks are
expanded backward into their rows' vectors and traced forward, which allows the smallest edit letter
among the cheapest at every step; expanded blocks are kept in a table too.

Rows become symbols in DataFrame functions. Symbols are gathered one byte a row, from ranges that cut
long conversations; texts are only streamed, in order, past the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aerostrata.llm.common import drop, prepared, written
from aerostrata.llm.turns import in_parts, text_key

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_NOTHING: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}  # after an insert or rerole
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_ENDS = (_NOTHING, _ASSISTANT)
_INITIALS = "sua"
_FAR = 1 << 20
# Symbols: 4 * (place of the initial, 3 for others) + fault (0 none, 1 truncated, 2 duplicate, 3 blank).
# Classes: 2 * initial + truncated, or _GONE for rows that have to go.
_GONE, _CLASSES = 8, 9
_CLASS = np.array([2 * (s // 4) + s % 4 if s % 4 < 2 else _GONE for s in range(16)])


def kept_state(state: int, initial: int) -> int | None:
    """The state after a row of this initial is kept; None where its role may not stand."""
    if initial == 0:
        return _SYSTEM if state == _NOTHING else None
    to = {1: _USER, 2: _ASSISTANT}.get(initial)
    return to if to == _NEXT[state] else None


def _moves(cls: int, state: int) -> list[tuple[str, int, int]]:
    """Edits that use up a row of this class: letter, cost, next state."""
    out = [("D", DELETE, state)]
    if cls != _GONE:
        extra = TRUNCATED * (cls % 2)
        to = kept_state(state, cls // 2)
        if to is not None:
            out.append(("K", KEEP + extra, to))
        out.append(("R", REROLE + extra, _NEXT[state]))
    return out


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):  # a cheapest chain of inserts passes no state twice
        costs = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


class Tables:
    """Transitions of normalised cost vectors over all blocks of 1 to BLOCK symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = _with_inserts([0 if s in _ENDS else _FAR for s in range(4)])
        self.vectors, number = [end], {end: 0}
        to, add = [], []
        for v in self.vectors:  # grows while it is read
            rows = []
            for cls in range(_CLASSES):
                costs = _with_inserts([min(cost + v[t] for _, cost, t in _moves(cls, s)) for s in range(4)])
                least = min(costs)
                vector = tuple(c - least for c in costs)
                if vector not in number:
                    number[vector] = len(number)
                    self.vectors.append(vector)
                rows.append((number[vector], least))
            to.append([r[0] for r in rows])
            add.append([r[1] for r in rows])
        self.to, self.add = [None, np.array(to)], [None, np.array(add)]
        for _ in range(1, block):  # one more symbol in front
            inner, cost = self.to[-1], self.add[-1]
            after, more = self.to[1][inner], self.add[1][inner]  # vector, rest of the block, first symbol
            self.to.append(after.transpose(0, 2, 1).reshape(len(self.vectors), -1))
            self.add.append((more + cost[:, :, None]).transpose(0, 2, 1).reshape(len(self.vectors), -1))
        self.expanded = cache(self._expanded)

    def _expanded(self, vector: int, size: int, code: int, state: int) -> tuple[str, int]:
        """Edits of a block that ends with `vector`, entered in `state`, and the state after it."""
        symbols = [code // _CLASSES ** (size - 1 - k) % _CLASSES for k in range(size)]
        at, offsets = [vector], []
        for cls in reversed(symbols):
            offsets.append(int(self.add[1][at[-1], cls]))
            at.append(int(self.to[1][at[-1], cls]))
        at.reverse()
        offsets.reverse()
        out = []
        for k, cls in enumerate(symbols):
            while True:
                here, after = self.vectors[at[k]], self.vectors[at[k + 1]]
                left = here[state] + offsets[k]
                moves = sorted([m for m in _moves(cls, state) if m[1] + after[m[2]] == left])
                if here[state] == INSERT + here[_NEXT[state]] and not (moves and moves[0][0] < "I"):
                    out.append("I")
                    state = _NEXT[state]
                    continue
                out.append(moves[0][0])
                state = moves[0][2]
                break
        return "".join(out), state

    def solve(self, classes: np.ndarray) -> tuple[int, str]:
        """Cost and edits of a conversation given by its symbols' classes."""
        n, size = len(classes), self.block
        head = n % size
        codes = classes[head:].reshape(-1, size) @ (_CLASSES ** np.arange(size - 1, -1, -1))
        blocks = [(size, int(c)) for c in codes]
        if head:
            blocks.insert(0, (head, int(classes[:head] @ (_CLASSES ** np.arange(head - 1, -1, -1)))))
        vector, cost, ends = 0, 0, []
        for length, code in reversed(blocks):
            ends.append(vector)
            cost += int(self.add[length][vector, code])
            vector = int(self.to[length][vector, code])
        state, out = _NOTHING, []
        for (length, code), end in zip(blocks, reversed(ends)):
            piece, state = self.expanded(end, length, code, state)
            out.append(piece)
        while state not in _ENDS:
            out.append("I")
            state = _NEXT[state]
        return cost + self.vectors[vector][_NOTHING], "".join(out)


@cache
def tables() -> Tables:
    return Tables()


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: conv, turn, role, text and `times`, how often the row stands there (0: dropped).

    By crc32 of "conv_id:turn" modulo 20; nulls are one space, in this key and as role and text.
    """
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv", ":", "turn")])
    act = (F.crc32(key.cast("binary")) % 20).cast("int")
    return own.withColumn("act", act).select(
        "conv", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.expr("CASE act WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END").alias("times"),
    )


def _symbols(rows: DataFrame) -> DataFrame:
    """Symbols of the rows in groups of equal ones: conv, turn, role, key, first, again, n.

    `first` is the symbol of the first row of the group, `again` that of its n - 1 repeats.
    """
    initial = F.expr(f"CASE substr(role, 1, 1) {' '.join(f'WHEN {c!r} THEN {k}' for k, c in enumerate(_INITIALS))} ELSE 3 END")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 3).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 0).otherwise(1)
    small = rows.select("conv", "turn", "role", text_key(F.col("role"), F.col("text")).alias("key"), (4 * initial + fault).alias("symbol"), "times")
    groups = small.groupBy("conv", "turn", "role", "key", "symbol").agg(F.sum("times").alias("n"))
    # Nulls come first: a turn's place is (is there one, turn).
    place = F.struct(F.col("turn").isNotNull(), "turn")
    earliest = groups.groupBy("conv", "key").agg(F.min(place).alias("least"))
    earliest = earliest.select(F.col("conv").alias("_conv"), F.col("key").alias("_key"), "least")
    met = groups.join(earliest, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")))
    repeat = F.expr("CASE WHEN symbol % 4 = 3 THEN symbol ELSE symbol div 4 * 4 + 2 END").cast("int")
    first = F.when(place == F.col("least"), F.col("symbol")).otherwise(repeat)
    return met.select("conv", "turn", "role", "key", first.alias("first"), repeat.alias("again"), "n")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols of sorted rows as one byte string for each conversation and range."""
    held: list = [None, bytearray()]

    def out(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["conv", "part", "symbols"])

    for b in batches:
        rows = []
        for conv, part, first, again, n in zip(*(b.column(c).to_pylist() for c in ("conv", "part", "first", "again", "n"))):
            if held[0] != (conv, part):
                if held[1]:
                    rows.append((*held[0], bytes(held[1])))
                held[:] = [(conv, part), bytearray()]
            held[1].append(first)
            held[1] += bytes([again]) * (n - 1)
        if rows:
            yield out(rows)
    if held[1]:
        yield out([(*held[0], bytes(held[1]))])


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def judged(symbols: bytes) -> tuple[int, int, int, int, int, str]:
    """Counts, cost and edits of a whole conversation."""
    own = np.frombuffer(symbols, np.uint8).astype(np.int64)
    faults = np.bincount(own % 4, minlength=4)
    initials = own // 4
    pairs = initials[:-1] * 4 + initials[1:]
    legal = np.isin(pairs, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]).sum()
    cost, audit = tables().solve(_CLASS[own])
    return int(faults[3]), int(faults[2]), int(faults[1]), len(pairs) - int(legal), cost, audit


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and edits of each conversation, from its strings in order of their ranges."""
    conv, symbols, some = None, bytearray(), False

    def out(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.int64()] * len(_COUNTS), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["conv", *_COUNTS, "audit"])

    for b in batches:
        rows = []
        for own, piece in zip(b.column("conv").to_pylist(), b.column("symbols")):
            if some and own != conv:
                rows.append((conv, *judged(bytes(symbols))))
                symbols = bytearray()
            conv, some = own, True
            symbols += piece.as_py()
        if rows:
            yield out(rows)
    if some:
        yield out([(conv, *judged(bytes(symbols)))])


class _Mended:
    """The repaired conversation as a stream of rows past its edits; only a hash is kept."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, _NOTHING, hashlib.sha256(), False

    def put(self, role: str, text: bytes) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.any = True
        self.hash.update(role.encode() + b":")
        self.hash.update(text)

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            self.put(_ROLE[self.state], b"")

    def row(self, role: str, text: bytes) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = kept_state(self.state, _INITIALS.index(role[0]))
            self.put(role, text)
        elif edit == "R":
            self.state = _NEXT[self.state]
            self.put(_ROLE[self.state], text)

    def end(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv and repaired_sha256, from sorted rows; a conversation begins with its edits."""
    now: list = [None, None]
    for b in batches:
        out = []
        columns = (b.column(c) for c in ("conv", "first", "role", "text", "times"))
        for conv, first, role, text, times in zip(*columns):
            if first.as_py():
                if now[1] is not None:
                    out.append((now[0], now[1].end()))
                now[:] = [conv.as_py(), _Mended(text.as_py())]
            else:
                for _ in range(times.as_py()):
                    now[1].row(role.as_py(), text.as_buffer())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out])], ["conv", "repaired_sha256"])
    if now[1] is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1].end()])], ["conv", "repaired_sha256"])


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and a digest of the repaired text of every conversation of `damaged` rows.

    Returns conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows stand in
    the order of their turn (null first), then role, then a digest of role and text; equal rows are
    repeats of each other. Rows without a conversation id form one of their own. A role that begins
    with none of s, u, a (an empty one too) can't be kept. Gaps are null where they exceed a long. A
    conversation without rows costs nothing. An empty table gives no rows. The digest of one conversation is
    made in one task, which streams its rows; everything else is spread whatever a conversation's length.
    """
    spark = prepared(rows.sparkSession)
    left = rows.filter("times > 0")
    order = ["turn", "role", "key"]
    ranges, ranges_path = in_parts(_symbols(left), "conv", order, "symbols")
    strings = ranges.repartition("conv", "part").sortWithinPartitions("conv", "part", *order).mapInArrow(_strings, "conv long, part int, symbols binary")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    edits = strings.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_judge, f"conv long, {counts}, audit string")
    there = F.when(F.col("times") > 0, F.col("turn"))
    heads = rows.groupBy("conv").agg(F.min(there).alias("lo"), F.max(there).alias("hi"), F.count_distinct(there).alias("k"))
    gaps = F.expr("CASE WHEN lo IS NULL THEN 0 ELSE try_add(try_subtract(hi, lo), 1 - k) END")
    heads = heads.select("conv", gaps.alias("gaps")).join(edits.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")), "left")
    heads, heads_path = written(heads.select(
        "conv", "gaps", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit")
    ), "edits")
    drop(spark, ranges_path)
    texts = left.select("conv", F.lit(False).alias("first"), "turn", "role", text_key(F.col("role"), F.col("text")).alias("key"), "text", "times")
    begins = heads.select("conv", F.lit(True), F.lit(None), F.lit(None), F.lit(None), "audit", F.lit(0))
    stream = texts.unionAll(begins).repartition("conv").sortWithinPartitions("conv", F.desc("first"), *order)
    hashes = stream.mapInArrow(_mend, "_conv long, repaired_sha256 string")
    return heads.join(hashes, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
