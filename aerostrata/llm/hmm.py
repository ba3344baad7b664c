"""Scoring texts with a hidden Markov language model.

A word belongs to one of `CLASSES` hash classes. Latent states emit classes, and a class gives the
word by its smoothed corpus count, so P(text) = P(classes | states summed out) x product of
P(word | class). Baum-Welch trains transitions, starts and emissions: every task sums expected counts
over its training sequences, the sums are added up across tasks, and the next round's model goes back
to the tasks. What the driver holds is the model, states x classes numbers, whatever the input.
Recursions cover whole documents: a long one is cut into segments only to compute them side by side, and
products of transfer matrices carry the forward and backward state over every cut.

The first model comes from all training documents: random projections of their class counts deal them
into as many parts as there are states, and every document then moves to the part that explains it best.
Rounds end when the likelihood of a token hardly grows any more.

Word counts cover all training documents. They never meet in one place: a block of documents carries
its own vocabulary, block vocabularies are summed by word, and each block gets its words' totals back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from aerostrata.llm.common import drop, fresh_id, prepared, tidily_written as written

STATES = 8
CLASSES = 1 << 14        # a power of two: the class is the low bits of the word's hash
ROUNDS = 6               # at most
GAIN = 0.01              # log10 likelihood a training token, below which another round is not worth it
PARTING = 1              # times that documents move between the parts of the first model
SEGMENT = 128            # a long document's segments, computed side by side
LONG = 512               # tokens from which a document is computed by segments, with the same result
_PRIOR = 1000.0          # weight of the corpus distribution in a state's emissions, in tokens
_BLOCK_TOKENS = 1 << 20  # the larger a block, the fewer times a word is sent
_TOGETHER = 1 << 19     # tokens that go through the recursions together
_SALTED = 256           # blocks of one word that meet under one key
END = ""                 # the end token; no word is empty
_BLOCK = "block long, doc_ids array<long>, held binary, sizes binary, seq binary, classes binary, words array<string>, counts array<long>"


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END.encode()]


def class_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42) & (CLASSES - 1)


@dataclass
class Model:
    start: np.ndarray      # of a document's first token
    move: np.ndarray       # state x state
    emit: np.ndarray       # class x state
    mass: np.ndarray       # class: count + 0.5 (words + 1), the denominator of P(word | class)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row() -> pa.RecordBatch:
        flat = np.concatenate(seqs).astype(np.uint32)
        train = np.repeat(~np.array(held), [len(s) for s in seqs])
        counts = np.bincount(flat[train], minlength=len(index))
        return pa.RecordBatch.from_arrays([
            pa.array([fresh_id()]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(held, np.uint8).tobytes()], pa.binary()),
            pa.array([np.array([len(s) for s in seqs], np.int64).tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary()),
            pa.array([np.fromiter(map(class_of, index), np.uint16, len(index)).tobytes()], pa.binary()),
            pa.array([[w.decode() for w in index]], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())),
        ], ["block", "doc_ids", "held", "sizes", "seq", "classes", "words", "counts"])

    index, ids, held, seqs, size = _Numbers(), [], [], [], 0
    for b in batches:
        for doc_id, text, out in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            words = tokens(text.as_py())
            ids.append(doc_id)
            held.append(out)
            seqs.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
            size += len(words)
            if size >= _BLOCK_TOKENS:
                yield row()
                index, ids, held, seqs, size = _Numbers(), [], [], [], 0
    if ids:
        yield row()


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a block's tokens, their local word numbers, document sizes, held-out flags."""
    classes = np.frombuffer(row["classes"], np.uint16).astype(np.int64)
    seq = np.frombuffer(row["seq"], np.uint32)
    return classes[seq], seq, np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["held"], np.uint8).astype(bool)


def _recursions(
    classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, model: Model, entry: np.ndarray, leave: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected emissions, moves within the sequences (before the factor `move`) and first states; log10 likelihood.

    All sequences advance together, longest first, by the scaled forward and backward recursions.
    `entry` is the distribution over states each starts from, `leave` the backward value of its last token.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, alpha, leave = starts[order], sizes[order], entry[order], leave[order]
    length = int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes, -np.arange(1, length + 1), side="right")  # with more than t tokens
    forward, emitted, scales, seen = [], [], [], []
    likelihood = 0.0
    for t in range(length):
        n = alive[t]
        at = classes[starts[:n] + t]
        e = model.emit[at]
        alpha = (alpha if t == 0 else alpha[:n] @ model.move) * e
        scale = alpha.sum(axis=1, keepdims=True)
        likelihood += float(np.log10(scale).sum())
        alpha = alpha / scale
        forward.append(alpha)
        emitted.append(e)
        scales.append(scale)
        seen.append(at)
    states = len(model.start)
    moves = np.zeros((states, states))
    gammas: list[np.ndarray] = [np.zeros((0, states))] * length
    beta = np.zeros((0, states))
    for t in range(length - 1, -1, -1):
        n = alive[t]
        back = leave[:n].copy()
        if t + 1 < length:
            ahead = emitted[t + 1] * beta / scales[t + 1]
            moves += forward[t][:len(ahead)].T @ ahead
            back[:len(ahead)] = ahead @ model.move.T
        beta = back
        gammas[t] = forward[t] * beta
    emissions = np.zeros((len(model.emit), states))
    if length:
        gamma, where = np.concatenate(gammas), np.concatenate(seen)
        emissions = np.stack([np.bincount(where, gamma[:, k], len(model.emit)) for k in range(states)], axis=1)
    first = np.empty((len(order), states))
    if length:
        first[order] = gammas[0]
    return emissions, moves, first, likelihood


def _transfers(classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """By sequence: a matrix that takes a distribution before its first token to one after its last, but for scale."""
    states = len(model.start)
    order = np.argsort(-sizes, kind="stable")
    begin, ranked = starts[order], sizes[order]
    alive = np.searchsorted(-ranked, -np.arange(1, int(ranked.max()) + 1), side="right")
    now = np.repeat(np.eye(states)[None], len(order), axis=0)
    for t, n in enumerate(alive.tolist()):
        e = model.emit[classes[begin[:n] + t]]
        step = (now[:n] if t == 0 else (now[:n].reshape(-1, states) @ model.move).reshape(n, states, states)) * e[:, None, :]
        now[:n] = step / step.sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(now)
    out[order] = now
    return out


def _carried(transfer: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the segments of one sequence: distributions before them, backward values at their ends, moves over the cuts."""
    n, states = len(transfer), len(model.start)
    entry, after, leave = np.empty((n, states)), np.empty((n, states)), np.ones((n, states))
    now = model.start
    for i in range(n):
        entry[i] = now
        end = now @ transfer[i]
        after[i] = end / end.sum()
        now = after[i] @ model.move
    cross, back = np.zeros((states, states)), np.ones(states)
    for i in range(n - 1, 0, -1):
        ahead = transfer[i] @ back  # backward value of the distribution before segment i
        back = model.move @ ahead
        meet = after[i - 1] @ back
        cross += np.outer(after[i - 1], ahead) / meet
        back = back / meet
        leave[i - 1] = back
    return entry, leave, cross


def _long_counts(classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """As `expected_counts`, of long sequences by segments: states are carried over every cut, exactly."""
    parts = -(-sizes // SEGMENT)
    ends = np.cumsum(parts)
    cuts = (np.arange(int(parts.sum())) - np.repeat(ends - parts, parts)) * SEGMENT
    begin, length = np.repeat(starts, parts) + cuts, np.minimum(SEGMENT, np.repeat(sizes, parts) - cuts)
    step = max(1, _TOGETHER // (8 * SEGMENT))
    transfer = np.concatenate([_transfers(classes, begin[i:i + step], length[i:i + step], model) for i in range(0, len(cuts), step)])
    carried = [_carried(transfer[hi - n:hi], model) for hi, n in zip(ends.tolist(), parts.tolist())]
    entry, leave = np.concatenate([c[0] for c in carried]), np.concatenate([c[1] for c in carried])
    states = len(model.start)
    emissions, moves, likelihood = np.zeros((len(model.emit), states)), sum(c[2] for c in carried), 0.0
    firsts = []
    for i in range(0, len(cuts), step):
        e, m, f, ll = _recursions(classes, begin[i:i + step], length[i:i + step], model, entry[i:i + step], leave[i:i + step])
        emissions, moves, likelihood = emissions + e, moves + m, likelihood + ll
        firsts.append(f)
    return emissions, moves * model.move, np.concatenate(firsts)[ends - parts].sum(axis=0), likelihood


def expected_counts(
    classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, model: Model
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected emissions (class x state), moves (state x state) and starts of whole sequences, and their log10 likelihood."""
    states = len(model.start)
    emissions, moves, first, likelihood = np.zeros((len(model.emit), states)), np.zeros((states, states)), np.zeros(states), 0.0
    if (sizes > LONG).any():
        emissions, moves, first, likelihood = _long_counts(classes, starts[sizes > LONG], sizes[sizes > LONG], model)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] <= LONG]
    part = np.cumsum(sizes[order]) // _TOGETHER
    for at in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        even = np.ones((len(at), states))
        e, m, f, ll = _recursions(classes, starts[at], sizes[at], model, even * model.start, even)
        emissions, moves, first, likelihood = emissions + e, moves + m * model.move, first + f.sum(axis=0), likelihood + ll
    return emissions, moves, first, likelihood


def log_likelihoods(classes: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Exact log10 P(classes) of each sequence, by the scaled forward recursion over all of it."""
    order = np.argsort(-sizes, kind="stable")
    starts, ranked = (np.cumsum(sizes) - sizes)[order], sizes[order]
    alive = np.searchsorted(-ranked, -np.arange(1, int(ranked.max(initial=0)) + 1), side="right")
    total = np.zeros(len(sizes))
    alpha = np.broadcast_to(model.start, (len(sizes), len(model.start)))
    for t, n in enumerate(alive.tolist()):
        e = model.emit[classes[starts[:n] + t]]
        alpha = (alpha if t == 0 else alpha[:n] @ model.move) * e
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(sizes))
    out[order] = total
    return out


def _summed(blocks: DataFrame, states: int, rows: int, task: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A table of `rows` x `states` numbers: what `task` makes of a block's classes and its training
    documents' starts and sizes, summed over all blocks. At most `rows` rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, states))
        for b in batches:
            for row in b.to_pylist():
                classes, _, sizes, held = _unpacked(row)
                total += task(classes, (np.cumsum(sizes) - sizes)[~held], sizes[~held])
        full = np.flatnonzero(total.any(axis=1))
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full), *[pa.array(total[full, k]) for k in range(states)]], ["key", *[f"s{k}" for k in range(states)]])

    found = blocks.select("held", "sizes", "seq", "classes").mapInArrow(run, "key long, " + ", ".join(f"s{k} double" for k in range(states)))
    table = np.zeros((rows, states))
    for row in found.groupBy("key").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).collect():
        table[row[0]] = row[1:]
    return table


def _round(blocks: DataFrame, model: Model) -> tuple[Model, float]:
    """The next model, and the log10 likelihood of the training texts under this one."""
    sent = blocks.sparkSession.sparkContext.broadcast(model)
    states = len(model.start)

    def task(classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        emissions, moves, first, likelihood = expected_counts(classes, starts, sizes, sent.value)
        last = np.zeros((2, states))
        last[0], last[1, 0] = first, likelihood
        return np.concatenate([emissions, moves, last])

    table = _summed(blocks, states, CLASSES + states + 2, task)
    emissions, moves, first = table[:CLASSES], table[CLASSES:-2], table[-2]
    return Model(
        (first + 1) / (first + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), _emission(emissions, model.mass), model.mass,
    ), float(table[-1, 0])


def _emission(counts: np.ndarray, mass: np.ndarray) -> np.ndarray:
    prior = _PRIOR * (mass / mass.sum())[:, None]
    return (counts + prior) / (counts.sum(axis=0) + _PRIOR)


def _parts(weights: np.ndarray, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Class counts (class x part) of documents, each in the part whose weights sum to most over its tokens."""
    states = weights.shape[1]
    out = np.zeros((CLASSES, states))
    if len(sizes):
        # Training documents' tokens, held-out ones left out.
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        own, first = classes[at], np.cumsum(sizes) - sizes
        member = np.stack([np.add.reduceat(weights[own, k], first) for k in range(states)], axis=1).argmax(axis=1)
        out += np.bincount(own * states + np.repeat(member, sizes), minlength=CLASSES * states).reshape(CLASSES, states)
    return out


def first_model(blocks: DataFrame, mass: np.ndarray, states: int = STATES) -> Model:
    """A model whose states are parts of all training documents, each of documents with like classes.

    At first a part is where the largest of `states` random projections of the class counts is, rare
    classes weighing more; then each document moves to the part that gives its tokens the highest probability.
    """
    share = mass / mass.sum()
    weights = np.random.default_rng(42).choice([-1.0, 1.0], (CLASSES, states)) / np.sqrt(share)[:, None]
    weights -= share @ weights
    counts = np.zeros((CLASSES, states))
    for _ in range(1 + PARTING):
        sent = blocks.sparkSession.sparkContext.broadcast(weights)
        counts = _summed(blocks, states, CLASSES, lambda classes, starts, sizes: _parts(sent.value, classes, starts, sizes))
        weights = np.log(_emission(counts, mass))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), _emission(counts, mass), mass)


def _word_totals(blocks: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows (block, pos, c): the corpus count of each word of each block; and rows (word, c). Written, with their paths.

    A word of many blocks, the end token above all, is spread over salts, each of at most about
    `_SALTED` blocks; its parts are summed first and its total goes back once a salt.
    """
    salts = max(1, -(-blocks.count() // _SALTED))
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select(
        "block", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"), F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    parts = words.groupBy("word", "salt").agg(F.sum("n").alias("n"))
    totals, totals_path = written(parts.groupBy("word").agg(F.sum("n").alias("c"), F.collect_list("salt").alias("salts")), "word-totals")
    back = totals.select("word", "c", F.explode("salts").alias("salt"))
    given, given_path = written(words.drop("n").join(back, ["word", "salt"]).select("block", "pos", "c"), "block-totals")
    return given, totals.select("word", "c"), [totals_path, given_path]


def scored(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN) -> DataFrame:
    """Score every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) mod 5 is 1 are held out; all others train. base_score is
    the smoothed unigram score, score the model's log10 probability of the whole text. A null or
    empty text is the end token alone. A null doc_id stays null and trains. Repeated rows are counted
    as often as they occur; an empty table gives no rows; other columns are not read.
    """
    spark = prepared(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    blocks, _ = written(own.mapInArrow(_blocks, _BLOCK), "token-blocks")
    given, totals, paths = _word_totals(blocks)
    by_class = totals.groupBy(F.xxhash64("word").bitwiseAND(F.lit(CLASSES - 1)).cast("int").alias("class")).agg(
        F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("v")
    ).collect()  # at most CLASSES rows
    drop(spark, paths[0])
    count, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in by_class:
        count[row[0]], kinds[row[0]] = row[1], row[2]
    train, vocabulary = int(count.sum()), int(kinds.sum())
    mass = count + 0.5 * (kinds + 1)
    model, before = first_model(blocks, mass, states), -np.inf
    for _ in range(rounds):
        model, likelihood = _round(blocks, model)
        if likelihood - before < gain * train:
            break
        before = likelihood
    sent = spark.sparkContext.broadcast(model)
    floor = np.log10(train + 0.5 * (vocabulary + 1))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(block: pa.Table, total: pa.Table) -> pa.Table:
        row, own = block.to_pylist()[0], sent.value
        classes, seq, sizes, held = _unpacked(row)
        c = np.zeros(len(row["classes"]) // 2, np.int64)
        c[total["pos"].to_numpy()] = total["c"].to_numpy()
        first = np.cumsum(sizes) - sizes
        log_c = np.add.reduceat(np.log10(c + 0.5)[seq], first)
        log_mass = np.add.reduceat(np.log10(own.mass)[classes], first)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64)[seq], first)),
            "train_tokens": pa.array(np.full(len(sizes), train)), "base_score": pa.array(log_c - sizes * floor),
            "score": pa.array(log_c - log_mass + log_likelihoods(classes, sizes, own)),
        })

    kept = blocks.select("block", "doc_ids", "held", "sizes", "seq", "classes")
    return kept.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(score, schema)
