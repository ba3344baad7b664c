"""Quality by importance resampling over hashed n-grams.

Two generative models over hashed words and word pairs are counted: one from the target (labelled
good documents), one from the raw text (all documents). A document's weight is the log ratio of its
probabilities under the two as an average over its features, times `SCALE`, and shrunk as if `SCALE`
more features of no weight were there; one rule for every length. Adding Gumbel noise to the weights and
taking the k largest keys draws k documents without replacement in proportion to their weights.

k is the number of good documents that the corpus is estimated to hold, by adjusted counting: labelled
documents that did not enter the target tell which share of the good and of the poor ones have a key
above a cut; the share of all documents above it then gives the share of good ones among them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from aerostrata.llm.common import drop, prepared, written

BUCKETS = 1 << 16
LABELLED = 20_000        # labelled documents that are read for target and cut; the bound of the sample
GOOD_COST = 4.0          # how much worse it is to reject a good document than to keep a poor one
SCALE = 100              # features; see the rule of the weight above
_SMOOTH = 1.0
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x20 0-9A-Za-z\x80-\xff]+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_AGAIN = np.uint64(1)    # stands for every pair of equal words


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's words and word pairs; letters apart from signs, a repeat is one feature."""
    words = _WORD.findall((text or "").encode().lower())
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(one):
        return np.zeros(0, np.int64)
    two = one[:-1] * _ODD + (one[1:] ^ (one[1:] >> np.uint64(29)))
    two[one[:-1] == one[1:]] = _AGAIN
    both = np.concatenate([one, two])
    return ((both ^ (both >> np.uint64(32))) * _GOLDEN >> np.uint64(64 - 16)).astype(np.int64)


def gumbel(doc_id: int | None, text: str | None) -> float:
    """Standard Gumbel noise, the same for a document whenever it is drawn."""
    seed = xxhash.xxh3_64_intdigest(f"{doc_id}|".encode() + (text or "").encode())
    return float(-np.log(-np.log((seed >> 11) / (1 << 53) + 2.0 ** -54)))


@dataclass
class Model:
    ratio: np.ndarray        # by bucket: log of target over raw probability
    cut: float               # key that tells good and poor labelled documents apart best
    good_above: float = 1.0  # share of good labelled documents with a key at or above the cut
    poor_above: float = 0.0  # share of poor ones

    def weight(self, text: str | None) -> tuple[int, float]:
        found = features(text)
        return len(found), float(self.ratio[found].sum()) * SCALE / (SCALE + len(found))

    def good(self, documents: int, above: int) -> int:
        """How many of the documents are good, if so many have a key at or above the cut."""
        apart = self.good_above - self.poor_above
        if not documents or apart <= 0 or not np.isfinite(self.cut):
            return documents
        share = (above / documents - self.poor_above) / apart
        return int(np.ceil(documents * min(1.0, max(0.0, share)) - 1e-9))


def labelled(docs_labels: DataFrame, most: int = LABELLED) -> list[tuple[int, bool, bool]]:
    """At most `most` labelled documents by the order of a hash: (doc_id, good, in the target).

    A document is good if every label says quality 1; null ids or qualities are left out.
    """
    rows = docs_labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return [(int(r[0]), r[1] == 1, xxhash.xxh3_64_intdigest(str(r[0])) % 2 == 0) for r in chosen]


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, good_cost: float = GOOD_COST) -> Model:
    """Count both models over all of `docs`, and set the cut; without labels nothing is rejected.

    `labels` has doc_id and quality, 1 for good; null ids or qualities and ids that `docs` lacks are left
    out, a document with several labels is good if all say so. A null or empty text has no features.
    Repeated rows count as often as they occur. Empty tables, or no good label, give a model that keeps
    everything. Other columns are not read.
    """
    spark = prepared(docs.sparkSession)
    known = labelled(labels, most)
    target = spark.sparkContext.broadcast({i for i, good, in_target in known if good and in_target})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            every, wanted = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = features(text.as_py())
                every.append(found)
                if doc_id in target.value:
                    wanted.append(found)
            if every:
                raw += np.bincount(np.concatenate(every), minlength=BUCKETS)
            if wanted:
                good += np.bincount(np.concatenate(wanted), minlength=BUCKETS)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw[full]), pa.array(good[full])], ["bucket", "raw", "good"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = own.mapInArrow(count, "bucket long, raw long, good long")
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect():  # at most BUCKETS rows
        raw[row[0]], good[row[0]] = row[1], row[2]
    if not good.any():
        return Model(np.zeros(BUCKETS), -np.inf)
    # A bucket the target lacks is read as what the raw model expects of so small a target at most.
    share = good.sum() / raw.sum()
    ratio = np.log((good + _SMOOTH) / (raw * share + _SMOOTH))
    model = Model(ratio, -np.inf)
    test = {i: is_good for i, is_good, in_target in known if not (is_good and in_target)}
    sent = spark.sparkContext.broadcast((test, model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, own_model = sent.value
        for b in batches:
            rows = [
                (own_model.weight(t := text.as_py())[1] + gumbel(i, t), kinds[i])
                for i, text in zip(b.column(0).to_pylist(), b.column(1)) if i in kinds
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.bool_())], ["key", "good"])

    judged = own.mapInArrow(judge, "key double, good boolean").toPandas()  # about `most` rows
    keys, is_good = judged["key"].to_numpy(float), judged["good"].to_numpy(bool)
    model.cut = best_cut(keys, is_good, good_cost)
    above = keys >= model.cut
    model.good_above = float(above[is_good].mean()) if is_good.any() else 1.0
    model.poor_above = float(above[~is_good].mean()) if (~is_good).any() else 0.0
    return model


def best_cut(keys: np.ndarray, good: np.ndarray, good_cost: float) -> float:
    """The key between two documents below which rejecting costs least; minus infinity keeps all."""
    order = np.argsort(keys, kind="stable")
    keys, good = keys[order], good[order]
    cost = np.cumsum(np.where(good, good_cost, -1.0))
    if not len(keys) or cost.min() >= 0:
        return -np.inf
    at = int(cost.argmin())
    return float((keys[at] + keys[at + 1]) / 2) if at + 1 < len(keys) else np.inf


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Weights and keys of all documents: doc_id, n_features, log_weight, gumbel_key."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = text.as_py()
                n, weight = own.weight(t)
                rows.append((n, weight, weight + gumbel(doc_id, t)))
            kinds = [pa.int64(), pa.float64(), pa.float64()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], ["doc_id", "n_features", "log_weight", "gumbel_key"]
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_features long, log_weight double, gumbel_key double")


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the doubles `key`, exactly, by counting in ever narrower ranges.

    Nothing is sorted in one task and at most 1,025 counts come back a round, however many keys tie.
    """
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or not n:
        return np.inf
    if k >= n:
        return lo
    above = 0
    while lo < hi:
        step = (hi - lo) / 1024
        inside = keys.filter((F.col("key") >= lo) & (F.col("key") <= hi))
        fine = step > 0 and lo + 2 * step > lo  # else the range is a few neighbouring numbers
        cell = F.least(F.floor((F.col("key") - lo) / step), F.lit(1023)) if fine else F.col("key")
        rows = inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).orderBy(F.desc("cell")).collect()
        for _, count, least, most in rows:
            if above + count >= k:
                lo, hi = least, most
                break
            above += count
    return hi


def _least(table: DataFrame, model: Model, k: int | None) -> float:
    """The smallest key that is drawn from the scored documents `table`."""
    if k is None:
        n, above = table.agg(F.count(F.lit(1)), F.count_if(F.col("gumbel_key") >= F.lit(float(model.cut)))).first()
        k = model.good(n, above)
    return float(kth_largest(table.select(F.col("gumbel_key").alias("key")), k))


def resampled(docs: DataFrame, model: Model, k: int | None = None) -> DataFrame:
    """Scores of all documents and which of them are drawn: the k with the largest keys.

    Without k it is the estimated number of good documents. Adds `kept` to `scored`.
    Ties at the k-th key are all kept. A null or empty text has weight zero, so its noise decides;
    a null doc_id stays null; repeated rows are scored alike; an empty table gives
    no rows; other columns are not read.
    """
    table, _ = written(scored(docs, model), "weights")
    return table.withColumn("kept", F.col("gumbel_key") >= F.lit(_least(table, model, k)))


def filtered(docs: DataFrame, model: Model, k: int | None = None) -> DataFrame:
    """The documents, all columns, that `resampled` draws: the k of the largest keys, and ties at the k-th.

    Nulls, empty texts, repeated rows and empty tables are treated as there.
    """
    keys, path = written(scored(docs, model).select("gumbel_key"), "keys")
    least = _least(keys, model, k)
    drop(docs.sparkSession, path)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            kept = [
                own.weight(t := text.as_py())[1] + gumbel(i, t) >= least
                for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"))
            ]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, StructType(docs.schema.fields))
