"""Operator 8: toxicity by a factorization machine over hashed terms.

A text's terms are its words and their beginnings, hashed. Linear weights and pairwise interactions of low rank are learned from a
bounded sample of labelled texts; an insult counts for more beside a group mention than alone, which weights that add up cannot say.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.common import bounded_sample, fold, raw_texts, row_sums, table, utf8
from lumenflow.llm.shingles import words

#: Labelled texts that are learned from, about, chosen by a hash of their id.
SAMPLE = 6000
BUCKETS = 1 << 20
#: Buckets that the machine keeps: the most telling ones by the likelihood ratio, in at least LEAST texts.
TERMS, LEAST = 2048, 6
RANK = 6
STEPS, RATE, DECAY = 300, 0.05, 5e-4
THRESHOLD = 0.7
WORDS = 300_000  # entries of a worker's caches
BEGINNINGS = (3, 4, 5, 6, 7)


def terms(word: bytes) -> list[int]:
    """Buckets of a word: the word without punctuation around it, and its proper beginnings."""
    w = word.decode("utf-8", "replace").strip("\"'`.,;:!?()[]{}<>|*#$%&@~^_-+=/\\…«»“”„¿¡")
    out = ["w" + w, *(f"b{w[:n]}" for n in BEGINNINGS if len(w) > n)] if w else []
    return [xxhash.xxh3_64_intdigest(t.encode()) % BUCKETS for t in out]


class _Slots(dict):
    """Words to the model's slots of their buckets; a bounded cache, filled on demand."""

    def __init__(self, slot: dict[int, int]):
        self.slot = slot

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.clear()
        self[word] = out = tuple(self.slot[b] for b in terms(word) if b in self.slot)
        return out


@dataclass
class Model:
    """bias + x . w + the sum over pairs of <v_i, v_j> x_i x_j, through a sigmoid; x is 1 + ln(count) of each kept term."""

    buckets: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def slots(self) -> _Slots:
        return _Slots({int(b): i for i, b in enumerate(self.buckets)})

    def score(self, index: np.ndarray, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of rows whose (slot, value) pairs lie between offsets."""
        linear = row_sums(self.w[index] * x, offsets)
        first = row_sums(self.v[index] * x[:, None], offsets)
        second = row_sums((self.v[index] * x[:, None]) ** 2, offsets)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * (first**2 - second).sum(1), -500, 500)))


def _rows(texts: list[bytes], slots: _Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, offsets) of texts."""
    index, x, offsets = [], [], [0]
    get = slots.__getitem__
    for t in texts:
        count: dict[int, int] = {}
        for s in map(get, words(t)):
            if s:
                for i in s:
                    count[i] = count.get(i, 0) + 1
        index.extend(count)
        x.extend(count.values())
        offsets.append(len(index))
    return np.array(index, np.int64), 1 + np.log(np.array(x, np.float64)), np.array(offsets)


def _raw(column: pa.Array) -> list[bytes]:
    data, at = utf8(column)
    return raw_texts(data, at, 0, len(at) - 1)


def bucket_counts(labelled: DataFrame) -> DataFrame:
    """(bucket, pos, neg): labelled texts of either kind that have the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            count = np.zeros((2, BUCKETS), np.int64)
            for t, y in zip(_raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                has = set()
                for w in set(words(t)):
                    if w not in seen:
                        if len(seen) >= WORDS:
                            seen.clear()
                        seen[w] = terms(w)
                    has.update(seen[w])
                count[int(y), list(has)] += 1
            at = np.flatnonzero(count.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[1, at]), pa.array(count[0, at])], ["bucket", "pos", "neg"])

    return labelled.select("text", "y").mapInArrow(run, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def telling(counts: DataFrame, n_pos: int, n_neg: int) -> DataFrame:
    """The TERMS buckets with the largest likelihood ratio."""
    n, p = F.lit(float(n_pos + n_neg)), F.lit(n_pos / (n_pos + n_neg))
    df = F.col("pos") + F.col("neg")
    part = lambda k, want: F.when(k > 0, k * F.log(k / want)).otherwise(0.0)
    g = part(F.col("pos"), df * p) + part(F.col("neg"), df * (1 - p)) + part(n_pos - F.col("pos"), (n - df) * p) + part(n_neg - F.col("neg"), (n - df) * (1 - p))
    return counts.filter(df >= LEAST).withColumn("g", g).orderBy(F.desc("g"), "bucket").limit(TERMS)


def train(index: np.ndarray, x: np.ndarray, offsets: np.ndarray, y: np.ndarray, buckets: np.ndarray, rank: int = RANK, steps: int = STEPS) -> Model:
    """Adam on the whole sample; weight decay keeps terms of chance small."""
    rng = np.random.default_rng(8)
    n, d = len(y), len(buckets)
    dense = np.zeros((n, d), np.float32)
    dense[np.repeat(np.arange(n), np.diff(offsets)), index] = x
    square = dense**2
    p = [np.zeros(1, np.float32), np.zeros(d, np.float32), rng.normal(0, 0.02, (d, rank)).astype(np.float32)]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    p[0][0] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    for step in range(1, steps + 1):
        xv = dense @ p[2]
        z = p[0] + dense @ p[1] + 0.5 * ((xv**2).sum(1) - (square @ p[2] ** 2).sum(1))
        e = ((1 / (1 + np.exp(-np.clip(z, -60, 60)))) - y) / n
        g = [e.sum(keepdims=True), dense.T @ e + DECAY * p[1], dense.T @ (e[:, None] * xv) - (square.T @ e)[:, None] * p[2] + DECAY * p[2]]
        for q, grad, a, b in zip(p, g, m, s, strict=True):
            a += 0.1 * (grad - a)
            b += 0.01 * (grad**2 - b)
            q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model(buckets, float(p[0][0]), p[1].astype(np.float64), p[2].astype(np.float64))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from rows (doc_id, text, y). Without labels of both kinds the score is the share of ones, 0 without any label."""
    rows = labelled.filter("y is not null and text is not null").select("doc_id", "text", "y")
    some = bounded_sample(rows, "doc_id", sample)
    kinds = {r[0]: r[1] for r in some.groupBy(F.col("y").cast("int")).count().collect()}
    n_pos, n_neg = kinds.get(1, 0), kinds.get(0, 0)
    if not n_pos or not n_neg:
        return Model(np.zeros(0, np.int64), 50.0 if n_pos else -50.0, np.zeros(0), np.zeros((0, RANK)))
    buckets = np.array([r["bucket"] for r in telling(bucket_counts(some), n_pos, n_neg).collect()], np.int64)
    slot = Model(buckets, 0.0, np.zeros(0), np.zeros(0))
    shared = labelled.sparkSession.sparkContext.broadcast(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Model(shared.value, 0.0, np.zeros(0), np.zeros(0)).slots()
        for batch in batches:
            index, x, at = _rows(_raw(batch.column(0)), slots)
            cut = lambda a: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(a))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([cut(index.astype(np.int32)), cut(x.astype(np.float32)), batch.column(1).cast(pa.int32()), batch.column(2)], ["i", "x", "y", "u"])

    got = some.select("text", F.col("y").cast("int"), F.xxhash64("doc_id").alias("u")).mapInArrow(run, "i array<int>, x array<float>, y int, u long").toArrow()
    order = np.argsort(got["u"].to_numpy(), kind="stable")  # the same sums on each run
    got = got.take(pa.array(order))
    lists = got["i"].combine_chunks()
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return train(lists.flatten().to_numpy().astype(np.int64), got["x"].combine_chunks().flatten().to_numpy(), at, got["y"].to_numpy().astype(np.float32), slot.buckets)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text. Null counts as empty; an empty text has the bias alone. Repeated rows give repeated
    results; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slots = m.slots()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(*_rows(_raw(batch.column(1)), slots)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def with_labels(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, y): documents that are labelled; of repeated labels the largest counts, and null labels are left out."""
    one = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    return docs.select("doc_id", "text").join(one, "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: toxicity of every document, learned from labels outside fold 1 of 3."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_labels(docs, labels.filter(fold("doc_id", 3) != 1), "toxic")
    out = score(docs, model).withColumn("held_out", fold("doc_id", 3) == 1)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def fit_labels(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> Model:
    """:func:`fit` from a table of labels. The sample is drawn from the labels first, so that only its texts are joined."""
    one = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    some = bounded_sample(one, "doc_id", sample)  # a bounded number of rows, so that broadcasting it is safe
    return fit(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), sample * 4)
