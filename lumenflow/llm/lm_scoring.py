"""Operator 2: language-model scoring of whole texts by a causal self-attention model on subword ids.

The model (see ``attention``) takes its counts of tokens, neighbours and class bigrams from all training texts. Its gradient steps begin
on a bounded sample of them and go on over all: tasks take steps over their texts, each token once, and the parameters that they end
with are averaged by tokens. It scores every text in overlapping windows, each token once. Beside it stands a base score from word counts over all training texts. The counts of frequent words, a
bounded number, travel to every task; the others meet the texts' rare words in a join, so that nothing unbounded is broadcast.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import attention
from lumenflow.llm.bpe import codec
from lumenflow.llm.common import bounded_sample, fold, pieces, raw_texts, row_sums, stored, table, utf8
from lumenflow.llm.shingles import words

#: Training texts of the first gradient steps, about, chosen by a hash of their id; the steps after these are over all texts.
SAMPLE = 2000
#: Words whose counts are broadcast, at most; and entries of a worker's cache of words.
FREQUENT, WORDS = 400_000, 1_000_000
#: Distinct words that a task counts before it passes them on.
FLUSH = 400_000
#: Keys that a task holds before it passes on their counts.
KEYS = 2_000_000
#: Ids whose keys are made at a time.
PIECE = 500_000
#: Tokens whose steps a task takes, about, once there are two tasks for each core; parameters of a row while they are averaged.
WALK, CHUNK = 50_000_000, 1 << 12
END = b"\n"  # the token after the last word; no word has white space


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, c): how often each word, named by its 64-bit hash, and the end token are in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, count), np.uint64, len(count)).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(count.values(), np.int64, len(count)))], ["h", "c"])
            count.clear()
            return out

        for batch in batches:
            data, at = utf8(batch.column(0))
            for i, j in pieces(at, 4 << 20):
                for t in raw_texts(data, at, i, j):
                    count.update(words(t))
                count[END] += j - i
                if len(count) >= FLUSH:
                    yield rows()
        if count:
            yield rows()

    return texts.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def token_ids(texts: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, u, ids): the subword ids of every whole text (doc_id, text) and the end token; u is a hash of both columns."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _cache(name, path, np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            data, at = utf8(batch.column(2))
            for i, j in pieces(at, 512 << 10):
                if len(known) > WORDS:
                    known.reset()
                flat, sizes = [], []
                for t in raw_texts(data, at, i, j):
                    ws = words(t)
                    ws.append(END)
                    flat += map(known.__getitem__, ws)
                    sizes.append(len(ws))
                slot = np.fromiter(flat, np.int64, len(flat))
                _, _, start, length, pool = known.arrays()
                n = length.take(slot).astype(np.int64)
                ends = np.cumsum(n)
                ids = pool.take(np.arange(ends[-1]) + np.repeat(start.take(slot) - (ends - n), n))
                cut = np.concatenate(([0], ends[np.cumsum(sizes) - 1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids))], ["doc_id", "u", "ids"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", F.xxhash64("doc_id", "text").alias("u"), "text").mapInArrow(run, f"doc_id {kind}, u long, ids array<int>")


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists end to end, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def tally(coded: DataFrame):
    """As ``attention.tally``, over all rows (ids) of a stored table. What comes to the driver is bounded by the vocabulary."""

    def counted(keys, *args) -> tuple[np.ndarray, np.ndarray]:
        shared = coded.sparkSession.sparkContext.broadcast(args)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _forget()  # the ids are made
            held, n = [], 0

            def rows() -> pa.RecordBatch:
                k, c = np.unique(np.concatenate(held), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int64))], ["k", "c"])

            for batch in batches:
                ids, at = _lists(batch.column(0))
                for i, j in pieces(at, PIECE):  # keys are several times their ids
                    held.append(keys(ids[at[i] : at[j]], at[i : j + 1] - at[i], *shared.value))
                    n += len(held[-1])
                    if n >= KEYS:
                        yield rows()
                        held, n = [], 0
            if n:
                yield rows()

        got = coded.select("ids").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
        shared.unpersist()
        return got["k"].to_numpy(), got["c"].to_numpy()

    return counted


def passed(coded: DataFrame):
    """What ``attention.train`` needs for steps over all rows (ids) of a stored table. Tasks start from the same parameters; what they
    add is summed by chunks of the parameters, so that the driver gets one set of them."""

    def go_on(p: dict[str, np.ndarray], known: np.ndarray, cls: np.ndarray, tokens: int) -> dict[str, np.ndarray]:
        spark = coded.sparkSession
        names = sorted(p)
        shared = spark.sparkContext.broadcast((p, known, cls))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _forget()
            start, *maps = shared.value
            own = {k: v.copy() for k, v in start.items()}

            def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for batch in batches:
                    ids, at = _lists(batch.column(0))
                    for i, j in pieces(at, PIECE):
                        yield ids[at[i] : at[j]], at[i : j + 1] - at[i]

            n = attention.walk(own, parts(), *maps)
            more = np.concatenate([(own[k] - start[k]).reshape(-1) for k in names])
            for i in range(0, len(more) if n else 0, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([n], pa.int64()), pa.array([more[i : i + CHUNK].tobytes()], pa.binary())], ["chunk", "n", "more"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            weight: Counter[int] = Counter()
            for batch in batches:
                for k, n, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x = np.frombuffer(more, np.float32) * float(n)
                    total[k] = total[k] + x if k in total else x
                    weight[k] += n
            for k, x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(x / weight[k]).astype(np.float32).tobytes()], pa.binary())], ["chunk", "more"])

        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-tokens // WALK))
        each = stored(coded.select("ids").coalesce(tasks).mapInArrow(run, "chunk int, n long, more binary"))
        got = stored(each.repartition("chunk").mapInArrow(mean, "chunk int, more binary")).toArrow().sort_by("chunk")  # few rows a batch
        shared.unpersist()
        if not len(got):
            return p
        more = np.concatenate([np.frombuffer(x, np.float32) for x in got["more"].to_pylist()])
        ends = np.cumsum([p[k].size for k in names])
        return {k: p[k] + more[e - p[k].size : e].reshape(p[k].shape) for k, e in zip(names, ends.tolist(), strict=True)}

    return go_on


def fit(texts: DataFrame, sample: int = SAMPLE, path: str | None = None) -> attention.Attention:
    """Counts tokens, their neighbours and class bigrams over all texts (doc_id, text); the first gradient steps use a bounded
    sample of whole texts, whose subword ids come to the driver, and those that follow use all texts where they are."""
    coded = stored(token_ids(texts, path))
    got = bounded_sample(coded, "doc_id", sample).select("u", "ids").toArrow()
    order = np.argsort(got["u"].to_numpy(), kind="stable")  # the same model on each run
    flat, at = _lists(got["ids"]) if len(got) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    return attention.train([flat[at[i] : at[i + 1]] for i in order], len(codec(path).tokens) + 1, counted=tally(coded), passed=passed(coded))


class _Column:
    """A numpy array that grows."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(2 * end - self.n, self.data.dtype)])
        self.data[self.n : end] = values
        self.n = end


class _Words(dict):
    """Words to numbers, with what is known of each in arrays; a bounded cache, filled on demand."""

    def __init__(self, c, hashes: np.ndarray, counts: np.ndarray):
        self.codec, self.hashes, self.counts = c, hashes, counts
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.h, self.count, self.start, self.length, self.ids = (_Column(k) for k in (np.int64, np.int64, np.int64, np.int32, np.int32))

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = self.h.n + len(self.new) - 1
        return n

    def arrays(self) -> tuple[np.ndarray, ...]:
        """(hash, count or -1 for a rare word, start and length in the ids, ids)."""
        if self.new:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.new), np.uint64, len(self.new)).view(np.int64)
            at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            count = np.where(self.hashes[at] == h, self.counts[at], -1) if len(self.hashes) else np.full(len(h), -1)
            ids, n = self.codec.encode_pieces([b"" if w == END else b" " + w for w in self.new])
            if END in self.new:
                i = self.new.index(END)
                ids, n[i] = np.insert(ids, int(n[:i].sum()), len(self.codec.tokens)), 1
            self.start.add(self.ids.n + np.cumsum(n) - n)
            for column, values in ((self.h, h), (self.count, count), (self.length, n), (self.ids, ids)):
                column.add(values)
            self.new = []
        return self.h.data, self.count.data, self.start.data, self.length.data, self.ids.data


#: The cache of one Python worker, for the broadcast that it was made for.
_held: dict[str, _Words] = {}


def _forget() -> None:
    _held.clear()


def _cache(name: str, path: str | None, hashes: np.ndarray, counts: np.ndarray) -> _Words:
    if name not in _held:
        _held.clear()
        _held[name] = _Words(codec(path), hashes, counts)
    return _held[name]


def score(docs: DataFrame, counts: DataFrame, model: attention.Attention, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of every whole text; null counts as empty.

    ``counts`` (h, c) is a stored table; where it is empty, every token has the probability of an unknown one. An empty text has
    its end token alone. Repeated rows give repeated results; other columns are ignored."""
    spark = docs.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # How many words there are by magnitude says from which magnitude on at most FREQUENT are left.
    size = F.floor(16 * F.log2("c"))
    kinds = sorted(((r[0], r[1]) for r in counts.groupBy(size.alias("k")).count().collect()), reverse=True)
    least, n = 1 << 20, 0
    for k, words_ in kinds:
        n += words_
        if n > FREQUENT:
            break
        least = k
    got = counts.filter(size >= least).toArrow()
    order = np.argsort(got["h"].to_numpy())
    shared = spark.sparkContext.broadcast((model, got["h"].to_numpy()[order], got["c"].to_numpy()[order]))
    name = uuid.uuid4().hex
    norm = float(np.log10(total + 0.5 * (distinct + 1))) if total or distinct else float(np.log10(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes, frequent = shared.value
        known = _cache(name, path, hashes, frequent)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in pieces(at, 512 << 10):
                if len(known) > WORDS:
                    known.reset()
                get = known.__getitem__
                flat, sizes = [], []
                for t in raw_texts(data, at, i, j):
                    ws = words(t)
                    ws.append(END)
                    flat += map(get, ws)
                    sizes.append(len(ws))
                slot, of = np.fromiter(flat, np.int64, len(flat)), np.concatenate(([0], np.cumsum(sizes)))
                h, count, start, length, pool = known.arrays()
                c = count.take(slot)
                base = row_sums(np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.5) - norm, 0.0), of)
                n_known = row_sums((c > 0).astype(np.float64), of)
                # Subword ids of all texts, end to end.
                n = length.take(slot)
                ends = np.cumsum(n, dtype=np.int64)
                ids = pool.take(np.arange(ends[-1]) + np.repeat(start.take(slot) - (ends - n), n))
                cut = np.concatenate(([0], ends[of[1:] - 1]))
                p = row_sums(m.log_probs(ids, cut).astype(np.float64), cut) / np.log(10)
                rare = c < 0
                text = np.repeat(np.arange(j - i), sizes)[rare]
                each = np.bincount(text, minlength=j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))), pa.int32()), pa.array(h[slot[rare]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(j - i), pa.int64()), batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(p), lists],
                    ["key", "id", "n_tokens", "known", "base", "score", "rare"],
                )
                key += j - i

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(docs.select(docs[id_col].alias("id"), docs["text"]).mapInArrow(run, f"key long, id {kind}, n_tokens long, known long, base double, score double, rare array<long>"))
    rest = counts.filter(size < least)
    each = rows.select("key", F.explode("rare").alias("h")).join(rest, "h", "left")
    c = F.coalesce("c", F.lit(0))
    more = each.groupBy("key").agg(F.sum(F.log10(c + 0.5) - norm).alias("more"), F.count("c").alias("also"))
    out = rows.drop("rare").join(more, "key", "left")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op2: scores of every document, learned from the documents outside fold 1 of 5."""
    docs = table(spark, sf_dir, "documents")
    training = docs.filter(fold("doc_id", 5) != 1)
    out = score(docs, stored(word_counts(training)), fit(training))
    return out.withColumn("held_out", fold("doc_id", 5) == 1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
