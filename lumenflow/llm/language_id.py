"""Operator 1: language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes. The probability of a byte is that of the longest known context;
a byte not seen there escapes to the next shorter one, whose bytes already ruled out are excluded, down to a uniform byte. The
statistics are frozen, so every (context, byte) has one exact code length per language: they are tabulated once, and a text's
code length is the sum of look-ups. The language that codes the text shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.common import bounded_sample, fold, pieces, row_sums, table, utf8

#: Labelled documents of each language that are learned from, about, chosen by a hash of their id.
PER_LANGUAGE = 1500
#: Three-byte contexts kept, the most frequent ones; rarer ones fall back to two bytes.
CONTEXTS = 12_000
LINE = 10  # a text is coded as if three line ends came before it
UNKNOWN = "und"
#: Bits by which a text must exceed 8 bits a byte to count as noise; a short text never does by chance.
NOISE = 64


def _context(symbols: np.ndarray, offsets: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    """For every position the symbol before it, two and three before it; ``first`` where the text has not so many."""
    out = []
    for k in (1, 2, 3):
        c = np.empty_like(symbols)
        c[k:], c[:k] = symbols[:-k] if k < len(symbols) else symbols[:0], first
        for j in range(k):
            at = offsets[:-1] + j
            c[at[at < offsets[1:]]] = first
        out.append(c)
    return tuple(out)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each byte follows each three bytes; gram holds the four bytes, the latest lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                data, at = utf8(batch.column(1).filter(pa.array([x == lang for x in langs])))
                for i, j in pieces(at, 4 << 20):
                    s, o = data[at[i] : at[j]].astype(np.uint32), at[i : j + 1] - at[i]
                    if len(s):
                        c1, c2, c3 = _context(s, o, LINE)
                        grams, n = np.unique(c3 << 24 | c2 << 16 | c1 << 8 | s, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Frozen code lengths. ``symbol`` maps bytes to symbols (bytes never seen share the last one), ``state`` three symbols of
    context to a state, ``bits`` a state and a symbol to code lengths by language."""

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text by language."""
        s = self.symbol[data]
        width = self.bits.shape[1]
        c1, c2, c3 = _context(s, offsets, int(self.symbol[LINE]))
        state = self.state[(c3 * width + c2) * width + c1]
        return row_sums(self.bits.reshape(-1, len(self.languages))[state * width + s], offsets)


def _distribution(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Rows of symbol probabilities from counts, escaping to ``below`` with as much weight as there are distinct symbols.

    Symbols that the context has are excluded below, so that every row sums to one."""
    seen = counts > 0
    n, q = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    rest = np.where(seen, 0.0, below)
    left = rest.sum(1, keepdims=True)
    escape = np.where((q > 0) & (left > 0), q, 0)
    total = np.maximum(n + escape, 1)
    out = np.where(seen, counts / total, rest * (escape / total) / np.maximum(left, 1e-300))
    return np.where(q > 0, out, below)


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, contexts: int = CONTEXTS) -> Model:
    """The tables from counts of four-byte grams; ``lang`` holds indices into ``languages``."""
    parts = [(gram >> s) & 255 for s in (24, 16, 8, 0)]
    used = np.unique(np.concatenate([*parts, [LINE]]))
    width = len(used) + (len(used) < 256)
    symbol = np.full(256, width - 1, np.int32)
    symbol[used] = np.arange(len(used))
    c3, c2, c1, s = (symbol[p].astype(np.int64) for p in parts)
    uniform = np.full((1, width), 1 / 256)
    uniform[0, len(used) :] = (256 - len(used)) / 256
    # States: 0, one symbol, two symbols, and the most frequent of three; the same for all languages.
    two, of_two = np.unique(c2 * width + c1, return_inverse=True)
    three, of_three = np.unique((c3 * width + c2) * width + c1, return_inverse=True)
    weight = np.bincount(of_three, n, len(three))
    keep = np.sort(np.argsort(-weight, kind="stable")[:contexts])
    first_two, first_three = 1 + width, 1 + width + len(two)
    state = np.empty((width, width, width), np.int32)
    state[:] = 1 + np.arange(width)
    pair = np.tile((1 + np.arange(width)).astype(np.int32), width)
    pair[two] = first_two + np.arange(len(two))
    state[:] = pair.reshape(width, width)
    state = state.reshape(-1)
    below_three = state[three[keep]].copy()
    state[three[keep]] = first_three + np.arange(len(keep))
    rank = np.full(len(three), -1)
    rank[keep] = np.arange(len(keep))
    bits = np.empty((first_three + len(keep), width, len(languages)), np.float32)
    for k in range(len(languages)):
        m = lang == k
        count = lambda rows, size, ok=m: np.bincount(rows[ok] * width + s[ok], n[ok], size * width).reshape(size, width)
        p0 = _distribution(count(np.zeros_like(s), 1), uniform)
        p1 = _distribution(count(c1, width), np.repeat(p0, width, 0))
        p2 = _distribution(count(of_two, len(two)), p1[two % width])
        lower = np.concatenate([p0, p1, p2])
        p3 = _distribution(count(rank[of_three], len(keep), m & (rank[of_three] >= 0)), lower[below_three])
        p = np.concatenate([lower, p3])
        p[:, len(used) :] /= max(1, 256 - len(used))  # of one byte among those never seen
        bits[:, :, k] = -np.log2(np.maximum(p, 1e-30))
    return Model(languages, symbol, state, bits)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, contexts: int = CONTEXTS) -> Model:
    """Learns from rows (doc_id, text, lang) with a language. The rows are a bounded sample of whole texts; what comes to the
    driver is their distinct four-byte grams with counts."""
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    got = gram_counts(bounded_sample(rows, "doc_id", per_language, "lang")).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    at = {x: i for i, x in enumerate(languages)}
    lang = np.array([at[x] for x in got["lang"].to_pylist()], np.int64)
    return build(languages, lang, got["gram"].to_numpy(), got["n"].to_numpy().astype(np.float64), contexts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte, reliable) of every whole text.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, and where the model knows no language. Ties go
    to the first language by name. ``score`` is the posterior of the language for equal priors; ``reliable`` is false where no
    language codes the text in 8 bits a byte (and NOISE more), as for noise and unknown scripts. Repeated rows give repeated
    results; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            data, at = utf8(batch.column(1))
            letter = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            length = np.zeros((len(letter), max(1, len(m.languages))))
            if m.languages:
                for i, j in pieces(at, 1 << 20):
                    length[i:j] = m.code_lengths(data[at[i] : at[j]], at[i : j + 1] - at[i])
            best = length.argmin(1)
            shortest = length[np.arange(len(best)), best]
            score = 1 / np.exp2(np.maximum(shortest[:, None] - length, -1000)).sum(1)
            known = letter & bool(m.languages)
            rate = shortest / np.maximum(np.diff(at), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[np.where(known, best, len(m.languages))], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(rate), pa.array(known & (shortest < 8.0 * np.diff(at) + NOISE))],
                ["doc_id", "lang_pred", "score", "bits_per_byte", "reliable"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double, reliable boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is known and reliable; all with letters where the model knows no language. All columns
    stay, under any names."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, at = utf8(batch.column(0).field(place))
            keep = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            if m.languages:
                for i, j in pieces(at, 1 << 20):
                    bits = m.code_lengths(data[at[i] : at[j]], at[i : j + 1] - at[i]).min(1)
                    keep[i:j] &= bits < 8.0 * np.diff(at[i : j + 1]) + NOISE
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], ["row"])

    place = docs.columns.index("text")
    rows = docs.select(row, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    kept = rows.mapInArrow(run, rows.select("row").schema)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every document, learned from the documents outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(fold("doc_id", 3) != 1))
    return identify(docs, model).withColumn("held_out", fold("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
