"""Operator 7: document fingerprints from content-defined chunks.

A gear hash rolls over the bytes of a text and cuts it where the hash's top bits are zero: more bits before a chunk has its normal
size, fewer after, so that sizes keep close to normal. Boundaries depend on the 32 bytes before them alone, so an edit changes the
chunks that it touches and no others. The fingerprint is the set of chunk digests, each with the length it covers; containment is
the share of a text's length whose chunks the other text has too.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.common import table

#: Sizes of chunks in bytes, and the top bits that must be zero before and after the normal size.
LEAST, NORMAL, MOST = 8, 20, 80
STRICT, LOOSE = 5, 3
WINDOW = 32
GEAR = np.random.default_rng(32).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes of text that a task orders together, about; ranges of ids at most.
RANGE_BYTES, RANGES = 16 << 20, 4096

Fingerprint = dict[bytes, int]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:  # the hash over 2 * step bytes from that over step bytes
        h[step:] += h[:-step] << np.uint32(step) if step < n else h[:0]
        step *= 2
    loose = np.flatnonzero(h < np.uint32(1 << 32 - LOOSE))
    strict = loose[h[loose] < np.uint32(1 << 32 - STRICT)].tolist()
    loose = loose.tolist()
    out, at, ns, nl = [], 0, len(strict), len(loose)
    i = j = 0
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST - 1, i)
        if i < ns and strict[i] < at + NORMAL - 1:
            at = strict[i] + 1
        else:
            j = bisect_left(loose, at + NORMAL - 1, j)
            at = min(loose[j] + 1 if j < nl else n, at + MOST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def fingerprint(data: bytes) -> Fingerprint:
    """Digest of each distinct chunk (five bytes) and the bytes of text it covers."""
    out: Fingerprint = {}
    at = 0
    digest, get = xxhash.xxh3_64_digest, out.get
    for end in cuts(data):
        d = digest(data[at:end])[:5]
        out[d] = get(d, 0) + end - at
        at = end
    return out


def containment(a: Fingerprint, b: Fingerprint) -> float:
    """The share of a's length in chunks that b has, each counted as often as b has it; 1 for two empty texts, 0 for one."""
    if not a:
        return 0.0 if b else 1.0
    return sum(min(n, b.get(d, 0)) for d, n in a.items()) / sum(a.values())


def _length(n: int) -> bytes:
    """Seven bits a byte, low ones first; the top bit says that more follow."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


_SHORT = [_length(n) for n in range(256)]


def text_form(f: Fingerprint) -> str:
    """Digests with their lengths, in order, in Base64."""
    return base64.b64encode(b"".join([d + (_SHORT[n] if n < 256 else _length(n)) for d, n in sorted(f.items())])).decode("ascii")


def from_text(s: str) -> Fingerprint:
    raw, out, at = base64.b64decode(s), {}, 0
    while at < len(raw):
        d, n, shift = raw[at : at + 5], 0, 0
        at += 5
        while True:
            n |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                break
        out[d] = n
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of every whole text; null counts as empty, and the fingerprint of an empty text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_form(fingerprint((t or "").encode())) for t in batch.column(1).to_pylist()], pa.string())], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(part, ahead, doc_id, text): rows dealt into ranges of doc_id, each range followed by a copy of the row that comes after it
    in descending order (``ahead``), so that no range needs another. Sorted within partitions; the row after the last is the first.

    Equal ids go by text, null ids come last. The bounds of the ranges, at most 4,096, are the only thing on the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(RANGES, size // range_bytes))
    at = [k / ranges for k in range(1, ranges)]
    grid = rows.agg(F.percentile_approx("doc_id", at, 10 * RANGES)).first()[0] if at else None
    bounds = np.unique(np.array(grid or [], np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, ids.fillna(0).astype("int64").to_numpy(), "right")
        return pd.Series(np.where(ids.isna(), 0, at).astype("int32"))

    dealt = rows.withColumn("part", part_of("doc_id"))
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()  # a row for each range
    if not heads:
        return dealt.select("part", F.lit(False).alias("ahead"), "doc_id", "text")
    after = [(heads[k]["part"], heads[k]["top"], heads[(k + 1) % len(heads)]["part"]) for k in range(len(heads))]
    tops = docs.sparkSession.createDataFrame(after, "part int, top long, to int")
    found = dealt.join(F.broadcast(tops), "part").filter(F.col("doc_id").eqNullSafe(F.col("top")))
    ahead = found.groupBy("to").agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
    every = dealt.select("part", F.lit(False).alias("ahead"), "doc_id", "text").unionByName(ahead.select(F.col("to").alias("part"), F.lit(True).alias("ahead"), "doc_id", "text"))
    return every.repartition(max(1, 2 * len(heads)), "part").sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), "text")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, by descending doc_id.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next document.
    ``near_edited`` and ``near_next`` are the containment of the text in the other. Null counts as empty. A table of one row has
    itself as the next; repeated rows each have a place; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for part, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                print_ = fingerprint(text.encode())
                if held is not None and held[0] == part:
                    _, its_id, its, f = held
                    cut = len(its) // 3
                    new = (its[: len(its) - cut] + text[:cut]).encode()
                    g = fingerprint(new)
                    out.append((its_id, len(its), hashlib.sha256(new).hexdigest(), text_form(f), text_form(g), containment(f, g), containment(f, print_)))
                held = (part, doc_id, text, print_)
            for i in range(0, len(out), 1000):
                part_ = out[i : i + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part_, strict=True), [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()], strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    return with_next(docs, range_bytes).mapInArrow(run, COLUMNS)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: fingerprints of every document and of its edited text."""
    return edited(table(spark, sf_dir, "documents"))
