"""What the training-data operators share: table access, splits, shared storage and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo ``mod``; a null doc_id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % mod


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is exact for texts of single-byte characters and much faster than ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bounded_sample(rows: DataFrame, key: str, bound: int, by: str | None = None) -> DataFrame:
    """About ``bound`` rows (of each value of ``by``), chosen by a hash of ``key``: the same rows on each run, whatever the partitioning.

    Counts are read first, so a table with fewer rows is taken whole. ``by`` must have few values."""
    u = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    if by is None:
        n = rows.count()
        return rows if n <= bound else rows.filter(u < bound / n)
    counts = [(r[0], r[1]) for r in rows.groupBy(by).count().collect()]
    keep = F.lit(1.0)
    for value, n in counts:
        if n > bound:
            keep = F.when(F.col(by) == F.lit(value), F.lit(bound / n)).otherwise(keep)
    return rows.filter(u < keep)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares. Where spark.checkpoint.dir is unset, it is made here on a single machine
    (tests); a cluster without it is refused, since its machines would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/lumenflow/{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a table is stored: texts can be long, and a task holds a batch several times over.
BATCH_ROWS = 1000


def stored(df: DataFrame, even: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, and survives lost executors.

    ``even`` says that a shuffle has spread the rows: they are written as no more than four files for each core."""
    spark = df.sparkSession
    if even:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path, key = shared_dir(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that are broadcast, at most.
BROADCAST_ROWS = 500_000


def small(rows: DataFrame) -> bool:
    """Whether a stored table has few enough rows to be broadcast."""
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join on ``key``. ``ids`` is a stored table: it is broadcast only if it is small; beyond, both sides are
    shuffled."""
    return rows.join(F.broadcast(ids) if small(ids) else ids, key, how)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and n + 1 offsets, without copying where there are no nulls. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def raw_texts(data: np.ndarray, at: np.ndarray, i: int, j: int) -> list[bytes]:
    """Texts i to j - 1 of :func:`utf8`'s result."""
    raw = data[at[i] : at[j]].tobytes()
    cut = (at[i : j + 1] - at[i]).tolist()
    return [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[k]:offsets[k + 1]] along the first axis, in double precision."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=np.float64)
    return out
