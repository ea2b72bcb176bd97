"""Leaky-bucket rate control: one fold over the ordered frames of a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_bits(complexity: Column, qp: Column) -> Column:
    return F.when(complexity <= 0, 0).otherwise(F.floor(F.round(complexity * F.pow(F.lit(2.0), -(qp - 28) / 6.0), 6))).cast("long")


def _rounded(v: float, digits: int) -> float:
    """As the ``round`` of Spark SQL: half away from zero, of the shortest decimal."""
    return float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if math.isfinite(v) else v


def control(frames: DataFrame, kbps: int, fps: int = 30, init_qp: int = 28) -> DataFrame:
    """(stream, n, complexity) to (stream, n, qp, bits, fullness): constant bitrate over a bucket of two seconds that starts half
    full. A stream is one fold, so its frames are read in order by one task, which keeps the bucket's level and nothing else."""
    per_frame = kbps * 1000.0 / fps
    size = per_frame * fps * 2
    c = F.col("complexity").cast("double")
    ahead = base_bits(c, F.lit(init_qp))
    forward = F.when(ahead > 0, F.log2(ahead / per_frame) * 3.0).otherwise(0.0)
    factor = [r[0] for r in frames.sparkSession.range(52).select("id", F.pow(F.lit(2.0), -(F.col("id").cast("int") - 28) / 6.0).alias("f")).sort("id").select("f").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fullness = (), 0.0  # no stream yet
        for batch in batches:
            out = []
            for stream, complexity, ask in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if last != (stream,):
                    last, fullness = (stream,), size / 2
                qp = int(max(0, min(51, init_qp + _rounded(_rounded((fullness / size - 0.5) * 18.0 + ask, 9), 0))))
                if complexity is None:
                    bits, fullness = None, size
                else:
                    bits = 0 if complexity <= 0 else math.floor(_rounded(complexity * factor[qp], 6))
                    fullness = max(0.0, min(size, fullness + bits - per_frame))
                out.append((qp, bits, fullness))
            columns = zip(*out, strict=True) if out else ((), (), ())
            made = [pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["stream", "n", "qp", "bits", "fullness"])

    rows = frames.select("stream", F.col("n").cast("long").alias("n"), c.alias("complexity"), forward.alias("forward"))
    kind = frames.schema["stream"].dataType.simpleString()
    return rows.repartition("stream").sortWithinPartitions("stream", "n", "complexity").mapInArrow(run, f"stream {kind}, n long, qp int, bits long, fullness double")


def fixed(frames: DataFrame, qp: int) -> DataFrame:
    """The same with a fixed parameter."""
    return frames.select("stream", "n", F.lit(max(0, min(51, qp))).alias("qp"), base_bits(F.col("complexity"), F.lit(qp)).alias("bits"))


def series(spark, n: int) -> DataFrame:
    """(n, complexity): waves with a busy stretch and a still one."""
    i = F.col("id")
    wave = 40000 + 22000 * F.sin(i * 0.5) + F.when(i.between(10, 17), 35000).otherwise(0) + F.when(i.between(22, 25), -28000).otherwise(0)
    return spark.range(n).select(i.alias("n"), F.greatest(F.lit(2000.0), wave).alias("complexity"))
