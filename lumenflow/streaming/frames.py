"""Frames as streams: rate control with state for each stream, and reports over windows of time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEPS = "stream long, n long, qp int, bits long, fullness double"


def half_away(v: float) -> int:
    return int(math.floor(abs(v) + 0.5)) * (1 if v >= 0 else -1)


def base_bits(complexity: float, qp: int) -> int:
    return 0 if complexity <= 0 else math.floor(round(complexity * 2.0 ** (-(qp - 28) / 6.0), 6))


def rate_control(frames: DataFrame, kbps: int, fps: int = 30, init_qp: int = 28) -> DataFrame:
    """A stream of frames (stream, n, complexity) to (stream, n, qp, bits, fullness), the bucket's level kept as state.

    Frames of one trigger are taken in the order of n; later triggers must bring later frames. The batch form is
    ``operators.rate.control``."""
    per_frame = kbps * 1000.0 / fps
    size = per_frame * fps * 2

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fullness = state.get[0] if state.exists else size / 2
        rows = []
        for f in pd.concat(list(chunks)).sort_values("n").itertuples():
            ahead = base_bits(f.complexity, init_qp)
            forward = math.log2(ahead / per_frame) * 3.0 if ahead > 0 else 0.0
            qp = max(0, min(51, init_qp + half_away(round((fullness / size - 0.5) * 18.0 + forward, 9))))
            bits = base_bits(f.complexity, qp)
            fullness = max(0.0, min(size, fullness + bits - per_frame))
            rows.append((key[0], f.n, qp, bits, fullness))
        state.update((fullness,))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in STEPS.split(", ")])

    return frames.groupBy("stream").applyInPandasWithState(step, STEPS, "fullness double", "append", GroupStateTimeout.NoTimeout)


def window_report(frames: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count and bytes of each kind by window of time (ts), for streams and tables alike; later rows than ``late`` are left out."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("start"), "kind", "n", "bytes")


def sessions(frames: DataFrame, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Runs of a stream's frames without a longer pause than ``gap``."""
    return frames.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "stream").agg(F.count(F.lit(1)).alias("n")).select("stream", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
