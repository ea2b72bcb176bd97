"""Deblocking of whole planes: edges from left to right along every line, then from top to bottom along every column.

What an edge changes is read by the next one, along the whole line. A band of macroblocks as wide as the plane is one row: the lines of
all bands of a batch go from edge to edge together. Macroblocks move twice: into bands across, and into bands down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.functions import dims
from lumenflow.operators.prediction import TC0

TILE = 16
ALPHA, BETA = np.array(dims.ALPHA, np.int32), np.array(dims.BETA, np.int32)
BOUND = np.array([(0,) * 52, *TC0], np.int32)  # by strength from 0 to 3


def filtered(lines: np.ndarray, strength: np.ndarray, index: np.ndarray, chroma: bool = False) -> np.ndarray:
    """Lines (n, width) with an edge before every fourth sample but the first: strength and index (n, width // 4) of each, the first unused.

    Chroma moves one sample on each side of an edge, luma up to three."""
    out = lines.copy()
    for e in range(1, lines.shape[1] // 4):
        x = 4 * e
        p0, p1, p2, p3 = (out[:, x - 1 - k].copy() for k in range(4))
        q0, q1, q2, q3 = (out[:, x + k].copy() for k in range(4))
        s, i = strength[:, e], np.clip(index[:, e], 0, 51)
        a, b = ALPHA[i], BETA[i]
        on = (s > 0) & (np.abs(p0 - q0) < a) & (np.abs(p1 - p0) < b) & (np.abs(q1 - q0) < b)
        if not on.any():
            continue
        strong = on & (s == 4)
        bound = BOUND[np.minimum(s, 3), i]
        near_p, near_q = np.abs(p2 - p0) < b, np.abs(q2 - q0) < b
        reach = bound + 1 if chroma else bound + near_p + near_q
        move = np.clip((4 * (q0 - p0) + (p1 - q1) + 4) >> 3, -reach, reach)
        close = np.zeros_like(on) if chroma else np.abs(p0 - q0) < (a >> 2) + 2
        for near, x0, x1, x2, x3, y0, y1, at, sign in ((near_p, p0, p1, p2, p3, q0, q1, lambda k, x=x: x - 1 - k, 1), (near_q, q0, q1, q2, q3, p0, p1, lambda k, x=x: x + k, -1)):
            deep = strong & near & close
            first = np.where(deep, (x2 + 2 * x1 + 2 * x0 + 2 * y0 + y1 + 4) >> 3, (2 * x1 + x0 + y1 + 2) >> 2)
            out[:, at(0)] = np.where(strong, first, np.where(on, np.clip(x0 + sign * move, 0, 255), x0))
            if not chroma:
                inner = x1 + np.clip((x2 + ((p0 + q0 + 1) >> 1) - 2 * x1) >> 1, -bound, bound)
                out[:, at(1)] = np.where(deep, (x2 + x1 + x0 + y0 + 2) >> 2, np.where(on & ~strong & near, inner, x1))
                out[:, at(2)] = np.where(deep, (2 * x3 + 3 * x2 + x1 + x0 + y0 + 4) >> 3, x2)
    return out


MARKS = ("outer", "inner", "index")


def _along(tiles: DataFrame, band: str, along: str, chroma: bool) -> DataFrame:
    """Macroblocks filtered along lines of one direction. A band has the macroblocks of one line of them: as many as the plane is wide or
    high."""
    columns = [along, "v", *MARKS]
    bands = tiles.groupBy("plane", band).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("t"))
    kind = tiles.schema["plane"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            sizes = np.diff(held.offsets.to_numpy())
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                part = held.take(pa.array(rows)).flatten()
                place, marks = part.field(0), [part.field(k).to_numpy(zero_copy_only=False).reshape(-1, n) for k in (2, 3, 4)]
                v = part.field(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, n, TILE, TILE)
                order = (0, 2, 1, 3) if along == "x" else (0, 3, 1, 2)
                lines = v.transpose(order)  # band, line, macroblock, sample
                four = np.repeat(marks[1][:, :, None], 4, 2)
                four[:, :, 0] = marks[0]
                each = lambda m: np.repeat(m.reshape(len(rows), 1, 4 * n), TILE, 1).reshape(-1, 4 * n)  # noqa: B023, E731
                done = filtered(lines.reshape(-1, n * TILE), each(four), each(np.repeat(marks[2][:, :, None], 4, 2)), chroma)
                back = done.reshape(lines.shape).transpose(np.argsort(order)).reshape(-1, TILE * TILE)
                samples = pa.ListArray.from_arrays(pa.array(np.arange(0, back.size + 1, TILE * TILE, dtype=np.int32)), pa.array(back.ravel(), pa.int32()))
                again = np.repeat(rows, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(again)), batch.column(1).take(pa.array(again)), place, samples, *[part.field(k) for k in (2, 3, 4)]], ["plane", band, along, "v", *MARKS])

    return bands.select("plane", band, "t").mapInArrow(run, f"plane {kind}, {band} int, {along} int, v array<int>, outer int, inner int, index int")


def planes(tiles: DataFrame, chroma: bool = False) -> DataFrame:
    """(plane, y, x, v): macroblocks (plane, y, x, v, outer, inner, index) filtered over whole planes. ``outer`` is the strength of the
    edges to the left of a macroblock and above it, ``inner`` that of the edges within, ``index`` looks the thresholds up. Edges of the
    plane are not filtered."""
    across = _along(tiles.select("plane", "y", "x", "v", *MARKS), "y", "x", chroma)
    return _along(across, "x", "y", chroma).select("plane", "y", "x", "v")
