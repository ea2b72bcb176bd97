"""Prediction, motion and deblocking on arrays of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.functions import dims
from lumenflow.functions.scalar import clip, pick, shift

# Clipping bounds of deblocking by strength (1 to 3) and index from 0 to 51.
TC0 = (
    (0,) * 23 + (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 7, 8, 9, 10, 11, 13),
    (0,) * 21 + (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 7, 8, 8, 10, 11, 12, 13, 15, 17),
    (0,) * 17 + (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 7, 8, 9, 10, 11, 13, 14, 16, 18, 20, 23, 25),
)


def at(array: str, i: int) -> Column:
    return F.get(F.col(array), F.lit(i))


def intra4(top: list[Column], left: list[Column], corner: Column) -> dict[int, list[Column]]:
    """The nine predictions of a 4x4 block, row by row, from eight samples above, four to the left and the corner."""
    # The border as one line: from the lowest left sample up to the corner, then along the top.
    line = [*left[::-1], corner, *top]
    smooth = lambda i: shift(line[i - 1] + 2 * line[i] + line[min(i + 1, 12)] + 2, 2)
    mean = lambda i: shift(line[i] + line[i + 1] + 1, 1)
    grid = [(y, x) for y in range(4) for x in range(4)]
    dc = shift(sum(top[1:4], top[0]) + sum(left[1:], left[0]) + 4, 3)

    def vertical_right(y: int, x: int) -> Column:
        z = 2 * x - y
        return smooth(4) if z == -1 else smooth(3 - (y - 2)) if z < -1 else mean(4 + z // 2) if z % 2 == 0 else smooth(4 + (z + 1) // 2)

    def horizontal_down(y: int, x: int) -> Column:
        z = 2 * y - x
        return smooth(4) if z == -1 else smooth(5 + (x - 2)) if z < -1 else mean(3 - z // 2) if z % 2 == 0 else smooth(4 - (z + 1) // 2)

    def vertical_left(y: int, x: int) -> Column:
        i = 5 + x + y // 2
        return mean(i) if y % 2 == 0 else smooth(i + 1)

    def horizontal_up(y: int, x: int) -> Column:
        z = x + 2 * y
        if z > 5:
            return left[3]
        if z == 5:
            return shift(left[2] + 3 * left[3] + 2, 2)
        i = y + x // 2
        return shift(left[i] + left[i + 1] + 1, 1) if z % 2 == 0 else shift(left[i] + 2 * left[i + 1] + left[i + 2] + 2, 2)

    return {
        0: [top[x] for _, x in grid],
        1: [left[y] for y, _ in grid],
        2: [dc] * 16,
        3: [smooth(6 + x + y) for y, x in grid],
        4: [smooth(4 + x - y) for y, x in grid],
        5: [vertical_right(y, x) for y, x in grid],
        6: [horizontal_down(y, x) for y, x in grid],
        7: [vertical_left(y, x) for y, x in grid],
        8: [horizontal_up(y, x) for y, x in grid],
    }


def sad(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v)


def add_residual(prediction: Column, residual: Column) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: clip(p + r).cast("int"))


def chroma_eighth(a: Column, b: Column, c: Column, d: Column, fx: int, fy: int) -> Column:
    """Bilinear eighth sample of four neighbours."""
    return clip(shift((8 - fx) * (8 - fy) * a + fx * (8 - fy) * b + (8 - fx) * fy * c + fx * fy * d + 32, 6))


def deblock(df: DataFrame, p: list[str], q: list[str], strength: str, index: int, keep: list[str]) -> DataFrame:
    """Filters the luma samples p0..p3 and q0..q3 of an edge by strength 0 to 4; ``index`` looks the thresholds up."""
    alpha, beta = dims.ALPHA[index], dims.BETA[index]
    p0, p1, p2, p3 = (F.col(c) for c in p)
    q0, q1, q2, q3 = (F.col(c) for c in q)
    s = F.col(strength)
    on = (s > 0) & (F.abs(p0 - q0) < alpha) & (F.abs(p1 - p0) < beta) & (F.abs(q1 - q0) < beta)
    near_p, near_q = F.abs(p2 - p0) < beta, F.abs(q2 - q0) < beta
    tc0 = pick([t[index] for t in TC0], s - 1)
    tc = tc0 + near_p.cast("int") + near_q.cast("int")
    move = clip(shift(4 * (q0 - p0) + (p1 - q1) + 4, 3), -tc, tc)
    inner = lambda x2, x1: x1 + clip(shift(x2 + shift(p0 + q0 + 1, 1) - 2 * x1, 1), -tc0, tc0)
    close = F.abs(p0 - q0) < (alpha >> 2) + 2
    strong = lambda near, x0, x1, x2, x3, y0, y1: (
        F.when(near & close, shift(x2 + 2 * x1 + 2 * x0 + 2 * y0 + y1 + 4, 3)).otherwise(shift(2 * x1 + x0 + y1 + 2, 2)),
        F.when(near & close, shift(x2 + x1 + x0 + y0 + 2, 2)).otherwise(x1),
        F.when(near & close, shift(2 * x3 + 3 * x2 + x1 + x0 + y0 + 4, 3)).otherwise(x2),
    )
    sp, sq = strong(near_p, p0, p1, p2, p3, q0, q1), strong(near_q, q0, q1, q2, q3, p0, p1)
    weak_p = (clip(p0 + move), F.when(near_p, inner(p2, p1)).otherwise(p1), p2)
    weak_q = (clip(q0 - move), F.when(near_q, inner(q2, q1)).otherwise(q1), q2)
    put = lambda old, strong_, weak: F.when(~on, old).when(s == 4, strong_).otherwise(weak).cast("int")
    return df.select(*keep, *[put(F.col(c), a, b).alias(c) for c, a, b in zip(p[:3] + q[:3], sp + sq, weak_p + weak_q, strict=True)], F.col(p[3]), F.col(q[3]))


def plane_block(top: list[Column], left: list[Column], corner: Column, size: int, scale: int, down: int) -> list[Column]:
    """Prediction by a plane through the border, row by row; ``scale`` and ``down`` round its slopes."""
    half = size // 2
    line_t, line_l = [corner, *top], [corner, *left]  # index 0 is the corner
    slope = lambda line: shift(scale * sum(((i + 1) * (line[half + 1 + i] - line[half - 1 - i]) for i in range(1, half)), line[half + 1] - line[half - 1]) + (1 << down - 1), down)
    b, c = slope(line_t), slope(line_l)
    a = 16 * (left[-1] + top[-1])
    return [clip(shift(a + b * (x - half + 1) + c * (y - half + 1) + 16, 5)) for y in range(size) for x in range(size)]


def intra16(top: list[Column], left: list[Column], corner: Column) -> dict[int, list[Column]]:
    """Vertical, horizontal, DC and plane predictions of a 16x16 macroblock."""
    dc = shift(sum(top[1:], top[0]) + sum(left[1:], left[0]) + 16, 5)
    grid = [(y, x) for y in range(16) for x in range(16)]
    return {0: [top[x] for _, x in grid], 1: [left[y] for y, _ in grid], 2: [dc] * 256, 3: plane_block(top, left, corner, 16, 5, 6)}


def chroma8(top: list[Column], left: list[Column], corner: Column) -> dict[int, list[Column]]:
    """DC by quadrant, horizontal, vertical and plane predictions of an 8x8 chroma block."""
    four = lambda v: sum(v[1:], v[0])
    a, b, c, d = four(top[:4]), four(top[4:]), four(left[:4]), four(left[4:])
    quadrant = {(0, 0): shift(a + c + 4, 3), (0, 1): shift(b + 2, 2), (1, 0): shift(d + 2, 2), (1, 1): shift(b + d + 4, 3)}
    grid = [(y, x) for y in range(8) for x in range(8)]
    return {0: [quadrant[y // 4, x // 4] for y, x in grid], 1: [left[y] for y, _ in grid], 2: [top[x] for _, x in grid], 3: plane_block(top, left, corner, 8, 34, 6)}


def i420(pictures: DataFrame) -> DataFrame:
    """(path, content): planar frames of pixels (path, y, x, r, g, b) with integer matrices; chroma of the mean of four pixels."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    luma = pictures.select("path", F.lit(0).alias("plane"), "y", "x", clip(shift(77 * r + 150 * g + 29 * b, 8)).alias("v"))
    cells = pictures.groupBy("path", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(*[F.expr(f"sum({c}) div count(1)").cast("int").alias(c) for c in "rgb"])
    cb, cr = shift(-43 * r - 84 * g + 127 * b, 8) + 128, shift(127 * r - 106 * g - 21 * b, 8) + 128
    chroma = [cells.select("path", F.lit(k).alias("plane"), "y", "x", clip(v).alias("v")) for k, v in ((1, cb), (2, cr))]
    rows = luma.unionByName(chroma[0]).unionByName(chroma[1])
    ordered = F.array_sort(F.collect_list(F.struct("plane", "y", "x", "v")))
    return rows.groupBy("path").agg(F.unhex(F.array_join(F.transform(ordered, lambda e: F.lpad(F.hex(e["v"].cast("long")), 2, "0")), "")).alias("content"))


def coded_frames(pictures: DataFrame) -> DataFrame:
    """(path, width, height, y, cb, cr): pictures (path, width, height, data) of RGB bytes as planar 4:2:0 frames of the coded size, a
    multiple of 16 each way: the border repeats, samples are rounded by truncation of v + 0.5, chroma is the mean of two by two."""

    def byte(v: np.ndarray) -> bytes:
        return np.clip(v + 0.5, 0, 255).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, width, height, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                px = np.frombuffer(data, np.uint8).reshape(height, width, 3).astype(float)
                r, g, b = np.pad(px, ((0, -height % 16), (0, -width % 16), (0, 0)), "edge").transpose(2, 0, 1)
                four = lambda c: (c[::2, ::2] + c[::2, 1::2] + c[1::2, ::2] + c[1::2, 1::2]) / 4.0
                u, v = -0.168736 * r - 0.331264 * g + 0.5 * b + 128.0, 0.5 * r - 0.418688 * g - 0.081312 * b + 128.0
                out.append((path, r.shape[1], r.shape[0], byte(0.299 * r + 0.587 * g + 0.114 * b), byte(four(u)), byte(four(v))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["path", "width", "height", "y", "cb", "cr"])

    return pictures.select(F.col("path").cast("string").alias("path"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "data").mapInArrow(run, "path string, width int, height int, y binary, cb binary, cr binary")
