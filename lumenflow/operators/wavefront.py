"""Intra prediction from neighbours that were coded before: all pictures go along their diagonals together.

A macroblock reads the last row of the one above and the last column of the one to its left, as they were reconstructed. Those on one
diagonal of their pictures do not depend on each other: they are one round, which joins the borders that the round before has stored.
There are as many rounds as a picture has diagonals, however many pictures there are. Within a macroblock its sixteen blocks follow each
other, each for all macroblocks of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.functions import dims
from lumenflow.operators.storage import stored

#: Column and row of the sixteen blocks in the order of coding: two by two, within two by two.
PLACES = [((k & 1) + (k >> 2 & 1) * 2, (k >> 1 & 1) + (k >> 3) * 2) for k in range(16)]
# Blocks whose samples above and to the right count as missing.
NO_RIGHT = (3, 5, 7, 11, 13, 15)
HADAMARD = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]], np.int64)
FORWARD = np.array([[1, 1, 1, 1], [2, 1, -1, -2], [1, -1, -1, 1], [1, -2, 2, -1]], np.int64)


def _recipe() -> np.ndarray:
    """For modes 0 to 8 and each sample an entry of (plain, smooth, mean) over the border line: the lowest left sample first, the corner at
    4, then eight above. Mode 2 is made elsewhere."""
    plain, smooth, mean = (lambda i: i), (lambda i: 13 + i), (lambda i: 26 + i)

    def skewed(z: int, far: int, sign: int) -> int:
        """Modes 5 and 6, which mirror each other at the corner."""
        if z == -1:
            return smooth(4)
        if z < -1:
            return smooth(far)
        return (mean(4 + z // 2) if sign > 0 else mean(3 - z // 2)) if z % 2 == 0 else smooth(4 + sign * ((z + 1) // 2))

    def up(y: int, x: int) -> int:
        z = x + 2 * y
        return plain(0) if z > 5 else smooth(0) if z == 5 else mean(2 - y - x // 2) if z % 2 == 0 else smooth(2 - y - x // 2)

    rules = [
        lambda y, x: plain(5 + x), lambda y, x: plain(3 - y), lambda y, x: 0, lambda y, x: smooth(6 + x + y), lambda y, x: smooth(4 + x - y), lambda y, x: skewed(2 * x - y, 5 - y, 1), lambda y, x: skewed(2 * y - x, 3 + x, -1),
        lambda y, x: smooth(6 + x + y // 2) if y % 2 else mean(5 + x + y // 2), up,
    ]
    return np.array([[r(y, x) for y in range(4) for x in range(4)] for r in rules])


RECIPE = _recipe()


def predictions(line: np.ndarray, left: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The nine predictions (n, 9, 16) from border lines (n, 13); DC is the mean of the borders that are there, 128 without any."""
    before, after = line[:, np.maximum(np.arange(13) - 1, 0)], line[:, np.minimum(np.arange(13) + 1, 12)]
    made = np.concatenate([line, (before + 2 * line + after + 2) >> 2, (line + after + 1) >> 1], 1)[:, RECIPE]
    a, b = line[:, :4].sum(1), line[:, 5:9].sum(1)
    made[:, 2] = np.where(left & top, (a + b + 4) >> 3, np.where(left, (a + 2) >> 2, np.where(top, (b + 2) >> 2, 128)))[:, None]
    return made


def allowed(left: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Modes (n, 9) whose neighbours are there."""
    both, always = left & top, np.ones_like(left)
    return np.stack([top, left, always, top, both, both, both, top, left], 1)


def _classes(table) -> np.ndarray:
    even, odd, mixed = table
    return np.array([[even if y % 2 == x % 2 == 0 else odd if y % 2 == x % 2 == 1 else mixed for x in range(4)] for y in range(4)], np.int64)


def _inverse(r: np.ndarray) -> np.ndarray:
    """One pass along the last axis."""
    e, f, g, h = r[..., 0] + r[..., 2], r[..., 0] - r[..., 2], (r[..., 1] >> 1) - r[..., 3], r[..., 1] + (r[..., 3] >> 1)
    return np.stack([e + h, f + g, f - g, e - h], -1)


def coded(o: np.ndarray, left: np.ndarray, top: np.ndarray, corner: np.ndarray, sides: np.ndarray, counts: np.ndarray, qp: int) -> dict[str, np.ndarray]:
    """Macroblocks (n, 16, 16) coded block by block. ``sides`` (n, 2) says whether left (n, 16) and top (n, 16) are there, ``counts`` (n, 2, 4)
    are the non-zero levels of the blocks to the left and above.

    Of the modes that the neighbours allow the one of least SATD is taken, the smaller of equals. Levels that the coder cannot write (a
    context from 4 to 7, four of them) are dropped. Everything is by block in coding order; levels are scanned."""
    n, scan = len(o), np.array(dims.zigzag(4))
    canvas = np.zeros((n, 17, 17), np.int64)
    canvas[:, 0, 1:], canvas[:, 1:, 0], canvas[:, 0, 0] = top, left, corner
    full = np.zeros((n, 5, 5), np.int64)  # non-zero levels, with those of the neighbours
    full[:, 1:, 0], full[:, 0, 1:] = counts[:, 0], counts[:, 1]
    out = {k: np.zeros((n, 16), np.int32) for k in ("modes", "costs", "contexts", "totals", "dropped")} | {"levels": np.zeros((n, 16, 16), np.int32)}
    bits = 15 + qp // 6
    multiply, scale, third = _classes(dims.FORWARD[qp % 6]), _classes(dims.LEVEL_SCALE[qp % 6]), (1 << bits) // 3
    for k, (bx, by) in enumerate(PLACES):
        y, x = 4 * by, 4 * bx
        has_left, has_top = sides[:, 0] | (bx > 0), sides[:, 1] | (by > 0)
        above = canvas[:, y, x + 1 : x + 5]
        right = above[:, 3:].repeat(4, 1) if k in NO_RIGHT else canvas[:, y, x + 5 : x + 9]
        line = np.concatenate([canvas[:, y + 4 : y : -1, x], canvas[:, y, x : x + 1], above, right], 1)
        line *= np.concatenate([has_left[:, None].repeat(4, 1), (has_left & has_top)[:, None], has_top[:, None].repeat(8, 1)], 1)
        made = predictions(line, has_left, has_top).reshape(n, 9, 4, 4)
        block = o[:, y : y + 4, x : x + 4]
        cost = (np.abs(HADAMARD @ (block[:, None] - made) @ HADAMARD.T).sum((2, 3)) + 1) >> 1
        cost[~allowed(has_left, has_top)] = np.iinfo(np.int64).max
        mode = cost.argmin(1)
        best = made[np.arange(n), mode]
        w = FORWARD @ (block - best) @ FORWARD.T
        level = np.sign(w) * ((np.abs(w) * multiply + third) >> bits)
        both = has_left & has_top
        a, b = full[:, by + 1, bx], full[:, by, bx + 1]
        context = np.where(both, (a + b + 1) >> 1, np.where(has_left, a, np.where(has_top, b, 0)))
        total = (level != 0).sum((1, 2))
        drop = (total == 4) | ((context >= 4) & (context <= 7))
        level[drop] = 0
        total = np.where(drop, 0, total)
        rest = _inverse(level * scale << qp // 6)
        rest = (_inverse(rest.transpose(0, 2, 1)).transpose(0, 2, 1) + 32) >> 6
        canvas[:, y + 1 : y + 5, x + 1 : x + 5] = np.clip(best + rest, 0, 255)
        full[:, by + 1, bx + 1] = total
        for name, v in (("modes", mode), ("costs", cost[np.arange(n), mode]), ("contexts", context), ("totals", total), ("dropped", drop)):
            out[name][:, k] = v
        out["levels"][:, k] = level.reshape(n, 16)[:, scan]
    return out | {"v": canvas[:, 1:, 1:], "right_counts": full[:, 1:, 4], "down_counts": full[:, 4, 1:], "below": canvas[:, 16, 0]}


RESULT = ("modes", "costs", "contexts", "totals", "dropped", "levels", "v", "right_counts", "down_counts")
BORDER = {"left_v": 16, "left_counts": 4, "top_v": 16, "top_counts": 4}


def _round(tiles: DataFrame, before: DataFrame | None, qp: int) -> DataFrame:
    """Macroblocks of one diagonal, coded with what the diagonal before has left of them."""
    kind = tiles.schema["plane"].dataType.simpleString()
    rows = tiles.select("plane", "y", "x", "v")
    if before is None:
        rows = rows.select("*", *[F.lit(None).cast("array<int>").alias(c) for c in BORDER], F.lit(None).cast("int").alias("corner"))
    else:
        left = before.select("plane", "y", (F.col("x") + 1).alias("x"), F.transform(F.sequence(F.lit(15), F.lit(255), F.lit(16)), lambda i: F.get("v", i)).alias("left_v"), F.col("right_counts").alias("left_counts"))
        top = before.select("plane", (F.col("y") + 1).alias("y"), "x", F.slice("v", 241, 16).alias("top_v"), F.col("down_counts").alias("top_counts"), F.col("below").alias("corner"))
        rows = rows.join(left, ["plane", "y", "x"], "left").join(top, ["plane", "y", "x"], "left").select(*rows.columns, *BORDER, "corner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            whole = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            there = {c: np.asarray(batch.column(c).is_valid()) for c in BORDER}
            border = {}
            for c, width in BORDER.items():
                border[c] = np.zeros((n, width), np.int64)
                border[c][there[c]] = whole(batch.column(c).drop_null()).reshape(-1, width)
            corner = batch.column("corner").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = coded(whole(batch.column("v")).reshape(n, 16, 16), border["left_v"], border["top_v"], corner, np.stack([there["left_v"], there["top_v"]], 1), np.stack([border["left_counts"], border["top_counts"]], 1), qp)
            lists = []
            for name in RESULT:
                flat = found[name].reshape(n, -1).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists, pa.array(found["below"].astype(np.int32))], ["plane", "y", "x", *RESULT, "below"])

    return rows.mapInArrow(run, f"plane {kind}, y int, x int, {', '.join(f'{c} array<int>' for c in RESULT)}, below int")


def code(tiles: DataFrame, qp: int = 28) -> DataFrame:
    """(plane, y, x, modes, costs, contexts, totals, dropped, levels, v) of macroblocks (plane, y, x, high, wide, v): v is what a decoder
    gets. Pictures may have different sizes; an empty table gives no rows."""
    tiles = stored(tiles)
    last = tiles.agg(F.max(F.col("high") + F.col("wide") - 2)).first()[0]
    rounds: list[DataFrame] = []
    for t in range((last if last is not None else -1) + 1):
        rounds.append(stored(_round(tiles.filter(F.col("x") + F.col("y") == t), rounds[-1] if rounds else None, qp)))
    if not rounds:
        return _round(tiles, None, qp).drop("right_counts", "down_counts", "below")
    return reduce(DataFrame.unionByName, rounds).drop("right_counts", "down_counts", "below")
