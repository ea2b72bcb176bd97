"""Motion search over windows: every place with most of them ruled out by sums, and the diamond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.operators.planes import cells, let

#: Rows of a batch whose windows are worked on together.
TOGETHER = 256


def _arrays(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, *shape)


def _sums(table: np.ndarray, side: int) -> np.ndarray:
    """Sums of all squares of ``side`` samples, from a summed-area table."""
    return table[:, side:, side:] - table[:, :-side, side:] - table[:, side:, :-side] + table[:, :-side, :-side]


def best_places(cur: np.ndarray, win: np.ndarray, reach: int, part: int = 4) -> tuple[np.ndarray, ...]:
    """(dx, dy, sad, looked) for blocks (n, size, size) within windows (n, size + 2 * reach, ...).

    Two blocks differ by at least what their sums differ, and by at least what the sums of their parts differ. Sums of all squares of a
    window come from one summed-area table, so that a place whose bound is no less than the best so far is passed over. Places go by
    length of the vector, then row by row: only a smaller difference wins. ``looked`` counts the places whose difference was made."""
    n, size = cur.shape[:2]
    table = np.zeros((n, win.shape[1] + 1, win.shape[2] + 1), np.int32)
    table[:, 1:, 1:] = win.cumsum(1).cumsum(2)
    gap = np.abs(_sums(table, size) - cur.sum((1, 2))[:, None, None])
    fine, own = _sums(table, part), cur.reshape(n, size // part, part, size // part, part).sum((2, 4))
    best, at, looked = np.full(n, np.iinfo(np.int32).max), np.zeros((n, 2), np.int32), np.zeros(n, np.int32)
    span = range(-reach, reach + 1)
    for dx, dy in sorted(((dx, dy) for dy in span for dx in span), key=lambda v: (abs(v[0]) + abs(v[1]), v[1], v[0])):
        y, x = dy + reach, dx + reach
        left = np.flatnonzero(gap[:, y, x] < best)
        left = left[np.abs(fine[left, y : y + size : part, x : x + size : part] - own[left]).sum((1, 2)) < best[left]]
        if not len(left):
            continue
        sad = np.abs(win[left, y : y + size, x : x + size] - cur[left]).sum((1, 2))
        looked[left] += 1
        won = sad < best[left]
        best[left[won]], at[left[won]] = sad[won], (dx, dy)
    return at[:, 0], at[:, 1], best, looked


def full(rows: DataFrame, keep: list[str], size: int = 16, reach: int = 16) -> DataFrame:
    """(keep, dx, dy, sad, looked): where the block ``cur`` is best found in its window ``w``."""
    side, n = size + 2 * reach, len(keep)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                found = best_places(_arrays(part.column(n), size, size), _arrays(part.column(n + 1), side, side), reach)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *[pa.array(f.astype(np.int32)) for f in found]], [*keep, "dx", "dy", "sad", "looked"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", dx int, dy int, sad int, looked int"
    return rows.select(*keep, "cur", "w").mapInArrow(run, schema)


# The eight outer places of the large diamond and the four of the small one, in the order in which they are looked at.
LARGE = ((0, -2), (0, 2), (-2, 0), (2, 0), (-1, -1), (1, -1), (-1, 1), (1, 1))
SMALL = ((0, -1), (0, 1), (-1, 0), (1, 0))


def diamond(rows: DataFrame, keep: list[str], size: int = 16, reach: int = 16) -> DataFrame:
    """(keep, dx, dy, sad, points): the diamond search of ``cur`` in its window ``w``.

    All blocks step together, each a fold over its own row: to the best of the large diamond until that is its centre, then to the best
    of the small one. Equal differences go to the shorter vector, then to the pattern's order. A block keeps the places that it has
    looked at and none is looked at twice; ``points`` counts them."""
    side = size + 2 * reach
    pattern = lambda places: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(places)])
    code = lambda x, y: (y + reach) * (2 * reach + 1) + x + reach

    def search(v: Column) -> Column:
        def sad(x: Column, y: Column) -> Column:
            row = lambda r: F.aggregate(cells(size), F.lit(0), lambda s, c: s + F.abs(F.get(v["cur"], r * size + c) - F.get(v["w"], (y + reach + r) * side + x + reach + c)))
            return F.aggregate(cells(size), F.lit(0), lambda s, r: s + row(r))

        def step(s: Column, places) -> Column:
            """The state after one look around: the best place and all that were looked at."""
            around = F.transform(pattern(places), lambda p: F.struct(p["k"].alias("k"), (s["x"] + p["dx"]).alias("x"), (s["y"] + p["dy"]).alias("y")))
            new = F.filter(around, lambda p: p["x"].between(-reach, reach) & p["y"].between(-reach, reach) & ~F.array_contains(s["seen"], code(p["x"], p["y"])))
            rated = lambda c, k, x, y: F.struct(c.alias("sad"), (F.abs(x) + F.abs(y)).alias("cost"), k.alias("k"), x.alias("x"), y.alias("y"))

            def choose(n: Column) -> Column:
                best = F.array_min(F.concat(F.array(rated(s["sad"], F.lit(-1), s["x"], s["y"])), F.transform(n, lambda p: rated(sad(p["x"], p["y"]), p["k"], p["x"], p["y"]))))
                return let(best, lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["sad"].alias("sad"), F.concat(s["seen"], F.transform(n, lambda p: code(p["x"], p["y"]))).alias("seen"), (b["k"] < 0).alias("still")))

            return let(new, choose)

        zero = F.lit(0)
        start = F.struct(zero.alias("x"), zero.alias("y"), sad(zero, zero).alias("sad"), F.array(code(zero, zero)).alias("seen"), F.lit(False).alias("still"))
        # A move makes the difference or the vector smaller, so there are fewer moves than places.
        settled = F.aggregate(cells((2 * reach + 1) ** 2), start, lambda s, _: F.when(s["still"], s).otherwise(step(s, LARGE)))
        return let(settled, lambda s: step(s, SMALL))

    found = rows.select(*keep, let(F.struct("cur", "w"), search).alias("m"))
    return found.select(*keep, F.col("m.x").alias("dx"), F.col("m.y").alias("dy"), F.col("m.sad").alias("sad"), F.size("m.seen").alias("points"))
