"""Planes as macroblocks: windows over their neighbours, noise, displaced copies, and samples between samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.functions.scalar import clip, constants, shift

TILE = 16
WINDOW = 3 * TILE

# Multiplier and increment of the noise generator, its modulus is 2**32.
STEP, ADD = 1103515245, 12345


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for each row, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def cells(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def windows(tiles: DataFrame) -> DataFrame:
    """(plane, y, x, high, wide, w) of macroblocks (plane, y, x, high, wide, v): w has the 48 by 48 samples around and with a macroblock,
    row by row; the plane's border repeats. Each macroblock goes to its eight neighbours: one shuffle, of nine rows for one."""
    reach = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    sent = tiles.select("*", F.inline(reach)).select("plane", "high", "wide", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), (4 - 3 * F.col("dy") - F.col("dx")).alias("k"), "v")
    inside = sent.filter("y between 0 and high - 1 and x between 0 and wide - 1")
    held = inside.groupBy("plane", "y", "x", "high", "wide").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))  # nine at most
    near = held.select("plane", "y", "x", "high", "wide", F.transform(cells(9), lambda k: F.try_element_at("m", k)).alias("near"))

    def inner(i: Column, here: str, n: str) -> Column:
        """Row or column i of the window, moved to the nearest that the plane has."""
        return clip(i, F.when(F.col(here) == 0, TILE).otherwise(0), 3 * TILE - 1 - F.when(F.col(here) == F.col(n) - 1, TILE).otherwise(0))

    def line(near: Column, r: Column) -> Column:
        return F.transform(cells(WINDOW), lambda i: let(inner(i, "x", "wide"), lambda c: F.get(F.get(near, 3 * shift(r, 4) + shift(c, 4)), r.bitwiseAND(15) * TILE + c.bitwiseAND(15))))

    whole = let(F.col("near"), lambda near: F.transform(cells(WINDOW), lambda i: let(inner(i, "y", "high"), lambda r: line(near, r))))
    return near.select("plane", "y", "x", "high", "wide", F.flatten(whole).alias("w"))


def noise(seed: Column, n: Column, bits: int = 12) -> Column:
    """Number n (from 0, below 2**bits) of the generator that starts at ``seed``, from -3 to 3, without those before it: n + 1 steps are
    a product of steps of 1, 2, 4, ... each of which is one multiplication and one addition."""
    a, c, jumps = STEP, ADD, []
    for _ in range(bits + 1):
        jumps.append(F.struct(F.lit(a >> 16).cast("long").alias("high"), F.lit(a & 65535).cast("long").alias("low"), F.lit(c).cast("long").alias("add")))
        a, c = a * a % 2**32, (a * c + c) % 2**32

    def jump(s: Column, j: Column) -> Column:
        return (j["low"] * s + (j["high"] * s).bitwiseAND(65535) * 65536 + j["add"]).bitwiseAND(2**32 - 1)

    steps = F.filter(F.array(*jumps), lambda _, k: shift(n + 1, k).bitwiseAND(1) == 1)
    return (shift(F.aggregate(steps, seed.cast("long"), jump), 16).bitwiseAND(32767) % 7 - 3).cast("int")


def moved(w: DataFrame, sx: Column, sy: Column, seed: Column) -> DataFrame:
    """Windows (plane, y, x, high, wide, w) with cur: the macroblock's samples in a copy of the plane that is moved by (sx, sy), 16 at
    most, with noise over the plane row by row."""

    def sample(v: Column) -> Callable[[Column], Column]:
        def of(i: Column) -> Column:
            r, c = shift(i, 4), i.bitwiseAND(15)
            n = (F.col("y") * TILE + r) * (F.col("wide") * TILE) + F.col("x") * TILE + c
            return clip(F.get(v["w"], (TILE + r - v["sy"]) * WINDOW + TILE + c - v["sx"]) + noise(v["seed"], n)).cast("int")

        return of

    held = F.struct(F.col("w").alias("w"), sx.cast("int").alias("sx"), sy.cast("int").alias("sy"), seed.cast("long").alias("seed"))
    return w.select("*", let(held, lambda v: F.transform(cells(TILE * TILE), sample(v))).alias("cur"))


#: By phase 4 * fy + fx of a quarter sample: two of whole (0), across (1), down (2) and centre (3) samples, each with its step right and down.
PHASES = (
    ((0, 0, 0), (0, 0, 0)), ((0, 0, 0), (1, 0, 0)), ((1, 0, 0), (1, 0, 0)), ((0, 1, 0), (1, 0, 0)),
    ((0, 0, 0), (2, 0, 0)), ((1, 0, 0), (2, 0, 0)), ((1, 0, 0), (3, 0, 0)), ((1, 0, 0), (2, 1, 0)),
    ((2, 0, 0), (2, 0, 0)), ((2, 0, 0), (3, 0, 0)), ((3, 0, 0), (3, 0, 0)), ((3, 0, 0), (2, 1, 0)),
    ((0, 0, 1), (2, 0, 0)), ((2, 0, 0), (1, 0, 1)), ((3, 0, 0), (1, 0, 1)), ((2, 1, 0), (1, 0, 1)),
)


def six(at: Callable[[int], Column]) -> Column:
    """Six-tap sum of the samples from two before to three behind."""
    return at(-2) - 5 * at(-1) + 20 * at(0) + 20 * at(1) - 5 * at(2) + at(3)


def quarter(w: Column, side: int, margin: int, size: int, mx: Column, my: Column) -> Column:
    """The ``size`` by ``size`` samples of a window of ``side`` samples a row that lie (mx, my) quarters from those at (margin, margin).

    Half samples are made once, for one row and column more than the block: across, down, and the centre from unclipped sums across.
    All 16 phases are means of two of them. Vectors reach at most 4 * (margin - 3) quarters."""
    n = size + 1  # places of each kind of sample
    tall = n + 5  # rows of sums across, from two above

    def made(v: Column) -> Column:
        y0, x0 = margin + shift(v["my"], 2), margin + shift(v["mx"], 2)
        place = lambda i, width: (F.floor(i / width).cast("int"), (i % width).cast("int"))
        at = lambda r, c: F.get(v["w"], (y0 + r) * side + x0 + c)

        def kinds(sums: Column) -> Column:
            whole = F.transform(cells(n * n), lambda i: at(*place(i, n)))
            across = F.transform(cells(n * n), lambda i: clip(shift(F.get(sums, i + 2 * n) + 16, 5)))
            down = F.transform(cells(n * n), lambda i: (lambda r, c: clip(shift(six(lambda k: at(r + k, c)) + 16, 5)))(*place(i, n)))
            centre = F.transform(cells(n * n), lambda i: clip(shift(six(lambda k: F.get(sums, i + (2 + k) * n)) + 512, 10)))
            return F.array(whole, across, down, centre)

        sums = F.transform(cells(tall * n), lambda i: (lambda r, c: six(lambda k: at(r - 2, c + k)))(*place(i, n)))
        table = F.array(*[F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(dy * n + dx).alias("step")) for k, dx, dy in pair]) for pair in PHASES])
        phase = F.get(table, v["my"].bitwiseAND(3) * 4 + v["mx"].bitwiseAND(3))

        def mean(s: Column) -> Column:
            one = lambda k, i: F.get(F.get(s["kinds"], F.get(s["phase"], F.lit(k))["kind"]), i + F.get(s["phase"], F.lit(k))["step"])
            return F.transform(cells(size * size), lambda i: let(F.floor(i / size).cast("int") * n + i % size, lambda p: shift(one(0, p) + one(1, p) + 1, 1)).cast("int"))

        return let(F.struct(let(sums, kinds).alias("kinds"), phase.alias("phase")), mean)

    return let(F.struct(w.alias("w"), mx.cast("int").alias("mx"), my.cast("int").alias("my")), made)


def padded(v: Column, side: int, margin: int) -> Column:
    """A block of ``side`` samples a row with its border repeated ``margin`` times."""
    wide = side + 2 * margin
    near = lambda i: clip(i - margin, 0, side - 1)
    return let(v, lambda b: F.transform(cells(wide * wide), lambda i: F.get(b, (near(F.floor(i / wide)) * side + near(i % wide)).cast("int"))))


#: The two-dimensional Hadamard transform of a 4x4 block as one matrix, row by row.
_H = ((1, 1, 1, 1), (1, 1, -1, -1), (1, -1, -1, 1), (1, -1, 1, -1))
HADAMARD = [_H[i][y] * _H[j][x] for i in range(4) for j in range(4) for y in range(4) for x in range(4)]


def macroblock(w: Column, dx: Column, dy: Column) -> Column:
    """The 16 by 16 samples of a window that lie (dx, dy) from its middle, 16 at most."""
    held = F.struct(w.alias("w"), dx.cast("int").alias("dx"), dy.cast("int").alias("dy"))
    return let(held, lambda v: F.transform(cells(TILE * TILE), lambda i: F.get(v["w"], (TILE + shift(i, 4) + v["dy"]) * WINDOW + TILE + i.bitwiseAND(15) + v["dx"])))


def sad16(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v)


def satd16(a: Column, b: Column) -> Column:
    """Sum over the sixteen 4x4 blocks of a difference of half the magnitudes of its transform, rounded up."""
    part = lambda d, k: F.transform(cells(TILE), lambda i: F.get(d, (shift(k, 2) * 4 + shift(i, 2)) * TILE + k.bitwiseAND(3) * 4 + i.bitwiseAND(3)))
    matrix = constants(HADAMARD)
    value = lambda p, k: F.abs(F.aggregate(cells(TILE), F.lit(0), lambda s, i: s + F.get(matrix, k * TILE + i) * F.get(p, i)))
    cost = lambda p: shift(F.aggregate(cells(TILE), F.lit(0), lambda s, k: s + value(p, k)) + 1, 1)
    return let(F.zip_with(a, b, lambda p, q: p - q), lambda d: F.aggregate(cells(TILE), F.lit(0), lambda s, k: s + let(part(d, k), cost)))
