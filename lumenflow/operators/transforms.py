"""Block transforms, scans and run lengths as array expressions: a block stays one row."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.functions import dims
from lumenflow.functions.scalar import constants, div, shift


def _cosines(size: int) -> list[list[float]]:
    return [[math.cos((2 * x + 1) * u * math.pi / (2 * size)) * math.sqrt((1 if u == 0 else 2) / size) for x in range(size)] for u in range(size)]


def cosine_line(r: list[Column]) -> list[Column]:
    """Cosine transform of a line of samples."""
    return [total([x * F.lit(c) for x, c in zip(r, row, strict=True)]) for row in _cosines(len(r))]


def inverse_cosine_line(r: list[Column]) -> list[Column]:
    """Samples of a line of coefficients."""
    return [total([x * F.lit(row[k]) for x, row in zip(r, _cosines(len(r)), strict=True)]) for k in range(len(r))]


def _square(df: DataFrame, array: str, line, keep: list[str], size: int) -> DataFrame:
    """A function of a line along the rows of a square array column, then along its columns. The line is written out once and mapped
    over rows, which keeps expressions small. Each projection names the one before it several times, so that they stay apart and
    nothing is computed again."""
    along = lambda rows: F.transform(rows, lambda r: F.array(*line([F.get(r, F.lit(x)) for x in range(size)])))
    turned = lambda rows: F.array(*[F.transform(rows, (lambda j: lambda r: F.get(r, F.lit(j)))(j)) for j in range(size)])
    across = df.select(*keep, along(F.array(*[F.slice(array, i * size + 1, size) for i in range(size)])).alias(array))
    return across.select(*keep, along(turned(array)).alias(array)).select(*keep, F.flatten(turned(array)).alias(array))


def dct(df: DataFrame, array: str, keep: list[str], size: int = 8) -> DataFrame:
    """Cosine transform of blocks of level-shifted samples, row by row in one array column: no rows are made of samples, and nothing
    is shuffled. Entry v * size + u of the result has vertical frequency v."""
    return _square(df, array, cosine_line, keep, size)


def idct(df: DataFrame, array: str, keep: list[str], size: int = 8) -> DataFrame:
    """The inverse of :func:`dct`, before rounding."""
    return _square(df, array, inverse_cosine_line, keep, size)


def permute(array: str, order: list[int]) -> Column:
    """The entries of an array in another order. It is named once for each entry: in a lambda it would stand once, and the optimizer would
    move what computes it inside, to be computed again for each entry."""
    return F.expr("array(" + ", ".join(f"get({array}, {i})" for i in order) + ")")


def zigzag(array: str, size: int = 8) -> Column:
    return permute(array, dims.zigzag(size))


def unzigzag(array: str, size: int = 8) -> Column:
    order = dims.zigzag(size)
    return permute(array, [order.index(i) for i in range(size * size)])


def run_symbols(df: DataFrame, array: str, keep: list[str], last: int = 63) -> DataFrame:
    """(keep, symbols) of scanned coefficients in one array; symbols is an array of (pos, k, run, value): the zeros before each value, a run of
    15 with value 0 for every sixteen zeros (k counts them), and (0, 0) at the end unless the last coefficient has a value."""
    at = F.filter(F.sequence(F.lit(1), F.lit(last)), lambda i: F.get(F.col(array), i) != 0)
    rows = df.select(*keep, F.col(array).alias("_z"), at.alias("_at"))
    rows = rows.select("*", F.slice(F.concat(F.array(F.lit(0)), "_at"), 1, F.size("_at")).alias("_before"))
    symbol = lambda pos, k, run, value: F.struct(pos.cast("int").alias("pos"), k.cast("int").alias("k"), run.cast("int").alias("run"), value.cast("int").alias("value"))

    def of(pos: Column, before: Column) -> Column:
        run = pos - before - 1
        final = div(run, 16).cast("int")
        return F.transform(F.sequence(F.lit(0), final), lambda k: symbol(pos, k, F.when(k == final, run % 16).otherwise(15), F.when(k == final, F.get(F.col("_z"), pos)).otherwise(0)))

    zero = F.lit(0)
    end = F.filter(F.array(symbol(F.lit(last + 1), zero, zero, zero)), lambda _: F.coalesce(F.array_max("_at"), F.lit(0)) < last)
    return rows.select(*keep, F.concat(F.flatten(F.zip_with("_at", "_before", of)), end).alias("symbols"))


def run_values(symbols: str) -> Column:
    """The (pos, value) that an array of symbols (pos, k, run, value) places: the inverse of :func:`run_symbols`, from runs alone."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,value:int>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        at = acc["at"] + e["run"] + 1
        return F.struct(at.alias("at"), F.when(e["value"] == 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(at.alias("pos"), e["value"].alias("value"))))).alias("out"))

    return F.aggregate(symbols, start, step, lambda acc: acc["out"])


def both_ways(df: DataFrame, array: str, line, keep: list[str]) -> DataFrame:
    """A function of four values along the rows of a 4x4 array column, then along its columns."""
    return _square(df, array, line, keep, 4)


def forward4(r: list[Column]) -> list[Column]:
    """H.264 core transform of four samples."""
    a, b, c, d = r[0] + r[3], r[1] + r[2], r[1] - r[2], r[0] - r[3]
    return [a + b, 2 * d + c, a - b, d - 2 * c]


def inverse4(r: list[Column]) -> list[Column]:
    """H.264 inverse core transform of four values; halves are shifted, so that the order of rows and columns matters."""
    e, f, g, h = r[0] + r[2], r[0] - r[2], shift(r[1], 1) - r[3], r[1] + shift(r[3], 1)
    return [e + h, f + g, f - g, e - h]


def hadamard4(r: list[Column]) -> list[Column]:
    a, b, c, d = r[0] + r[2], r[0] - r[2], r[1] - r[3], r[1] + r[3]
    return [a + d, b + c, b - c, a - d]


def _by_place(table) -> list[int]:
    """An entry for each place of a 4x4 block: even rows and columns, odd ones, mixed."""
    even, odd, mixed = table
    return [even if y % 2 == x % 2 == 0 else odd if y % 2 == x % 2 == 1 else mixed for y in range(4) for x in range(4)]


def quantized4(array: str, qp: int, intra: bool = True) -> Column:
    """Levels of a transformed 4x4 block at one parameter, rounded by a third of a step, or by a sixth."""
    bits = 15 + qp // 6
    f = (1 << bits) // (3 if intra else 6)
    return F.zip_with(array, constants(_by_place(dims.FORWARD[qp % 6])), lambda w, m: F.when(w < 0, -shift(F.abs(w).cast("long") * m + f, bits)).otherwise(shift(w.cast("long") * m + f, bits)))


def dequantized4(array: str, qp: int) -> Column:
    return F.zip_with(array, constants([s << qp // 6 for s in _by_place(dims.LEVEL_SCALE[qp % 6])]), lambda level, s: level * s)


def residual4(df: DataFrame, array: str, keep: list[str]) -> DataFrame:
    """Inverse transform of dequantised 4x4 values, rounded down by 64."""
    return both_ways(df, array, inverse4, keep).withColumn(array, F.transform(array, lambda v: shift(v + 32, 6)))


def satd(array: str) -> Column:
    """Half the sum of magnitudes, rounded up, of a transformed difference."""
    return shift(F.aggregate(array, F.lit(0), lambda s, v: s + F.abs(v)) + 1, 1)


def luma_dc(df: DataFrame, array: str, qp: int, keep: list[str]) -> DataFrame:
    """Hadamard transform and scaling of the 16 luma DC values of a macroblock."""
    scale, s = dims.LEVEL_SCALE[qp % 6][0], qp // 6
    put = (lambda v: F.call_function("shiftleft", v * scale, F.lit(s - 2))) if s >= 2 else (lambda v: shift(v * scale + (1 << (1 - s)), 2 - s))
    return both_ways(df, array, hadamard4, keep).withColumn(array, F.transform(array, put))


def chroma_dc(a: Column, b: Column, c: Column, d: Column, qp: int) -> list[Column]:
    scale, s = dims.LEVEL_SCALE[qp % 6][0], qp // 6
    sums = [a + b + c + d, a - b + c - d, a + b - c - d, a - b - c + d]
    return [shift(F.call_function("shiftleft", v * scale, F.lit(s)), 5) for v in sums]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
