"""Residual blocks as H.264 CAVLC text and back.

Encoding is columns over blocks that stay one row: words of fixed tables are array entries, the suffix length is folded over at most
sixteen levels. Decoding runs over Arrow batches. A text is a string of 0 and 1; ``functions.binary`` packs it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.functions.scalar import pick


# The words of coeff_token, length:code, a row for each total of coefficients, by trailing ones from none to three.
TOKENS = {
    # nC 0 and 1
    0: """1:1
    6:5 2:1
    8:7 6:4 3:1
    9:7 8:6 7:5 5:3
    10:7 9:6 8:5 6:3
    11:7 10:6 9:5 7:4
    13:15 11:6 10:5 8:4
    13:11 13:14 11:5 9:4
    13:8 13:10 13:13 10:4
    14:15 14:14 13:9 11:4
    14:11 14:10 14:13 13:12
    15:15 15:14 14:9 14:12
    15:11 15:10 15:13 14:8
    16:15 15:1 15:9 15:12
    16:11 16:14 16:13 15:8
    16:7 16:10 16:9 16:12
    16:4 16:6 16:5 16:8""",
    # nC 2 and 3
    2: """2:3
    6:11 2:2
    6:7 5:7 3:3
    7:7 6:10 6:9 4:5
    8:7 6:6 6:5 4:4
    8:4 7:6 7:5 5:6
    9:7 8:6 8:5 6:8
    11:15 9:6 9:5 6:4
    11:11 11:14 11:13 7:4
    12:15 11:10 11:9 9:4
    12:11 12:14 12:13 11:12
    12:8 12:10 12:9 11:8
    13:15 13:14 13:13 12:12
    13:11 13:10 13:9 13:12
    13:7 14:11 13:6 13:8
    14:9 14:8 14:10 13:1
    14:7 14:6 14:5 14:4""",
    # nC 4 to 7
    4: """4:15
    6:15 4:14
    6:11 5:15 4:13
    6:8 5:12 5:14 4:12
    7:15 5:10 5:11 4:11
    7:11 5:8 5:9 4:10
    7:9 6:14 6:13 4:9
    7:8 6:10 6:9 4:8
    8:15 7:14 7:13 5:13
    8:11 8:14 7:10 6:12
    9:15 8:10 8:13 7:12
    9:11 9:14 8:9 8:12
    9:8 9:10 9:13 8:8
    10:13 9:7 9:9 9:12
    10:9 10:12 10:11 10:10
    10:5 10:8 10:7 10:6
    10:1 10:4 10:3 10:2""",
    # the four DC values of chroma
    -1: """2:1
    6:7 1:1
    6:4 6:6 3:1
    6:3 7:3 7:2 6:5
    6:2 8:3 8:2 7:0""",
}
# The words of total_zeros, a row for each total of coefficients from 1, by zeros.
ZEROS = """1:1 3:3 3:2 4:3 4:2 5:3 5:2 6:3 6:2 7:3 7:2 8:3 8:2 9:3 9:2 9:1
    3:7 3:6 3:5 3:4 3:3 4:5 4:4 4:3 4:2 5:3 5:2 6:3 6:2 6:1 6:0
    4:5 3:7 3:6 3:5 4:4 4:3 3:4 3:3 4:2 5:3 5:2 6:1 5:1 6:0
    5:3 3:7 4:5 4:4 3:6 3:5 3:4 4:3 3:3 4:2 5:2 5:1 5:0
    4:5 4:4 4:3 3:7 3:6 3:5 3:4 3:3 4:2 5:1 4:1 5:0
    6:1 5:1 3:7 3:6 3:5 3:4 3:3 3:2 4:1 3:1 6:0
    6:1 5:1 3:5 3:4 3:3 2:3 3:2 4:1 3:1 6:0
    6:1 4:1 5:1 3:3 2:3 2:2 3:2 3:1 6:0
    6:1 6:0 4:1 2:3 2:2 3:1 2:1 5:1
    5:1 5:0 3:1 2:3 2:2 2:1 4:1
    4:0 4:1 3:1 3:2 1:1 3:3
    4:0 4:1 2:1 1:1 3:1
    3:0 3:1 1:1 2:1
    2:0 2:1 1:1
    1:0 1:1"""
CHROMA_ZEROS = """1:1 2:1 3:1 3:0
    1:1 2:1 2:0
    1:1 1:0"""
# The words of run_before, a row for each count of zeros left, the last for seven and more.
RUNS = """1:1 1:0
    1:1 2:1 2:0
    2:3 2:2 2:1 2:0
    2:3 2:2 2:1 3:1 3:0
    2:3 2:2 3:3 3:2 3:1 3:0
    2:3 3:0 3:1 3:3 3:2 3:5 3:4
    3:7 3:6 3:5 3:4 3:3 3:2 3:1 4:1 5:1 6:1 7:1 8:1 9:1 10:1 11:1"""


def words(table: str) -> list[list[str]]:
    """The words of a table as strings of 0 and 1, row by row."""
    return [[format(int(code), f"0{length}b") for length, code in (w.split(":") for w in row.split())] for row in table.split("\n")]


def token_words(nc: int) -> list[list[str]]:
    """Words by total and trailing ones at a context; from 8 on they have six bits each."""
    if nc >= 8:
        return [["000011"], *([format(4 * (total - 1) + ones, "06b") for ones in range(min(total, 3) + 1)] for total in range(1, 17))]
    return words(TOKENS[nc if nc < 0 else nc // 2 * 2 if nc < 4 else 4])


def _flat(rows: list[list[str]], width: int) -> list[str | None]:
    return [w for row in rows for w in [*row, *[None] * (width - len(row))]]


def _level(code: Column, s: Column) -> Column:
    """The word of a level code at a suffix length: a prefix of zeros, a one and the suffix; beyond prefix 14 the suffix grows."""
    zeros = lambda n: F.repeat(F.lit("0"), n.cast("int"))
    power = F.pow(F.lit(2), s).cast("long")
    far = F.bin(code - F.when(s == 0, 30).otherwise(15 * power) + 4096)
    tail = lambda v, n: F.right(F.concat(F.repeat(F.lit("0"), F.lit(6)), F.bin(v)), n)
    plain = F.when(code < 14, F.concat(zeros(code), F.lit("1"))).when(code < 30, F.concat(F.lit("0" * 14 + "1"), tail(code - 14, F.lit(4))))
    near = F.when(s == 0, plain).when(code < 15 * power, F.concat(zeros(F.floor(code / power)), F.lit("1"), tail(code % power, s)))
    return F.coalesce(near, F.concat(zeros(F.length(far) + 2), F.lit("1"), F.substring(far, 2, 64)))


def encode(df: DataFrame, array: str = "z", nc: str = "nc", keep: list[str] | None = None, chroma: bool = False) -> DataFrame:
    """(keep, total, ones, zeros, token, signs, levels, zero_word, runs, text) of scanned coefficients in ``array``, 16 or, for chroma
    DC, four of them. The parts are texts: their lengths are the bits of each. ``nc`` is not read for chroma DC. A null array gives
    nulls. ``keep`` names the columns that stay, all but the array by default."""
    many = 4 if chroma else 16
    keep = [c for c in df.columns if c != array] if keep is None else keep
    z = F.col(array)
    at = F.filter(F.sequence(F.lit(many - 1), F.lit(0), F.lit(-1)), lambda i: F.get(z, i) != 0)
    rows = df.select(*keep, F.col(nc).alias("_nc") if not chroma else F.lit(-1).alias("_nc"), z.alias("_z"), F.when(z.isNotNull(), at).alias("_at"))
    rows = rows.select("*", F.transform("_at", lambda i: F.get(F.col("_z"), i).cast("long")).alias("_v"), F.when(F.col("_at").isNotNull(), F.size("_at")).alias("total"))
    one = lambda k: F.coalesce(F.abs(F.get("_v", F.lit(k))) == 1, F.lit(False))
    ones = F.when(F.col("total").isNotNull(), F.when(~one(0), 0).when(~one(1), 1).when(~one(2), 2).otherwise(3))
    rows = rows.select("*", ones.alias("ones"), F.when(F.col("total") == 0, 0).otherwise(F.get("_at", F.lit(0)) + 1 - F.col("total")).alias("zeros"))
    total, ones, zeros = F.col("total"), F.col("ones"), F.col("zeros")
    place = total * 4 + ones
    chosen = [pick(_flat(token_words(c), 4), place) for c in ((-1,) if chroma else (0, 2, 4, 8))]
    context = F.col("_nc")
    token = chosen[0] if chroma else F.when(context < 2, chosen[0]).when(context < 4, chosen[1]).when(context < 8, chosen[2]).otherwise(chosen[3])
    signs = F.array_join(F.transform(F.slice("_v", 1, ones), lambda v: F.when(v < 0, "1").otherwise("0")), "")

    def add(acc: Column, v: Column) -> Column:
        code = F.when(v > 0, 2 * v - 2).otherwise(-2 * v - 1) - F.when(acc["first"] & (ones < 3), 2).otherwise(0)
        s = F.greatest(acc["s"], F.lit(1))
        grown = F.when((F.abs(v) > 3 * F.pow(F.lit(2), s - 1)) & (s < 6), s + 1).otherwise(s)
        return F.struct(F.lit(False).alias("first"), grown.alias("s"), F.concat(acc["text"], _level(code, acc["s"])).alias("text"))

    start = F.struct(F.lit(True).alias("first"), F.when((total > 10) & (ones < 3), 1).otherwise(0).alias("s"), F.lit("").alias("text"))
    levels = F.aggregate(F.slice("_v", ones + 1, F.lit(many)), start, add, lambda acc: acc["text"])
    zero_word = F.when((total == 0) | (total == many), "").otherwise(pick(_flat(words(CHROMA_ZEROS if chroma else ZEROS), many), (total - 1) * many + zeros))

    def run(pos: Column, k: Column) -> Column:
        left = pos - (total - 1 - k)
        before = pos - F.get("_at", k + 1) - 1
        return F.when(left > 0, pick(_flat(words(RUNS), 15), (F.least(left, F.lit(7)) - 1) * 15 + before)).otherwise("")

    runs = F.array_join(F.transform(F.slice("_at", 1, F.greatest(total - 1, F.lit(0))), run), "")
    parts = {"token": token, "signs": signs, "levels": levels, "zero_word": zero_word, "runs": runs}
    rows = rows.select(*keep, "total", "ones", "zeros", *[c.alias(n) for n, c in parts.items()])
    return rows.withColumn("text", F.concat(*parts))


def encodable(array: str, nc: Column) -> Column:
    """The guard of a careful encoder: no context from 4 to 7 and no block of four coefficients. What it refuses is sent as an empty
    block. :func:`encode` itself follows the standard's tables and needs no guard."""
    return ~nc.between(4, 7) & (F.size(F.filter(array, lambda v: v != 0)) != 4)


class _Text:
    """Reads words off a text of bits; a text that ends early or has no such word is an error."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def take(self, n: int) -> str:
        out = self.text[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the text ends within a block")
        self.at += n
        return out

    def word(self, table: dict) -> object:
        for n in range(1, 17):
            found = table.get(self.text[self.at : self.at + n])
            if found is not None and self.at + n <= len(self.text):
                self.at += n
                return found
        raise ValueError("no word of the table")


def _inverse(rows: list[list[str]], pairs: bool = False) -> list[dict] | dict:
    if pairs:
        return {w: (i, j) for i, row in enumerate(rows) for j, w in enumerate(row)}
    return [{w: j for j, w in enumerate(row)} for row in rows]


_TOKENS = {c: _inverse(token_words(c), True) for c in (-1, 0, 2, 4, 8)}
_ZEROS, _CHROMA_ZEROS, _RUNS = (_inverse(words(t)) for t in (ZEROS, CHROMA_ZEROS, RUNS))


def _block(bits: _Text, nc: int, many: int) -> list[int]:
    total, ones = bits.word(_TOKENS[-1 if many == 4 else 8 if nc >= 8 else 4 if nc >= 4 else 2 if nc >= 2 else 0])
    out = [0] * many
    if not total:
        return out
    levels = [1 - 2 * int(s) for s in bits.take(ones)]
    s = int(total > 10 and ones < 3)
    while len(levels) < total:
        prefix = 0
        while bits.take(1) == "0":
            prefix += 1
        size = prefix - 3 if prefix >= 15 else 4 if prefix == 14 and s == 0 else s
        code = (min(prefix, 15) << s) + int("0" + bits.take(size), 2)
        if prefix >= 15:
            code += (15 if s == 0 else 0) + (1 << (prefix - 3)) - 4096
        if len(levels) == ones < 3:
            code += 2
        levels.append(-(code + 1) // 2 if code % 2 else code // 2 + 1)
        s = max(s, 1)
        s += int(abs(levels[-1]) > 3 << (s - 1) and s < 6)
    left = bits.word((_CHROMA_ZEROS if many == 4 else _ZEROS)[total - 1]) if total < many else 0
    at = total + left - 1
    for k, v in enumerate(levels):
        if not 0 <= at < many:
            raise ValueError("runs beyond the block")
        out[at] = v
        run = bits.word(_RUNS[min(left, 7) - 1]) if left > 0 and k < total - 1 else 0
        left, at = left - run, at - 1 - run
    return out


def decode(df: DataFrame, id_col: str = "id", text_col: str = "text", nc_col: str = "nc", chroma: bool = False) -> DataFrame:
    """(id, z, used, error): the scanned coefficients at the start of each text and the bits that they took. A damaged text or a null
    gives null and the reason. Ids are integers."""
    many = 4 if chroma else 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, used, error = [], [], []
            for text, nc in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                bits, why, block = _Text(text or ""), None, None
                try:
                    if text is None or nc is None:
                        raise ValueError("nothing to read")
                    block = _block(bits, nc, many)
                except ValueError as e:
                    why = str(e)
                z.append(block)
                used.append(bits.at if block is not None else None)
                error.append(why)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.list_(pa.int32())), pa.array(used, pa.int32()), pa.array(error, pa.string())], ["id", "z", "used", "error"])

    nc = F.lit(-1) if chroma else F.col(nc_col)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), nc.cast("int").alias("nc")).mapInArrow(run, "id long, z array<int>, used int, error string")


def coded_pattern(df: DataFrame, key: list[str], part: str, total: str) -> DataFrame:
    """(key, pattern): a bit for each 8x8 quarter ``part`` of a macroblock that has a coefficient in any of its 4x4 blocks."""
    bit = F.when(F.col(total) > 0, F.call_function("shiftleft", F.lit(1), F.col(part).cast("int"))).otherwise(0)
    return df.groupBy(*key).agg(F.bit_or(bit).alias("pattern"))
