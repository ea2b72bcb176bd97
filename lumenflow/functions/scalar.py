"""Scalar media arithmetic as Spark columns. Rounding is half away from zero; division of integers truncates; shifts keep the sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenflow.functions import dims


def col(c: str | Column | int | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def div(a: Column, b) -> Column:
    """Truncating division of integers."""
    return F.call_function("div", col(a), col(b))


def shift(a: Column, n: int | Column) -> Column:
    return F.call_function("shiftright", col(a), col(n).cast("int"))


def constants(values) -> Column:
    """An array of fixed numbers, texts or nulls: one call, where a literal each would take as many."""
    return F.expr("array(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v) for v in values) + ")")


def pick(values, index: Column) -> Column:
    """An entry of a fixed table; null beyond it."""
    return F.get(constants(values), index.cast("int"))


def clip(v: Column, low=0, high=255) -> Column:
    """v within bounds; also called Clip3, and Clip1 with the default bounds."""
    return F.greatest(col(low), F.least(col(high), v))


def to_byte(v: Column) -> Column:
    return clip(F.round(v)).cast("int")


# Four ways from RGB to luma are in use; they differ in rounding.
def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601 full range, rounded and clipped."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb = -0.168736 * r - 0.331264 * g + 0.5 * b + 128
    cr = 0.5 * r - 0.418688 * g - 0.081312 * b + 128
    return to_byte(y), to_byte(cb), to_byte(cr)


def rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return to_byte(y + 1.402 * (cr - 128)), to_byte(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)), to_byte(y + 1.772 * (cb - 128))


def luma_rounded(r: Column, g: Column, b: Column) -> Column:
    return shift(77 * r + 150 * g + 29 * b + 128, 8)


def luma_truncated(r: Column, g: Column, b: Column) -> Column:
    return shift(77 * r + 150 * g + 29 * b, 8)


def limited(y: Column) -> Column:
    """A full-range sample as it is stored in limited range, from 16 to 235."""
    return to_byte(16 + y * 219 / 255.0)


def stretched(y: Column) -> Column:
    """A limited-range sample as it is shown, from 0 to 255."""
    return to_byte((y - 16) * 255 / 219.0)


def luma_half_up(r: Column, g: Column, b: Column) -> Column:
    return F.floor(clip(0.299 * r + 0.587 * g + 0.114 * b + 0.5)).cast("int")


def luma_709(r: Column, g: Column, b: Column) -> Column:
    return to_byte(0.2126 * r + 0.7152 * g + 0.0722 * b)


def scaled_step(step: Column, quality: int | Column) -> Column:
    """A quantisation step at a quality from 1 to 100, in integers."""
    q = clip(col(quality), 1, 100)
    scale = F.when(q < 50, div(F.lit(5000), q)).otherwise(200 - 2 * q)
    return clip(div(step * scale + 50, 100), 1, 255).cast("int")


def scaled(step: int, quality: int) -> int:
    """:func:`scaled_step` of plain numbers."""
    q = max(1, min(100, quality))
    return max(1, min(255, (step * (5000 // q if q < 50 else 200 - 2 * q) + 50) // 100))


def quantize(coefficient: Column, step: Column) -> Column:
    return F.round(coefficient / step).cast("long")


def category(v: Column) -> Column:
    """Bits of |v|; 0 has none."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("long"))))


def magnitude_bits(v: Column) -> Column:
    """The bits after the category: v, or its ones' complement below zero."""
    return F.when(v >= 0, v).otherwise(v + F.call_function("shiftleft", F.lit(1).cast("long"), category(v)) - 1)


def from_magnitude(bits: Column, size: Column) -> Column:
    """Inverse of :func:`magnitude_bits`."""
    half = F.call_function("shiftleft", F.lit(1).cast("long"), (size - 1).cast("int"))
    return F.when(size == 0, 0).when(bits < half, bits - 2 * half + 1).otherwise(bits)


def ue_text(k: Column) -> Column:
    """Exp-Golomb code of an unsigned number, as text of zeros and ones."""
    b = F.bin((k + 1).cast("long"))
    return F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b)


def ue_length(k: Column) -> Column:
    return 2 * F.length(F.bin((k + 1).cast("long"))) - 1


def se_number(v: Column) -> Column:
    """Code number of a signed value: 0, 1, -1, 2, -2 and so on."""
    return F.when(v > 0, 2 * v - 1).otherwise(-2 * v)


def from_se(k: Column) -> Column:
    return F.when(k % 2 == 1, div(k + 1, 2)).otherwise(-div(k, 2))


def ue_value(text: Column) -> Column:
    """Value of the Exp-Golomb code that a text of bits begins with; null if it ends too early."""
    zeros = F.length(text) - F.length(F.ltrim(text, F.lit("0")))
    code = F.call_function("substring", text, zeros + 1, zeros + 1)
    return F.when(F.length(code) == zeros + 1, F.conv(code, 2, 10).cast("long") - 1)


def psnr(mse: Column, at_zero=float("inf")) -> Column:
    return F.when(mse == 0, F.lit(at_zero)).otherwise(10 * F.log10(65025 / mse))


def bits_per_pixel(bitrate: Column, width: Column, height: Column, fps: Column) -> Column:
    return bitrate / (width * height * fps)


def macroblock(address: Column, width: Column) -> tuple[Column, Column]:
    """(x, y) of a raster address; pixels are 16 times as far."""
    return F.pmod(address, width), div(address, width)


def slice_kind(slice_type: Column) -> Column:
    return pick(("P", "B", "I", "SP", "SI"), slice_type % 5)


def intra16_parts(mb_type: Column) -> tuple[Column, Column, Column]:
    """(prediction mode, chroma pattern, luma pattern) of mb_type 1 to 24."""
    t = mb_type - 1
    return t % 4, div(t, 4) % 3, F.when(t >= 12, 15).otherwise(0)


def mb_class_i(mb_type: Column) -> Column:
    return F.when(mb_type == 0, "I4x4").when(mb_type <= 24, "I16x16").when(mb_type == 25, "IPCM").otherwise("invalid")


def mb_class_p(mb_type: Column) -> Column:
    return F.when(mb_type <= 4, "P").otherwise(mb_class_i(mb_type - 5))


def coded_block_pattern(code: Column, intra: bool) -> Column:
    return F.coalesce(pick(dims.CBP_INTRA if intra else dims.CBP_INTER, code), F.lit(0))


def cbp_code(cbp: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in dims.CBP_INTRA]), cbp) - 1


def chroma_qp(qp: Column, offset: int = 0) -> Column:
    q = clip(qp + offset, 0, 51)
    return F.when(q < 30, q).otherwise(pick(dims.CHROMA_QP, q - 30))


def place_class(i: Column, j: Column) -> Column:
    """0 for even rows and columns, 1 for odd ones, 2 for mixed places of a 4x4 block."""
    return F.when((i % 2 == 0) & (j % 2 == 0), 0).when((i % 2 == 1) & (j % 2 == 1), 1).otherwise(2)


def _by_qp(table, qp: Column, kind: Column) -> Column:
    return pick([v for row in table for v in row], (qp % 6) * 3 + kind)


def h264_dequantize(level: Column, qp: Column, kind: Column) -> Column:
    return F.call_function("shiftleft", level * _by_qp(dims.LEVEL_SCALE, qp, kind), div(qp, 6).cast("int"))


def h264_quantize(w: Column, qp: Column, kind: Column, intra: bool = True) -> Column:
    """Sign of w times (|w| * multiplier + a third, or a sixth, of the divisor) shifted down."""
    bits = (div(qp, 6) + 15).cast("int")
    f = div(F.call_function("shiftleft", F.lit(1).cast("long"), bits), 3 if intra else 6)
    return (F.signum(w.cast("double")).cast("long")) * shift(F.abs(w).cast("long") * _by_qp(dims.FORWARD, qp, kind) + f, bits)


def median3(a: Column, b: Column, c: Column) -> Column:
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c)


def vector_cost(x: Column, y: Column) -> Column:
    return F.abs(x) + F.abs(y)


def bits_at_qp(complexity: Column, qp: Column) -> Column:
    """Bits of a frame: halved by every six steps of the parameter above 28."""
    return F.floor(complexity * F.pow(F.lit(2.0), -(qp - 28) / 6.0)).cast("long")


def boundary_strength(intra: Column, edge_of_macroblock: Column, coded: Column, other_reference: Column, mv_gap: Column) -> Column:
    """Deblocking strength of an edge; mv_gap in quarter samples."""
    return F.when(intra & edge_of_macroblock, 4).when(intra, 3).when(coded, 2).when(other_reference | (mv_gap >= 4), 1).otherwise(0)


def filter_samples(strength: Column, p0: Column, p1: Column, q0: Column, q1: Column, alpha: Column, beta: Column) -> Column:
    return (strength > 0) & (F.abs(p0 - q0) < alpha) & (F.abs(p1 - p0) < beta) & (F.abs(q1 - q0) < beta)


def coefficient_context(left: Column, top: Column) -> Column:
    """nC from the counts of two neighbours, null where a neighbour is missing."""
    return F.when(left.isNotNull() & top.isNotNull(), shift(left + top + 1, 1)).otherwise(F.coalesce(left, top, F.lit(0)))


def intra4_allowed(mode: Column, left: Column, top: Column) -> Column:
    """Whether a 4x4 prediction mode has the neighbours it reads."""
    return F.when(mode.isin(0, 3, 7), top).when(mode.isin(1, 8), left).when(mode == 2, F.lit(True)).otherwise(left & top)


def big_endian16(content: Column, at: Column) -> Column:
    """Two bytes from a place that counts from 0."""
    return F.conv(F.hex(F.call_function("substring", content, at + 1, F.lit(2))), 16, 10).cast("long")


def little_endian32(content: Column, at: Column) -> Column:
    b = [F.conv(F.hex(F.call_function("substring", content, at + k + 1, F.lit(1))), 16, 10).cast("long") for k in range(4)]
    return b[0] + b[1] * 256 + b[2] * 65536 + b[3] * 16777216
