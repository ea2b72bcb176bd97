"""H.264 parameter sets and slice headers: one list of fields serves both for writing and for reading.

A header is read field by field from a text of zeros and ones, a projection each, so that conditions can name fields read before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.functions import binary as B
from lumenflow.functions import scalar as S

#: (name, kind, condition): kind is ue, se, or u with a width, which may be an expression over fields.
Field = tuple[str, str, str]

SPS: list[Field] = [
    ("profile_idc", "u8", ""), ("constraints", "u8", ""), ("level_idc", "u8", ""), ("sps_id", "ue", ""), ("log2_max_frame_num_minus4", "ue", ""), ("poc_type", "ue", ""), ("log2_max_poc_lsb_minus4", "ue", "poc_type = 0"),
    ("max_num_ref_frames", "ue", ""), ("gaps_allowed", "u1", ""), ("width_mbs_minus1", "ue", ""), ("height_units_minus1", "ue", ""), ("frame_mbs_only", "u1", ""), ("mb_adaptive", "u1", "frame_mbs_only = 0"), ("direct_8x8", "u1", ""),
    ("cropping", "u1", ""), ("crop_left", "ue", "cropping = 1"), ("crop_right", "ue", "cropping = 1"), ("crop_top", "ue", "cropping = 1"), ("crop_bottom", "ue", "cropping = 1"), ("vui", "u1", ""),
]
PPS: list[Field] = [
    ("pps_id", "ue", ""), ("pps_sps_id", "ue", ""), ("cabac", "u1", ""), ("bottom_field_order", "u1", ""), ("slice_groups_minus1", "ue", ""), ("num_ref_l0_minus1", "ue", ""), ("num_ref_l1_minus1", "ue", ""), ("weighted_pred", "u1", ""), ("weighted_bipred", "u2", ""),
    ("init_qp_minus26", "se", ""), ("init_qs_minus26", "se", ""), ("chroma_qp_offset", "se", ""), ("deblocking_control", "u1", ""), ("constrained_intra", "u1", ""), ("redundant_pic", "u1", ""),
]
#: Needs the fields of its parameter sets and of its NAL unit (type_id, ref_idc) beside it.
SLICE: list[Field] = [
    ("first_mb", "ue", ""), ("slice_type", "ue", ""), ("slice_pps_id", "ue", ""), ("frame_num", "u(log2_max_frame_num_minus4 + 4)", ""), ("idr_pic_id", "ue", "type_id = 5"), ("poc_lsb", "u(log2_max_poc_lsb_minus4 + 4)", "poc_type = 0"),
    ("num_ref_override", "u1", "slice_type % 5 = 0"), ("slice_num_ref_minus1", "ue", "num_ref_override = 1"), ("reordering", "u1", "slice_type % 5 = 0"), ("no_output", "u1", "ref_idc > 0 and type_id = 5"), ("long_term", "u1", "ref_idc > 0 and type_id = 5"),
    ("adaptive_marking", "u1", "ref_idc > 0 and type_id <> 5"), ("qp_delta", "se", ""), ("disable_deblocking", "ue", "deblocking_control = 1"), ("alpha_offset_div2", "se", "deblocking_control = 1 and disable_deblocking <> 1"), ("beta_offset_div2", "se", "deblocking_control = 1 and disable_deblocking <> 1"),
]
#: What is not read further, by header.
REFUSED = {"sps": "profile_idc >= 100 or poc_type = 1", "pps": "slice_groups_minus1 > 0", "slice": "reordering = 1 or adaptive_marking = 1 or (weighted_pred = 1 and slice_type % 5 = 0)"}


def bits_of(content: Column) -> Column:
    """Bytes as a text of zeros and ones."""
    out = F.translate(F.hex(content), "0123456789ABCDEF", "abcdefghijklmnop")
    for i in range(16):  # letters, so that no digit is replaced twice
        out = F.replace(out, F.lit("abcdefghijklmnop"[i]), F.lit(f"{i:04b}"))
    return out


def _width(kind: str) -> Column:
    return F.lit(int(kind[1:])) if kind[1:].isdigit() else F.expr(kind[1:]).cast("int")


def read(rows: DataFrame, bits: str, fields: list[Field], refused: str = "false") -> DataFrame:
    """``rows`` with a column for each field, ``rest`` for the bits behind them, and ``error`` where bits are missing or the header
    is of a refused kind. Fields whose condition fails are null."""
    rows = rows.withColumn("rest", F.col(bits)).withColumn("missing", F.lit(False))
    for name, kind, condition in fields:
        rest, on = F.col("rest"), F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)
        if kind in ("ue", "se"):
            zeros = F.length(rest) - F.length(F.ltrim(rest, F.lit("0")))
            value, used = S.ue_value(rest), 2 * zeros + 1
            value = S.from_se(value) if kind == "se" else value
        else:
            used = _width(kind)
            value = F.when(F.length(rest) >= used, F.conv(F.call_function("substring", rest, F.lit(1), used), 2, 10).cast("long"))
        rows = rows.withColumn("_v", F.when(on, value)).withColumn("missing", F.col("missing") | (on & F.col("_v").isNull()))
        rows = rows.withColumn("rest", F.when(on, F.call_function("substring", rest, used + 1, F.length(rest))).otherwise(rest)).withColumnRenamed("_v", name)
    return rows.withColumn("error", F.when(F.col("missing"), "too short").when(F.coalesce(F.expr(refused), F.lit(False)), "not supported")).drop("missing")


def write(fields: list[Field]) -> Column:
    """Bytes of a header of columns named like its fields, closed by a one and zeros."""
    parts = []
    for name, kind, condition in fields:
        v = F.col(name).cast("long")
        code = S.ue_text(v) if kind == "ue" else S.ue_text(S.se_number(v)) if kind == "se" else F.lpad(F.bin(v), _width(kind), F.lit("0"))
        parts.append(F.when(F.coalesce(F.expr(condition), F.lit(False)), code).otherwise("") if condition else code)
    return B.bits_to_bytes(F.concat(*parts, F.lit("1")), "0")


def sizes(rows: DataFrame) -> DataFrame:
    """Macroblock grid, coded and displayed size of rows with SPS fields."""
    high = (2 - F.col("frame_mbs_only")) * (F.col("height_units_minus1") + 1)
    crop = lambda a, b: 2 * (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    rows = rows.withColumns({"mb_width": F.col("width_mbs_minus1") + 1, "mb_height": high})
    return rows.withColumns({
        "coded_width": F.col("mb_width") * 16, "coded_height": F.col("mb_height") * 16, "width": F.col("mb_width") * 16 - crop(F.col("crop_left"), F.col("crop_right")),
        "height": F.col("mb_height") * 16 - (2 - F.col("frame_mbs_only")) * crop(F.col("crop_top"), F.col("crop_bottom")),
    })


def parameter_sets(nals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SPS and PPS rows of NAL units (path, idx, type_id, rbsp) from ``sources.containers.annexb``."""
    of = lambda t: nals.filter(F.col("type_id") == t).select("path", "idx", bits_of(F.col("rbsp")).alias("bits"))
    return sizes(read(of(7), "bits", SPS, REFUSED["sps"])), read(of(8), "bits", PPS, REFUSED["pps"])


def slices(nals: DataFrame) -> DataFrame:
    """Slice headers with the latest parameter sets before them in their stream, whatever their ids; a set that cannot be read
    leaves the slices after it without one (error)."""
    from pyspark.sql import Window

    sps, pps = parameter_sets(nals)
    names = {"s": [f for f, _, _ in SPS] + ["error"], "p": [f for f, _, _ in PPS] + ["error"]}
    sets = [x.select("path", "idx", F.struct(*names[k]).alias(k)) for k, x in (("s", sps), ("p", pps))]
    rows = nals.join(sets[0], ["path", "idx"], "left").join(sets[1], ["path", "idx"], "left")
    w = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.last(k, ignorenulls=True).over(w) for k in ("s", "p")}).filter("type_id in (1, 5)")
    rows = rows.select("path", "idx", "type_id", "ref_idc", "rbsp", *[F.col(f"{k}.{f}").alias(f if f != "error" else f"{k}_error") for k in ("s", "p") for f in names[k]])
    lost = F.col("s_error").isNotNull() | F.col("p_error").isNotNull() | F.col("profile_idc").isNull() | F.col("pps_id").isNull()
    out = read(rows.withColumn("bits", bits_of(F.col("rbsp"))), "bits", SLICE, REFUSED["slice"])
    return out.withColumn("error", F.when(lost, "no parameter set").otherwise(F.col("error"))).withColumn("qp", 26 + F.col("init_qp_minus26") + F.col("qp_delta")).drop("bits", "s_error", "p_error")
