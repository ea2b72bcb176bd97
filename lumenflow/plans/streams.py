"""H.264 headers: parts of the catalogue are streams of a parameter set of each kind and two slices, written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.operators import headers as H
from lumenflow.operators import tables as T
from lumenflow.sources import containers, sinks

C = F.col


def _stream(spark, d):
    p = T.read(spark, d, "part").select(C("p_partkey").cast("string").alias("path"), C("p_partkey").alias("k"), "p_size")
    sps = {"profile_idc": F.lit(66), "constraints": F.lit(0), "level_idc": F.lit(30), "sps_id": F.lit(0), "log2_max_frame_num_minus4": C("k") % 5, "poc_type": F.when(C("k") % 3 == 0, 2).otherwise(0), "log2_max_poc_lsb_minus4": C("k") % 4, "max_num_ref_frames": F.lit(1)}
    sps |= {"gaps_allowed": F.lit(0), "width_mbs_minus1": C("p_size"), "height_units_minus1": C("k") % 40, "frame_mbs_only": F.lit(1), "mb_adaptive": F.lit(0), "direct_8x8": F.lit(1), "cropping": C("k") % 2, "crop_left": F.lit(0), "crop_right": C("k") % 7, "crop_top": F.lit(0), "crop_bottom": C("k") % 5, "vui": F.lit(0)}
    pps = {f: F.lit(0) for f, _, _ in H.PPS} | {"init_qp_minus26": C("k") % 21 - 10, "chroma_qp_offset": C("k") % 5 - 2, "deblocking_control": C("k") % 2}
    head = {f: F.lit(0) for f, _, _ in H.SLICE} | {"slice_type": F.when(C("type_id") == 5, 7).otherwise(0), "frame_num": C("k") % 16, "idr_pic_id": C("k") % 9, "poc_lsb": C("k") % 16, "qp_delta": C("p_size") % 9 - 4, "disable_deblocking": C("k") % 3, "alpha_offset_div2": C("k") % 5 - 2}
    rows = p.withColumns(sps | pps).withColumn("type_id", F.explode(F.array(*[F.lit(t) for t in (7, 8, 5, 1)]))).withColumn("ref_idc", F.when(C("type_id") == 1, 0).otherwise(3)).withColumns(head)
    idx = F.array_position(F.array(*[F.lit(t) for t in (7, 8, 5, 1)]), C("type_id")) - 1
    rbsp = F.when(C("type_id") == 7, H.write(H.SPS)).when(C("type_id") == 8, H.write(H.PPS)).otherwise(H.write(H.SLICE))
    return containers.annexb(sinks.annexb(rows.select("path", idx.alias("idx"), "ref_idc", "type_id", rbsp.alias("rbsp"))))


def parameter_sets(spark, d):
    """Sizes and parameters that sequence parameter sets give."""
    sps, _ = H.parameter_sets(_stream(spark, d))
    return sps.select(C("path").cast("long").alias("k"), "level_idc", "poc_type", C("log2_max_poc_lsb_minus4").alias("poc_bits"), "mb_width", "mb_height", "width", "height", F.coalesce("error", F.lit("")).alias("error"))


SETS = """SELECT p_partkey AS k, 30::BIGINT AS level_idc, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS poc_type, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 4 END AS poc_bits, p_size::BIGINT + 1 AS mb_width, p_partkey % 40 + 1 AS mb_height,
(p_size::BIGINT + 1) * 16 - CASE WHEN p_partkey % 2 = 1 THEN 2 * (p_partkey % 7) ELSE 0 END AS width, (p_partkey % 40 + 1) * 16 - CASE WHEN p_partkey % 2 = 1 THEN 2 * (p_partkey % 5) ELSE 0 END AS height, '' AS error FROM part"""


def slices(spark, d):
    """Slice headers read with the parameter sets before them."""
    s = H.slices(_stream(spark, d))
    return s.select(C("path").cast("long").alias("k"), "idx", "slice_type", "frame_num", "idr_pic_id", "poc_lsb", "qp", "disable_deblocking", C("alpha_offset_div2").alias("alpha"), F.coalesce("error", F.lit("")).alias("error"))


SLICES = """SELECT p_partkey AS k, i AS idx, CASE i WHEN 2 THEN 7 ELSE 0 END::BIGINT AS slice_type, p_partkey % 16 AS frame_num, CASE i WHEN 2 THEN p_partkey % 9 END AS idr_pic_id, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 16 END AS poc_lsb,
26 + p_partkey % 21 - 10 + p_size % 9 - 4 AS qp, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 3 END AS disable_deblocking, CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 <> 1 THEN p_partkey % 5 - 2 END AS alpha, '' AS error
FROM part, (SELECT CAST(unnest([2, 3]) AS INT) AS i)"""

QUERIES = {"h264_parameter_sets": (parameter_sets, SETS), "h264_slice_headers": (slices, SLICES)}
