"""Codes, escapes and containers over byte streams, whose payload is the bytes of whole texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.functions import binary as B
from lumenflow.functions import scalar as S
from lumenflow.operators import tables as T
from lumenflow.sources import containers, sinks

C = F.col


def exp_golomb(spark, d):
    """Codes of unsigned and signed numbers, their lengths, and the numbers read back."""
    e = T.read(spark, d, "events").select("event_id", F.floor("value").cast("long").alias("k"))
    s = F.when(C("k") % 2 == 0, C("k")).otherwise(-C("k"))
    code = S.ue_text(C("k"))
    return e.select("event_id", code.alias("code"), S.ue_length(C("k")).alias("bits"), S.ue_value(F.concat(code, F.lit("1011"))).alias("back"), S.se_number(s).alias("se"), S.from_se(S.se_number(s)).alias("se_back"))


GOLOMB = """WITH e AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS k FROM events), s AS (SELECT *, CASE WHEN k % 2 = 0 THEN k ELSE -k END AS s FROM e)
SELECT event_id, repeat('0', length(bin(k + 1)) - 1) || bin(k + 1) AS code, CAST(2 * floor(log2(k + 1)) + 1 AS INT) AS bits, k AS back, CASE WHEN s > 0 THEN 2 * s - 1 ELSE -2 * s END AS se, s AS se_back FROM s"""


def magnitudes(spark, d):
    """Category and magnitude bits of differences between samples, and the differences read back."""
    w = Window.partitionBy("block").orderBy("part", "x")
    v = T.samples(spark, d).select("block", "part", "x", (C("s") - F.coalesce(F.lag("s").over(w), F.lit(0))).cast("long").alias("v"))
    size, bits = S.category(C("v")), S.magnitude_bits(C("v"))
    return v.select("block", "part", "x", size.alias("size"), bits.alias("bits"), S.from_magnitude(bits, size).alias("back"))


MAGNITUDES = f"""WITH {T.SAMPLES}, v AS (SELECT block, part, x, s - coalesce(lag(s) OVER (PARTITION BY block ORDER BY part, x), 0) AS v FROM samples), c AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END AS size FROM v)
SELECT block, part, x, CAST(size AS INT) AS size, CAST(CASE WHEN v >= 0 THEN v ELSE v + (1 << size) - 1 END AS BIGINT) AS bits, CAST(v AS BIGINT) AS back FROM c"""

#: Every byte of a text becomes one of 0 to 3, by its low two bits, so that many places need an escape.
LOW_BITS = "translate(regexp_replace(hex({}), '.(.)', '{}'{}), '0123456789ABCDEF', '0123012301230123')"


def emulation(spark, d):
    """Escaped payloads, what was added, and whether they read back the same."""
    t = T.read(spark, d, "documents").select("doc_id", F.expr(LOW_BITS.format("coalesce(text, '')", "$1", "")).alias("s"))
    payload = B.raw(F.replace(F.translate("s", "123", "\x01\x02\x03"), F.lit("0"), F.lit("\x00")))
    t = t.select("doc_id", payload.alias("p")).withColumn("e", B.escape(C("p")))
    shown = F.translate(F.replace(B.text(C("e")), F.lit("\x00"), F.lit("0")), "\x01\x02\x03", "123")
    return t.select("doc_id", shown.alias("escaped"), B.escaped_bytes(C("e")).cast("long").alias("added"), (B.unescape(C("e")) == C("p")).alias("same"))


EMULATION = f"""WITH t AS (SELECT doc_id, {LOW_BITS.format("encode(coalesce(text, ''))", chr(92) + "1", ", 'g'")} AS s FROM documents), r AS (SELECT doc_id, s, regexp_replace(s, '00', '003', 'g') AS e FROM t),
e AS (SELECT doc_id, s, CASE WHEN e LIKE '%003' THEN left(e, length(e) - 1) ELSE e END AS e FROM r)
SELECT doc_id, e AS escaped, CAST(length(e) - length(s) AS BIGINT) AS added, true AS same FROM e"""


def stuffing(spark, d):
    """The bytes of whole texts with FF for every letter e, stuffed, in hexadecimal, and whether they read back the same."""
    payload = F.translate(B.text(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "e", "\xff")
    t = T.read(spark, d, "documents").select("doc_id", B.raw(payload).alias("p"))
    return t.select("doc_id", F.hex(B.stuff(C("p"))).alias("stuffed"), (B.unstuff(B.stuff(C("p"))) == C("p")).alias("same"))


#: A byte stands between spaces, so that no pair of digits is found across two bytes.
STUFFING = r"""SELECT doc_id, replace(replace(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g'), '65 ', 'FF00 '), ' ', '') AS stuffed, true AS same FROM documents"""


def _turns(spark, d):
    t = T.read(spark, d, "conversations")
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return t.select(C("conv_id").cast("string").alias("path"), idx.alias("idx"), (C("turn") % 4).cast("int").alias("ref_idc"), (1 + C("turn") % 8).cast("int").alias("type_id"), F.coalesce(C("text"), F.lit("")).cast("binary").alias("rbsp"))


def annexb(spark, d):
    """Conversations written as Annex B streams, a turn a unit, and split again. Each byte of a text counts by its low two bits, so that units
    are full of what needs an escape."""
    digits = F.expr(LOW_BITS.format("rbsp", "$1", ""))
    units = _turns(spark, d).withColumn("rbsp", B.raw(F.replace(F.translate(digits, "123", "\x01\x02\x03"), F.lit("0"), F.lit("\x00"))))
    return containers.annexb(sinks.annexb(units)).select(C("path").cast("long").alias("conv_id"), "idx", C("offset").cast("long").alias("offset"), C("size").cast("int").alias("size"), "ref_idc", "type_id", "name", F.lower(F.hex("rbsp")).alias("rbsp"))


TURNS = "t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS idx, turn, encode(coalesce(text, '')) AS rbsp FROM conversations)"
ANNEXB = f"""WITH {TURNS}, p AS (SELECT conv_id, idx, turn, {LOW_BITS.format("rbsp", chr(92) + "1", ", 'g'")} AS s FROM t), r AS (SELECT *, regexp_replace(s, '00', '003', 'g') AS e FROM p),
u AS (SELECT conv_id, idx, turn, s, length(e) - CASE WHEN e LIKE '%003' THEN 1 ELSE 0 END AS n FROM r)
SELECT conv_id, CAST(idx AS INT) AS idx, CAST(coalesce(sum(5 + n) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 4 AS BIGINT) AS "offset",
CAST(1 + n AS INT) AS size, CAST(turn % 4 AS INT) AS ref_idc, CAST(1 + turn % 8 AS INT) AS type_id, ['SLICE', 'DPA', 'DPB', 'DPC', 'IDR', 'SEI', 'SPS', 'PPS'][1 + turn % 8] AS name, regexp_replace(s, '(.)', '0\\1', 'g') AS rbsp FROM u"""


def avi(spark, d):
    """Conversations written as AVI files, a turn a frame, and read again."""
    t = _turns(spark, d).select("path", C("idx").alias("frame_no"), C("rbsp").alias("jpeg"))
    files = sinks.avi(t, 192, 144, 10)
    first = containers.avi_chunks(files)
    base = first.groupBy("path").agg(F.min("offset").alias("base"))
    return first.join(base, "path").select(C("path").cast("long").alias("conv_id"), "frame_no", (C("offset") - C("base")).alias("offset"), "size", F.lower(F.hex("jpeg")).alias("jpeg"))


AVI = f"""WITH {TURNS}, s AS (SELECT *, octet_length(rbsp) AS size FROM t)
SELECT conv_id, CAST(idx AS INT) AS frame_no, CAST(coalesce(sum(8 + size + size % 2) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size, lower(hex(rbsp)) AS jpeg FROM s"""


def riff(spark, d):
    """Parts of the AVI files that conversations make: where each is and how long, and the fields of the heads."""
    files = sinks.avi(_turns(spark, d).select("path", C("idx").alias("frame_no"), C("rbsp").alias("jpeg")), 192, 144, 10)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return containers.riff(files).select(C("path").cast("long").alias("conv_id"), "k", "parent", "name", "offset", "length", shown.alias("fields"), "error")


def _riff() -> str:
    avih = "'buffer=' || most || ' first=0 flags=16 frames=' || n || ' height=144 micros=100000 padding=0 rate=0 streams=1 width=192'"
    strh = "'buffer=' || most || ' first=0 flags=0 handler=MJPG language=0 length=' || n || ' priority=0 quality=4294967295 rate=10 sample=0 scale=1 start=0 type=vids'"
    strf = "'bits=24 compression=MJPG head=40 height=144 image=82944 planes=1 width=192'"
    fixed = [
        ("0", "NULL", "'AVI '", 0, "body + 24 * n + 224", "''"), ("1", "'AVI '", "'hdrl'", 12, "192", "''"), ("2", "'hdrl'", "'avih'", 24, "56", avih), ("3", "'hdrl'", "'strl'", 88, "116", "''"),
        ("4", "'strl'", "'strh'", 100, "56", strh), ("5", "'strl'", "'strf'", 164, "40", strf), ("6", "'AVI '", "'movi'", 212, "4 + body + 8 * n", "''"),
    ]
    rows = " UNION ALL ".join(f'SELECT conv_id, {k} AS k, {p} AS parent, {name} AS name, {at} AS "offset", {n} AS length, {f} AS fields FROM w' for k, p, name, at, n, f in fixed)
    return f"""WITH {TURNS}, s AS (SELECT conv_id, idx, octet_length(rbsp) AS size FROM t), w AS (SELECT conv_id, count(*) AS n, max(size) AS most, sum(size + size % 2) AS body FROM s GROUP BY 1),
c AS (SELECT conv_id, idx, size, coalesce(sum(8 + size + size % 2) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
r AS ({rows} UNION ALL SELECT conv_id, 7 + idx, 'movi', '00dc', 224 + before, size, '' FROM c UNION ALL SELECT conv_id, 7 + n, 'AVI ', 'idx1', 224 + body + 8 * n, 16 * n, '' FROM w)
SELECT conv_id, CAST(k AS INT) AS k, parent, name, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, fields, CAST(NULL AS VARCHAR) AS error FROM r"""


def h264_numbers(spark, d):
    """Scalar tables of the decoder for the numbers that parts make: chroma parameter, coded patterns, scaling, median, context."""
    p = T.read(spark, d, "part").select("p_partkey", "p_size", (C("p_partkey") % 52).cast("int").alias("qp"), (C("p_size") % 48).alias("code"))
    a, b, c = (C("p_partkey") % 17 - 8).cast("int"), (C("p_size") % 13 - 6), (C("p_partkey") % 7 - 3).cast("int")
    left, top = F.when(C("p_size") % 3 != 0, C("p_size") % 17), F.when(C("p_size") % 5 != 0, (C("p_partkey") % 17).cast("int"))
    cbp = S.coded_block_pattern(C("code"), True)
    x, y = S.macroblock(C("p_partkey").cast("int"), F.lit(11))
    return p.select(
        "p_partkey", S.chroma_qp(C("qp"), 2).alias("chroma_qp"), cbp.alias("cbp"), S.cbp_code(cbp).cast("int").alias("code"), S.coded_block_pattern(C("code"), False).alias("cbp_inter"), S.median3(a, b, c).alias("median"), S.vector_cost(a, b).alias("cost"),
        S.coefficient_context(left, top).alias("nc"), x.alias("mb_x"), y.cast("int").alias("mb_y"), S.boundary_strength(C("p_size") % 5 == 0, C("p_size") % 2 == 0, C("p_size") % 3 == 0, C("p_size") % 7 == 0, F.abs(a)).alias("strength"),
    )


def _list(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


def _numbers() -> str:
    from lumenflow.functions import dims

    return f"""WITH p AS (SELECT p_partkey, p_size, greatest(0, least(51, p_partkey % 52 + 2)) AS q, p_size % 48 AS k, CAST(p_partkey % 17 - 8 AS INT) AS a, p_size % 13 - 6 AS b, CAST(p_partkey % 7 - 3 AS INT) AS c,
CASE WHEN p_size % 3 <> 0 THEN p_size % 17 END AS l, CASE WHEN p_size % 5 <> 0 THEN CAST(p_partkey % 17 AS INT) END AS t FROM part)
SELECT p_partkey, CAST(CASE WHEN q < 30 THEN q ELSE {_list(dims.CHROMA_QP)}[q - 29] END AS INT) AS chroma_qp, {_list(dims.CBP_INTRA)}[k + 1] AS cbp, k AS code, {_list(dims.CBP_INTER)}[k + 1] AS cbp_inter,
list_sort([a, b, c])[2] AS median, abs(a) + abs(b) AS cost, CASE WHEN l IS NOT NULL AND t IS NOT NULL THEN (l + t + 1) >> 1 ELSE coalesce(l, t, 0) END AS nc, CAST(p_partkey % 11 AS INT) AS mb_x, CAST(p_partkey // 11 AS INT) AS mb_y,
CASE WHEN p_size % 5 = 0 AND p_size % 2 = 0 THEN 4 WHEN p_size % 5 = 0 THEN 3 WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 7 = 0 OR abs(a) >= 4 THEN 1 ELSE 0 END AS strength FROM p"""


QUERIES = {
    "bit_exp_golomb": (exp_golomb, GOLOMB), "bit_magnitudes": (magnitudes, MAGNITUDES), "byte_emulation": (emulation, EMULATION), "byte_stuffing": (stuffing, STUFFING), "container_annexb": (annexb, ANNEXB), "container_avi": (avi, AVI), "container_riff": (riff, _riff()), "h264_numbers": (h264_numbers, _numbers()),
}
