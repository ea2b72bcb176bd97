"""Colour, sampling and distortion over pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.functions import scalar as S
from lumenflow.operators import tables as T

C = F.col


def ycbcr(spark, d):
    px = T.pixels(spark, d)
    y, cb, cr = S.ycbcr(C("r"), C("g"), C("b"))
    return px.groupBy(y.alias("luma"), cb.alias("cb"), cr.alias("cr")).agg(F.count(F.lit(1)).alias("n"))


YCBCR = f"""WITH {T.PIXELS} SELECT luma, cb, cr, count(*) AS n FROM (SELECT
 CAST(greatest(0, least(255, round(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b))) AS INT) AS luma,
 CAST(greatest(0, least(255, round(CAST(-0.168736 AS DOUBLE) * r - CAST(0.331264 AS DOUBLE) * g + CAST(0.5 AS DOUBLE) * b + 128))) AS INT) AS cb,
 CAST(greatest(0, least(255, round(CAST(0.5 AS DOUBLE) * r - CAST(0.418688 AS DOUBLE) * g - CAST(0.081312 AS DOUBLE) * b + 128))) AS INT) AS cr FROM px) GROUP BY ALL"""


def rgb_back(spark, d):
    px = T.pixels(spark, d)
    r, g, b = S.rgb(C("r"), C("g"), C("b"))
    return px.select(r.alias("r2"), g.alias("g2"), b.alias("b2")).groupBy("r2").agg(F.count(F.lit(1)).alias("n"), F.sum("g2").alias("g_sum"), F.sum("b2").alias("b_sum"))


RGB_BACK = f"""WITH {T.PIXELS} SELECT r2, count(*) AS n, CAST(sum(g2) AS BIGINT) AS g_sum, CAST(sum(b2) AS BIGINT) AS b_sum FROM (SELECT
 CAST(greatest(0, least(255, round(r + CAST(1.402 AS DOUBLE) * (b - 128)))) AS INT) AS r2,
 CAST(greatest(0, least(255, round(r - CAST(0.344136 AS DOUBLE) * (g - 128) - CAST(0.714136 AS DOUBLE) * (b - 128)))) AS INT) AS g2,
 CAST(greatest(0, least(255, round(r + CAST(1.772 AS DOUBLE) * (g - 128)))) AS INT) AS b2 FROM px) GROUP BY r2"""


def luma_variants(spark, d):
    px = T.pixels(spark, d)
    rgb = C("r"), C("g"), C("b")
    return px.select(S.luma_rounded(*rgb).alias("rounded"), S.luma_truncated(*rgb).alias("truncated"), S.luma_half_up(*rgb).alias("half_up"), S.luma_709(*rgb).alias("bt709")).groupBy(
        "rounded"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("truncated").alias("truncated"), F.sum("half_up").alias("half_up"), F.sum("bt709").alias("bt709"), F.max(F.abs(C("bt709") - C("half_up"))).alias("gap"))


LUMA = f"""WITH {T.PIXELS} SELECT rounded, count(*) AS n, CAST(sum(truncated) AS BIGINT) AS truncated, CAST(sum(half_up) AS BIGINT) AS half_up, CAST(sum(bt709) AS BIGINT) AS bt709, max(abs(bt709 - half_up)) AS gap
FROM (SELECT (77 * r + 150 * g + 29 * b + 128) >> 8 AS rounded, (77 * r + 150 * g + 29 * b) >> 8 AS truncated,
 CAST(floor(greatest(0, least(255, CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b + 0.5))) AS INT) AS half_up,
 CAST(greatest(0, least(255, round(CAST(0.2126 AS DOUBLE) * r + CAST(0.7152 AS DOUBLE) * g + CAST(0.0722 AS DOUBLE) * b))) AS INT) AS bt709 FROM px) GROUP BY rounded"""


def range_mismatch(spark, d):
    """What goes wrong when the range of a picture is mistaken, by luma: the stored sample, the right picture, limited samples shown as full
    ones, full ones stretched as if limited; and the luma of BT.709 less that of BT.601."""
    px = T.pixels(spark, d)
    rgb = C("r"), C("g"), C("b")
    y = S.luma_half_up(*rgb)
    rows = px.select(y.alias("y"), (S.luma_709(*rgb) - y).alias("gap")).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap"))
    stored = S.limited(C("y"))
    return rows.select("y", "n", stored.alias("stored"), S.stretched(stored).alias("right"), (stored - C("y")).alias("shown_as_full"), (S.stretched(C("y")) - C("y")).alias("full_as_limited"), "least_gap", "most_gap")


RANGE = f"""WITH {T.PIXELS}, l AS (SELECT CAST(floor(greatest(0, least(255, CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b + 0.5))) AS INT) AS y,
 CAST(greatest(0, least(255, round(CAST(0.2126 AS DOUBLE) * r + CAST(0.7152 AS DOUBLE) * g + CAST(0.0722 AS DOUBLE) * b))) AS INT) AS w FROM px), g AS (SELECT y, count(*) AS n, min(w - y) AS least_gap, max(w - y) AS most_gap FROM l GROUP BY y),
s AS (SELECT *, CAST(round(16 + y * 219 / 255.0::DOUBLE) AS INT) AS stored FROM g)
SELECT y, n, stored, CAST(greatest(0, least(255, round((stored - 16) * 255 / 219.0::DOUBLE))) AS INT) AS "right", stored - y AS shown_as_full, CAST(greatest(0, least(255, round((y - 16) * 255 / 219.0::DOUBLE))) AS INT) - y AS full_as_limited, least_gap, most_gap FROM s"""


def box_downsample(spark, d):
    """Means of two by two samples, rounded and truncated, in the array of the block."""
    at = lambda i, dy, dx: F.get(C("v"), S.shift(i, 2) * 16 + i.bitwiseAND(3) * 2 + 8 * dy + dx)
    sums = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (at(i, 0, 0) + at(i, 0, 1) + at(i, 1, 0) + at(i, 1, 1)).cast("long"))
    rows = T.blocks(spark, d).select("id", F.posexplode_outer(sums).alias("i", "s"))
    return rows.select("id", S.shift("i", 2).cast("long").alias("y"), C("i").bitwiseAND(3).cast("long").alias("x"), S.div(C("s") + 2, 4).alias("mean"), S.div(C("s"), 4).alias("truncated"))


BOX = f"""WITH {T.BLOCKS}, {T.ROWS} SELECT id, y // 2 AS y, x // 2 AS x, CAST((sum(s) + count(*) // 2) // count(*) AS BIGINT) AS mean, CAST(sum(s) // count(*) AS BIGINT) AS truncated FROM rows_ GROUP BY ALL"""


def chroma_upsample(spark, d):
    """Twice the width, centre-aligned: a quarter of the neighbour before or after, borders repeated."""
    each = T.blocks(spark, d).select("id", "v", F.posexplode("v").alias("i", "s"))
    x = C("i") % 8
    before, after = F.get("v", C("i") - F.when(x == 0, 0).otherwise(1)), F.get("v", C("i") + F.when(x == 7, 0).otherwise(1))
    return each.select("id", S.div(C("i"), 8).cast("int").alias("y"), x.alias("x"), S.shift(3 * C("s") + before + 2, 2).alias("even"), S.shift(3 * C("s") + after + 2, 2).alias("odd"))


UPSAMPLE = f"""WITH {T.BLOCKS}, {T.ROWS} SELECT id, y, x, (3 * s + coalesce(lag(s) OVER w, s) + 2) >> 2 AS even, (3 * s + coalesce(lead(s) OVER w, s) + 2) >> 2 AS odd
FROM rows_ WINDOW w AS (PARTITION BY id, y ORDER BY x)"""


def psnr(spark, d):
    """Distortion of quantities rounded to steps of four, by return flag; three ways to write a perfect match."""
    lines = T.read(spark, d, "lineitem").select("l_returnflag", F.round("l_quantity").cast("long").alias("a"))
    lines = lines.withColumn("b", S.div(C("a"), 4) * 4)
    mse = lines.groupBy("l_returnflag").agg((F.sum((C("a") - C("b")) * (C("a") - C("b"))) / F.count(F.lit(1))).alias("mse"), F.max(F.abs(C("a") - C("b"))).alias("worst"))
    return mse.select("l_returnflag", F.round("mse", 6).alias("mse"), "worst", F.round(S.psnr(C("mse"), 999.0), 6).alias("psnr"), F.round(S.psnr(C("mse") * 0, 99.0), 6).alias("same"))


PSNR = """WITH l AS (SELECT l_returnflag, CAST(round(l_quantity) AS BIGINT) AS a FROM lineitem), m AS (SELECT l_returnflag, CAST(sum((a - a // 4 * 4) * (a - a // 4 * 4)) AS DOUBLE) / count(*) AS mse, max(abs(a - a // 4 * 4)) AS worst FROM l GROUP BY 1)
SELECT l_returnflag, round(mse, 6) AS mse, worst, round(CASE WHEN mse = 0 THEN 999.0 ELSE 10 * log10(65025 / mse) END, 6) AS psnr, CAST(99 AS DOUBLE) AS same FROM m"""


def finite_stats(spark, d):
    """Mean and least PSNR over finite values only, of each block against the next."""
    b = T.blocks(spark, d)
    n = b.select((C("id") - 1).alias("id"), C("v").alias("w"))
    err = F.aggregate(F.zip_with("v", "w", lambda p, q: ((p - q) * (p - q)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    j = b.join(n, "id").select((C("id") % 10).alias("bucket"), S.psnr(err / 64.0).alias("p"))
    finite = F.when(~C("p").isin(float("inf")), C("p"))
    return j.groupBy("bucket").agg(F.round(F.avg(finite), 5).alias("mean"), F.round(F.min(finite), 6).alias("least"), F.count(finite).alias("n"))


FINITE = f"""WITH {T.BLOCKS}, j AS (SELECT b.id % 10 AS bucket, list_sum(list_transform(range(1, 65), lambda i: CAST((b.v[i] - n.v[i]) * (b.v[i] - n.v[i]) AS BIGINT))) / 64.0::DOUBLE AS mse FROM blocks b JOIN blocks n ON n.id = b.id + 1),
p AS (SELECT bucket, CASE WHEN mse <> 0 THEN 10 * log10(65025 / mse) END AS p FROM j) SELECT bucket, round(avg(p), 5) AS mean, round(min(p), 6) AS least, count(p) AS n FROM p GROUP BY 1"""


def region(spark, d):
    """A window of a plane, 0 outside: rows 6 to 9 and columns 6 to 9 of every block."""
    inside = lambda y, x: F.get("v", F.lit(8 * y + x)) if y < 8 and x < 8 else F.lit(0)
    cells = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), inside(y, x).alias("s")) for y in range(6, 10) for x in range(6, 10)])
    return T.blocks(spark, d).select("id", F.inline(cells))


REGION = f"""WITH {T.BLOCKS}, {T.ROWS}, g AS (SELECT CAST(6 + i // 4 AS INT) AS y, CAST(6 + i % 4 AS INT) AS x FROM (SELECT unnest(range(16)) AS i)), ids AS (SELECT DISTINCT id FROM rows_)
SELECT ids.id, g.y, g.x, coalesce(r.s, 0) AS s FROM ids CROSS JOIN g LEFT JOIN rows_ r ON r.id = ids.id AND r.y = g.y AND r.x = g.x"""


def text_rows(spark, d):
    """Rows of blocks as text, in order."""
    b = T.blocks(spark, d)
    return b.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.concat_ws(" ", F.transform(F.slice("v", y * 8 + 1, 8), lambda x: x.cast("string"))))).alias("y", "line"))


TEXT = f"""WITH {T.BLOCKS} SELECT id, CAST(y AS INT) AS y, array_to_string(v[y * 8 + 1 : y * 8 + 8], ' ') AS line FROM blocks, (SELECT unnest(range(8)) AS y)"""


def bits_per_pixel(spark, d):
    """Orders as streams: price as bitrate over a frame size by priority, the fewest bits first."""
    o = T.read(spark, d, "orders")
    rows = o.groupBy("o_orderpriority").agg(F.sum(F.round("o_totalprice").cast("long")).alias("bits"))
    return rows.select("o_orderpriority", "bits", F.round(S.bits_per_pixel(C("bits").cast("double"), F.lit(640), F.lit(360), F.lit(30)), 6).alias("bpp")).orderBy("bpp")


BPP = "SELECT o_orderpriority, bits, round(CAST(bits AS DOUBLE) / (640 * 360 * 30), 6) AS bpp FROM (SELECT o_orderpriority, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS bits FROM orders GROUP BY 1)"


def level_limits(spark, d):
    """The first H.264 level whose frame size and rate admit a part's dimensions; null where none does."""
    from lumenflow.functions import dims

    parts = T.read(spark, d, "part").select("p_partkey", F.expr("p_size * 2 * (p_size + 1)").alias("fs"), F.expr("24 + p_partkey % 37").alias("fps"))
    first = F.filter(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(f).alias("fs"), F.lit(m).alias("mbps")) for n, f, m in dims.LEVELS]), lambda e: (C("fs") <= e["fs"]) & (C("fs") * C("fps") <= e["mbps"]))
    return parts.select("p_partkey", "fs", "fps", F.get(first, F.lit(0))["level"].alias("level"))


def _levels() -> str:
    from lumenflow.functions import dims

    return ", ".join(f"({i}, '{n}', {f}, {m})" for i, (n, f, m) in enumerate(dims.LEVELS))


LEVEL = f"""WITH l(rank, level, max_fs, max_mbps) AS (VALUES {_levels()}), p AS (SELECT p_partkey, p_size * 2 * (p_size + 1) AS fs, 24 + p_partkey % 37 AS fps FROM part)
SELECT p_partkey, fs, fps, arg_min(level, rank) AS level FROM p LEFT JOIN l ON fs <= max_fs AND fs * fps <= max_mbps GROUP BY ALL"""

QUERIES = {
    "px_range_mismatch": (range_mismatch, RANGE),
    "px_ycbcr": (ycbcr, YCBCR), "px_rgb_back": (rgb_back, RGB_BACK), "px_luma_variants": (luma_variants, LUMA), "px_box_downsample": (box_downsample, BOX), "px_chroma_upsample": (chroma_upsample, UPSAMPLE),
    "px_psnr": (psnr, PSNR), "px_finite_psnr": (finite_stats, FINITE), "px_region": (region, REGION), "px_text_rows": (text_rows, TEXT), "px_bits_per_pixel": (bits_per_pixel, BPP), "px_level_limits": (level_limits, LEVEL),
}
