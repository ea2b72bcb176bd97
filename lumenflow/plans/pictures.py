"""JPEG files of the planes as colour pictures: written, listed, read again. The sampling of chroma goes with the plane's number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.functions import dims, exif
from lumenflow.functions import scalar as S
from lumenflow.operators import jpeg, prediction
from lumenflow.operators import planes as P
from lumenflow.operators import tables as T
from lumenflow.operators.transforms import _cosines
from lumenflow.sources import containers

C = F.col
QUALITY = 80
SAMPLINGS = {"4:4:4": (1, 1), "4:2:2": (2, 1), "4:2:0": (2, 2)}


def colour(spark, d):
    """(path, width, height, data): a plane's samples with a rise of red to the right and a fall of blue downwards."""
    lines = T.planes(spark, d).select("plane", "y", "x", "v", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("r"))

    def pixel(s, i):
        values = (S.clip(s + C("x") * 16 + i), s, S.clip(s - C("y") * 16 - C("r")))
        return F.concat(*[F.lpad(F.hex(v.cast("long")), 2, "0") for v in values])

    text = F.array_join(F.transform(F.slice("v", C("r") * 16 + 1, F.lit(16)), pixel), "")
    whole = lines.select("plane", (C("y") * 16 + C("r")).alias("line"), "x", text.alias("t")).groupBy("plane").agg(F.array_sort(F.collect_list(F.struct("line", "x", "t"))).alias("a"))
    return whole.select(C("plane").cast("string").alias("path"), F.lit(T.SIDE).alias("width"), F.lit(T.SIDE).alias("height"), F.unhex(F.array_join(F.transform("a", lambda e: e["t"]), "")).alias("data"))


def _named(df):
    return df.withColumn("plane", C("path").cast("long")).withColumn("sampling", F.get(F.array(*map(F.lit, SAMPLINGS)), (C("plane") % 3).cast("int")))


def files(spark, d):
    """(path, content) of all planes."""
    px = colour(spark, d)
    return reduce(DataFrame.unionByName, [jpeg.encode(px.filter(C("path").cast("long") % 3 == k), QUALITY, sub) for k, sub in enumerate(SAMPLINGS.values())])


def segments(spark, d):
    """Markers of every file, where they are and how long."""
    return _named(containers.jpeg_markers(files(spark, d))).select("plane", "k", "name", "offset", "length", "error")


def scans(spark, d):
    """The coded data of every file."""
    return _named(containers.jpeg_markers(files(spark, d))).filter("name = 'scan'").select("plane", "sampling", C("length").alias("bytes"), F.hex("body").alias("scan"))


def heads(spark, d):
    """What the heads of every file say: size, sampling of the components, tables, restarts, EXIF."""
    h = _named(jpeg.headers(files(spark, d)))
    return h.select("plane", "width", "height", F.hex("sof").alias("frame"), F.hex("sos").alias("scan"), F.size("quant").alias("quant"), F.size("huff").alias("huff"), "restart", F.octet_length("scan").alias("bytes"), "exif", "error")


def quant_tables(spark, d):
    """Quantisation steps read out of every file."""
    return _named(jpeg.quant_tables(jpeg.headers(files(spark, d)))).select("plane", "segment", "id", "bits", "v", "u", "step")


def huffman_tables(spark, d):
    """Codes by length of the Huffman tables of every file."""
    return _named(jpeg.huffman_tables(jpeg.headers(files(spark, d)))).select("plane", "segment", "class", "id", "length", "codes")


def decoded(spark, d):
    """Lines of the pictures that come out of the files."""
    px = _named(jpeg.decode(files(spark, d)))
    lines = px.select("plane", "sampling", "error", "data", F.explode(F.sequence(F.lit(0), F.lit(T.SIDE - 1))).alias("y"))
    return lines.select("plane", "sampling", "y", F.hex(F.call_function("substring", C("data"), C("y") * (3 * T.SIDE) + 1, F.lit(3 * T.SIDE))).alias("rgb"), "error")


def distortion(spark, d):
    """PSNR of every picture against what comes out of its file, and the bits of a pixel."""
    both = _named(jpeg.psnr(colour(spark, d), jpeg.decode(files(spark, d))))
    return both.select("plane", "sampling", F.round("psnr", 5).alias("psnr"))


_COS = "cosine(u, x, c) AS (VALUES " + ", ".join(f"({u}, {x}, {c!r}::DOUBLE)" for u, row in enumerate(_cosines(8)) for x, c in enumerate(row)) + ")"
_STEP = "step(k, v, u, s) AS (VALUES " + ", ".join(f"({k}, {i // 8}, {i % 8}, {s})" for k, name in enumerate(("luma", "chroma")) for i, s in enumerate(jpeg.scaled_steps(QUALITY)[name])) + ")"
_ZIGZAG = "[" + ", ".join(str(dims.zigzag().index(i)) for i in range(64)) + "]"
_CODES = "code(t, symbol, w) AS (VALUES " + ", ".join(f"('{t}', {s}, '{c:0{n}b}')" for t in dims.HUFFMAN for s, n, c in dims.huffman_codes(t)) + ")"
_BYTE = lambda v: f"CAST(greatest(0, least(255, round(round({v}, 6)))) AS BIGINT)"

#: Levels (plane, comp, by, bx, v, u, q) of all components; w and h are the samples of luma for one of chroma.
LEVELS = f"""WITH {T.PLANES}, {_COS}, {_STEP}, {_CODES}, size AS (SELECT plane, CASE plane % 3 WHEN 0 THEN 1 ELSE 2 END AS w, CASE plane % 3 WHEN 2 THEN 2 ELSE 1 END AS h FROM plane GROUP BY plane),
px AS (SELECT plane, k // 64 AS y, k % 64 AS x, CAST(least(255, s + k % 64) AS DOUBLE) AS r, CAST(s AS DOUBLE) AS g, CAST(greatest(0, s - k // 64) AS DOUBLE) AS b FROM plane),
ycc AS (SELECT plane, y, x, {_BYTE('0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b')} AS c0, {_BYTE('-0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b + 128')} AS c1, {_BYTE('0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b + 128')} AS c2 FROM px),
comp AS (SELECT plane, 0 AS comp, y, x, c0 AS s FROM ycc UNION ALL SELECT plane, 1 AS comp, y // h AS y, x // w AS x, (sum(c1) + count(*) // 2) // count(*) AS s FROM ycc JOIN size USING (plane) GROUP BY ALL
  UNION ALL SELECT plane, 2 AS comp, y // h AS y, x // w AS x, (sum(c2) + count(*) // 2) // count(*) AS s FROM ycc JOIN size USING (plane) GROUP BY ALL),
across AS (SELECT plane, comp, y, comp.x // 8 AS bx, u, sum((s - 128) * c) AS t FROM comp JOIN cosine ON cosine.x = comp.x % 8 GROUP BY ALL),
coef AS (SELECT plane, comp, y // 8 AS by_, bx, cosine.u AS v, across.u, sum(t * c) AS f FROM across JOIN cosine ON cosine.x = y % 8 GROUP BY ALL),
lev AS MATERIALIZED (SELECT plane, comp, by_, bx, coef.v, coef.u, s, CAST(round(round(f, 6) / s) AS BIGINT) AS q FROM coef JOIN step ON step.k = least(comp, 1) AND step.v = coef.v AND step.u = coef.u)"""

_SIZE = lambda v: f"CASE WHEN {v} = 0 THEN 0 ELSE length(bin(abs({v}))) END"
_LOW = lambda v: f"CASE WHEN {v} = 0 THEN '' ELSE lpad(bin(CASE WHEN {v} > 0 THEN {v} ELSE {v} + (1 << length(bin(abs({v})))) - 1 END), CAST(length(bin(abs({v}))) AS INT), '0') END"
SCAN = f"""{LEVELS},
pos AS (SELECT lev.*, {_ZIGZAG}[v * 8 + u + 1] AS k, CASE WHEN comp = 0 THEN (by_ // h * (8 // w) + bx // w) * (w * h + 2) + by_ % h * w + bx % w ELSE (by_ * (8 // w) + bx) * (w * h + 2) + w * h + comp - 1 END AS pos, CASE WHEN comp = 0 THEN 'luma' ELSE 'chroma' END AS kind FROM lev JOIN size USING (plane)),
dc AS (SELECT plane, pos, kind, q - coalesce(lag(q) OVER (PARTITION BY plane, comp ORDER BY pos), 0) AS v FROM pos WHERE k = 0),
ac AS (SELECT plane, pos, kind, k, q AS v, k - coalesce(lag(k) OVER (PARTITION BY plane, pos ORDER BY k), 0) - 1 AS run FROM pos WHERE k > 0 AND q <> 0),
word AS (SELECT plane, pos, 0 AS k, w || {_LOW('v')} AS t FROM dc JOIN code ON code.t = 'dc_' || kind AND symbol = {_SIZE('v')}
  UNION ALL SELECT plane, pos, k, repeat(z.w, run // 16) || c.w || {_LOW('v')} FROM ac JOIN code c ON c.t = 'ac_' || kind AND c.symbol = run % 16 * 16 + {_SIZE('v')} JOIN code z ON z.t = 'ac_' || kind AND z.symbol = 240
  UNION ALL SELECT plane, pos, 64, w FROM (SELECT plane, pos, kind FROM pos GROUP BY ALL HAVING coalesce(max(CASE WHEN q <> 0 THEN k END), 0) < 63) JOIN code ON code.t = 'ac_' || kind AND symbol = 0),
text AS (SELECT plane, string_agg(t, '' ORDER BY pos, k) AS t FROM word GROUP BY plane),
full_ AS (SELECT plane, rpad(t, CAST((length(t) + 7) // 8 * 8 AS INT), '1') AS t FROM text),
scan AS (SELECT plane, array_to_string(list_transform(range(0, length(t) // 8), lambda i: CASE WHEN substr(t, 8 * i + 1, 8) = '11111111' THEN 'FF00' ELSE printf('%02X', list_reduce(list_transform(range(1, 9), lambda b: CAST(substr(t, 8 * i + b, 1) AS INT)), lambda a, b: 2 * a + b)) END), '') AS scan FROM full_)"""
_NAME = "list_value('4:4:4', '4:2:2', '4:2:0')[plane % 3 + 1] AS sampling"
SCANS = f"{SCAN} SELECT plane, {_NAME}, CAST(length(scan) // 2 AS INT) AS bytes, scan FROM scan"


def _layout() -> str:
    """Markers before the scan: name and the length that the segment states."""
    sizes = [("SOI", 0), ("APP0", 16), ("DQT", 67), ("DQT", 67), ("SOF0", 17), *[("DHT", 19 + sum(dims.HUFFMAN[t][0])) for t in ("dc_luma", "ac_luma", "dc_chroma", "ac_chroma")], ("SOS", 12)]
    rows, at = [], 0
    for k, (name, n) in enumerate(sizes):
        rows.append(f"({k}, '{name}', {at}, {n})")
        at += 2 + n
    return "head(k, name, place, n) AS (VALUES " + ", ".join(rows) + f"), tail AS (SELECT {len(rows)} AS k, {at} AS place)"


SEGMENTS = f"""{SCAN}, {_layout()} SELECT plane, k, name, CAST(place AS BIGINT) AS "offset", n AS length, CAST(NULL AS VARCHAR) AS error FROM scan, head
UNION ALL SELECT plane, k, 'scan', CAST(place AS BIGINT), CAST(length(scan) // 2 AS INT), CAST(NULL AS VARCHAR) FROM scan, tail"""

HEADS = f"""{SCAN} SELECT plane, 64 AS width, 64 AS height, '080040004003' || '01' || w || h || '00' || '021101' || '031101' AS frame, '0301000211031100' || '3F00' AS scan, 2 AS quant, 4 AS huff, 0 AS restart, CAST(length(scan.scan) // 2 AS INT) AS bytes, false AS exif, CAST(NULL AS VARCHAR) AS error FROM scan JOIN size USING (plane)"""
QUANT = f"WITH {T.BLOCKS}, {_STEP} SELECT plane, k AS segment, k AS id, 8 AS bits, v, u, s AS step FROM (SELECT DISTINCT id // 64 AS plane FROM blocks), step"
HUFF = f"WITH {T.BLOCKS}, n(segment, class, id, length, codes) AS (VALUES " + ", ".join(f"({k}, {c}, {i}, {n}, {m})" for k, (c, i, t) in enumerate(((0, 0, "dc_luma"), (1, 0, "ac_luma"), (0, 1, "dc_chroma"), (1, 1, "ac_chroma"))) for n, m in enumerate(dims.HUFFMAN[t][0], 1)) + ") SELECT plane, segment, class, n.id, length, codes FROM (SELECT DISTINCT id // 64 AS plane FROM blocks), n"

#: Chroma grows along columns, then along lines: a place between two samples is a quarter from the nearer one.
_GROW = lambda name, source, axis, factor: f"""{name} AS (SELECT o.plane, o.comp, o.o AS {axis}, o.{'x' if axis == 'y' else 'y'}, a.s * (1 - p) + b.s * p AS s
  FROM (SELECT plane, comp, {'x' if axis == 'y' else 'y'}, o, CAST(floor(t) AS BIGINT) AS low, t - floor(t) AS p, n FROM (SELECT *, greatest(0, least(n - 1, (o + 0.5::DOUBLE) / {factor} - 0.5::DOUBLE)) AS t FROM (SELECT DISTINCT plane, comp, {'x' if axis == 'y' else 'y'}, {factor}, 64 // {factor} AS n, unnest(range(64)) AS o FROM {source} JOIN size USING (plane)))) o
  JOIN {source} a ON a.plane = o.plane AND a.comp = o.comp AND a.{'x' if axis == 'y' else 'y'} = o.{'x' if axis == 'y' else 'y'} AND a.{axis} = low
  JOIN {source} b ON b.plane = o.plane AND b.comp = o.comp AND b.{'x' if axis == 'y' else 'y'} = o.{'x' if axis == 'y' else 'y'} AND b.{axis} = least(low + 1, n - 1))"""  # noqa: E731
BACK = f"""{LEVELS},
back1 AS (SELECT plane, comp, by_, bx, v, x, sum(q * s * c) AS t FROM lev JOIN cosine ON cosine.u = lev.u GROUP BY ALL),
back AS (SELECT plane, comp, by_ * 8 + cosine.x AS y, bx * 8 + back1.x AS x, greatest(0, least(255, round(round(sum(t * c), 6) + 128))) AS s FROM back1 JOIN cosine ON cosine.u = v GROUP BY plane, comp, by_, bx, cosine.x, back1.x),
chroma AS (SELECT * FROM back WHERE comp > 0), {_GROW('tall', 'chroma', 'y', 'h')}, {_GROW('grown', 'tall', 'x', 'w')},
mix AS (SELECT l.plane, l.y, l.x, l.s AS c0, b.s - 128 AS cb, r.s - 128 AS cr FROM back l JOIN grown b ON b.plane = l.plane AND b.comp = 1 AND b.y = l.y AND b.x = l.x JOIN grown r ON r.plane = l.plane AND r.comp = 2 AND r.y = l.y AND r.x = l.x WHERE l.comp = 0),
rgb AS (SELECT plane, y, x, {_BYTE('c0 + 1.402::DOUBLE * cr')} AS r, {_BYTE('c0 - 0.344136::DOUBLE * cb - 0.714136::DOUBLE * cr')} AS g, {_BYTE('c0 + 1.772::DOUBLE * cb')} AS b FROM mix)"""
DECODED = f"{BACK} SELECT plane, {_NAME}, CAST(y AS INT) AS y, string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY x) AS rgb, CAST(NULL AS VARCHAR) AS error FROM rgb GROUP BY plane, y"
DISTORTION = f"{BACK} SELECT plane, {_NAME}, round(10 * log10(65025 / (sum((p.r - o.r) ** 2 + (p.g - o.g) ** 2 + (p.b - o.b) ** 2) / (3 * count(*)))), 5) AS psnr FROM rgb o JOIN px p USING (plane, y, x) GROUP BY plane"

def cut(spark, d):
    """The pictures less some lines and columns on the lower right, which the plane's number makes."""
    px = colour(spark, d).withColumn("w", (T.SIDE - C("path").cast("int") % 15)).withColumn("h", (T.SIDE - C("path").cast("int") % 13))
    rows = F.transform(F.sequence(F.lit(0), C("h") - 1), lambda y: F.call_function("substring", F.hex("data"), y * (6 * T.SIDE) + 1, C("w") * 6))
    return px.select("path", C("w").alias("width"), C("h").alias("height"), F.unhex(F.array_join(rows, "")).alias("data"))


def coded_frames(spark, d):
    """Lines of the frames that an encoder makes of pictures of any size: padded to whole macroblocks, 4:2:0."""
    f = prediction.coded_frames(cut(spark, d))
    part = lambda name, k, w: F.struct(F.lit(name).alias("part"), F.lit(k).alias("k"), w.alias("wide"), C(name).alias("b"))
    each = f.select("path", "width", "height", F.explode(F.array(part("y", 1, C("width")), part("cb", 2, S.shift("width", 1)), part("cr", 2, S.shift("width", 1)))).alias("p"))
    lines = each.select("path", "p.part", "p.wide", "p.b", F.explode(F.sequence(F.lit(0), S.div("height", C("p.k")).cast("int") - 1)).alias("line"))
    return lines.select(C("path").cast("long").alias("plane"), "part", "line", F.hex(F.call_function("substring", C("b"), C("line") * C("wide") + 1, C("wide"))).alias("samples"))


_TRUNCATED = lambda v: f"CAST(floor(greatest(0, least(255, {v} + 0.5::DOUBLE))) AS INT)"
CODED = f"""WITH {T.PLANES}, px AS (SELECT plane, k // 64 AS y, k % 64 AS x, CAST(least(255, s + k % 64) AS DOUBLE) AS r, CAST(s AS DOUBLE) AS g, CAST(greatest(0, s - k // 64) AS DOUBLE) AS b FROM plane),
pad AS (SELECT g0.plane, g0.y, g0.x, p.r, p.g, p.b FROM px g0 JOIN px p ON p.plane = g0.plane AND p.y = least(g0.y, 63 - g0.plane % 13) AND p.x = least(g0.x, 63 - g0.plane % 15)),
uv AS (SELECT plane, y, x, -0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b + 128 AS u, 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b + 128 AS v FROM pad),
four AS (SELECT a.plane, a.y // 2 AS y, a.x // 2 AS x, {_TRUNCATED('(a.u + b.u + c.u + e.u) / 4')} AS u, {_TRUNCATED('(a.v + b.v + c.v + e.v) / 4')} AS v FROM uv a JOIN uv b ON b.plane = a.plane AND b.y = a.y AND b.x = a.x + 1 JOIN uv c ON c.plane = a.plane AND c.y = a.y + 1 AND c.x = a.x
  JOIN uv e ON e.plane = a.plane AND e.y = a.y + 1 AND e.x = a.x + 1 WHERE a.y % 2 = 0 AND a.x % 2 = 0),
s AS (SELECT plane, 'y' AS part, y, x, {_TRUNCATED('0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b')} AS s FROM pad UNION ALL SELECT plane, 'cb', y, x, u FROM four UNION ALL SELECT plane, 'cr', y, x, v FROM four)
SELECT plane, part, CAST(y AS INT) AS line, string_agg(printf('%02X', s), '' ORDER BY x) AS samples FROM s GROUP BY plane, part, y"""


def made(spark, d):
    """Lines of pictures like photographs, one for every plane: waves of colour, two plain rectangles and noise of the plane's own."""
    rows = T.planes(spark, d).select("plane").distinct().select("plane", F.explode(F.sequence(F.lit(0), F.lit(MADE[1] - 1))).alias("y"))

    def pixel(x):
        i = (C("y") * MADE[0] + x) * 3
        waves = (120 + 100 * F.sin(x / MADE[0] * 3.14), 140 + 90 * F.cos(C("y") / MADE[1] * 3.14), 100 + 80 * F.sin((x + C("y")) / sum(MADE) * 6.28))
        inside = lambda y0, y1, x0, x1: C("y").between(y0, y1 - 1) & x.between(x0, x1 - 1)
        values = [F.when(inside(6, 18, 8, 24), a).when(inside(22, 34, 36, 54), b).otherwise(w) for w, a, b in zip(waves, (220, 60, 50), (40, 90, 200), strict=True)]
        noisy = [S.clip(v + P.noise(C("plane") + 42, (i + k).cast("int"), 14)) for k, v in enumerate(values)]
        return F.concat(*[F.lpad(F.hex(F.floor(v).cast("long")), 2, "0") for v in noisy])

    return rows.select("plane", "y", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(MADE[0] - 1)), pixel), "").alias("rgb"))


#: Width and height of the pictures that are made.
MADE = (64, 40)
_WAVES = [f"120 + 100 * sin(x / {MADE[0]}.0::DOUBLE * 3.14::DOUBLE)", f"140 + 90 * cos(y / {MADE[1]}.0::DOUBLE * 3.14::DOUBLE)", f"100 + 80 * sin((x + y) / {sum(MADE)}.0::DOUBLE * 6.28::DOUBLE)"]
_MADE = lambda k, a, b: f"printf('%02X', CAST(floor(greatest(0, least(255, CASE WHEN y BETWEEN 6 AND 17 AND x BETWEEN 8 AND 23 THEN {a} WHEN y BETWEEN 22 AND 33 AND x BETWEEN 36 AND 53 THEN {b} ELSE {_WAVES[k]} END + n[{k + 1}]))) AS BIGINT))"
MADE_SQL = f"""WITH RECURSIVE {T.PLANES}, lcg(plane, k, s) AS (SELECT DISTINCT plane, CAST(0 AS BIGINT), ((42 + plane) * 1103515245 + 12345) % 4294967296 FROM plane UNION ALL SELECT plane, k + 1, (s * 1103515245 + 12345) % 4294967296 FROM lcg WHERE k < {3 * MADE[0] * MADE[1] - 1}),
px AS (SELECT plane, k // 3 // {MADE[0]} AS y, k // 3 % {MADE[0]} AS x, list((s >> 16 & 32767) % 7 - 3 ORDER BY k) AS n FROM lcg GROUP BY ALL)
SELECT plane, CAST(y AS INT) AS y, string_agg({_MADE(0, 220, 40)} || {_MADE(1, 60, 90)} || {_MADE(2, 50, 200)}, '' ORDER BY x) AS rgb FROM px GROUP BY plane, y"""

def tags(spark, d):
    """EXIF tags of pictures of parts, written in either byte order and read again: the maker, the model, the name as software, the size as
    a text that fits into its entry; some have none."""
    p = T.read(spark, d, "part")
    texts = {0x010F: C("p_type"), 0x0110: C("p_brand"), 0x0131: C("p_name"), 0x0132: F.when(C("p_size") % 3 != 0, C("p_size").cast("string"))}
    bodies = p.select(C("p_partkey").alias("path"), exif.written(texts, C("p_partkey") % 2 == 0).alias("body"))
    return exif.read(bodies).select(C("path").cast("long").alias("p_partkey"), "tag", "name", "value", "error")


TAGS = """WITH t AS (SELECT p_partkey, 271 AS tag, 'Make' AS name, p_type AS value FROM part UNION ALL SELECT p_partkey, 272, 'Model', p_brand FROM part UNION ALL SELECT p_partkey, 305, 'Software', p_name FROM part
  UNION ALL SELECT p_partkey, 306, 'DateTime', CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS VARCHAR) END FROM part) SELECT p_partkey, tag, name, value, CAST(NULL AS VARCHAR) AS error FROM t WHERE value IS NOT NULL"""

QUERIES = {"picture_exif": (tags, TAGS), "picture_coded_frames": (coded_frames, CODED), "picture_made": (made, MADE_SQL), "jpeg_segments": (segments, SEGMENTS), "jpeg_heads": (heads, HEADS), "jpeg_quant_tables": (quant_tables, QUANT), "jpeg_huffman_tables": (huffman_tables, HUFF), "jpeg_scans": (scans, SCANS), "jpeg_decoded": (decoded, DECODED), "jpeg_distortion": (distortion, DISTORTION)}
