"""Residuals of 4x4 blocks as CAVLC text, and back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.functions import dims
from lumenflow.functions import scalar as S
from lumenflow.operators import cavlc
from lumenflow.operators import tables as T
from lumenflow.operators import transforms as X
from lumenflow.plans import blocks as B

C = F.col
ZZ4 = "[" + ", ".join(str(i) for i in dims.zigzag(4)) + "]"


def scanned(spark, d):
    """(id, nc, z, plane, gy, gx, total): quantised levels of a 4x4 residual in zigzag order, its place in the plane, its non-zero levels and
    the context that the blocks to the left and above make; a block without a neighbour does without."""
    z = B.levels4(spark, d).select("id", F.transform("intra", lambda v: v.cast("int")).alias("a")).select("id", X.zigzag("a", 4).alias("z"))
    rows = T.grid(z.select("id", "z", F.size(F.filter("z", lambda v: v != 0)).alias("total"))).repartition("plane")  # one shuffle for both windows
    before = lambda along, across: F.lag(F.struct(along, "total")).over(Window.partitionBy("plane", across).orderBy(along))
    rows = rows.withColumn("l", before("gx", "gy")).withColumn("t", before("gy", "gx"))
    count = lambda c, along: F.when(C(f"{c}.{along}") == C(along) - 1, C(f"{c}.total"))
    return rows.select("id", S.coefficient_context(count("l", "gx"), count("t", "gy")).cast("int").alias("nc"), "z", "plane", "gy", "gx", "total")


def _levels(spark, d):
    return scanned(spark, d).select("id", "nc", "z")


def _chroma(spark, d):
    """(id, z): the first levels of the four 4x4 blocks of a block, as chroma DC."""
    rows = B.levels4(spark, d).select(F.expr("id div 4").alias("id"), F.struct((C("id") % 4).alias("k"), F.get("intra", F.lit(0)).cast("int").alias("v")).alias("e"))
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["v"]).alias("z"))


def _fours(spark, d):
    """(id, k, z): all levels of a block by fours. Of its four 4x4 blocks, k from 0 to 15 are four successive levels in zigzag order each, and
    16 is their first levels, as chroma DC."""
    z = B.levels4(spark, d).select("id", F.transform("intra", lambda v: v.cast("int")).alias("a")).select("id", X.zigzag("a", 4).alias("z"))
    rows = z.groupBy(F.expr("id div 4").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((C("id") % 4).alias("k"), "z"))), lambda e: e["z"]).alias("b"))
    flat = rows.select("id", F.flatten("b").alias("z"))
    fours = [F.slice("z", 4 * k + 1, 4) for k in range(16)] + [F.array(*[F.get("z", F.lit(16 * k)) for k in range(4)])]
    return flat.select("id", F.posexplode(F.array(*fours)).alias("k", "z"))


def text(spark, d):
    """Text of every block, and the bits of its parts."""
    return _bits(cavlc.encode(_levels(spark, d)), ["id", "nc"])


def chroma_text(spark, d):
    """All levels of every block by fours, in the form of chroma DC; k = 16 is chroma DC itself."""
    return _bits(cavlc.encode(_fours(spark, d), keep=["id", "k"], chroma=True), ["id", "k"])


def _bits(df, keep):
    return df.select(*keep, "total", "ones", "zeros", *[F.length(c).alias(f"bits_{c}") for c in ("token", "signs", "levels", "zero_word", "runs")], "text")


def _shown(found):
    return found.select("id", F.array_join(F.transform("z", lambda v: v.cast("string")), ",").alias("z"), "used", "error")


def back(spark, d):
    """Levels read back out of the text, and the bits that it has."""
    return _shown(cavlc.decode(cavlc.encode(_levels(spark, d))))


def chroma_back(spark, d):
    return _shown(cavlc.decode(cavlc.encode(_chroma(spark, d), keep=["id"], chroma=True), chroma=True))


def pattern(spark, d):
    """Coded block pattern of every macroblock, and how many of its blocks the guard lets through."""
    z = scanned(spark, d).select((C("plane") * 16 + S.shift("gy", 2) * 4 + S.shift("gx", 2)).alias("mb"), (S.shift("gy", 1).bitwiseAND(1) * 2 + S.shift("gx", 1).bitwiseAND(1)).alias("part"), C("total").alias("n"), cavlc.encodable("z", C("nc")).alias("good"))
    good = z.groupBy("mb").agg(F.count_if("good").alias("encodable"))
    return cavlc.coded_pattern(z, ["mb"], "part", "n").join(good, "mb")


LEVELS = f"""{B.FWD}, lev AS (SELECT id, (i - 1) * 4 + j - 1 AS k, CAST({B.LEVELQ.format(f=(1 << 19) // 3)} AS INT) AS q FROM (SELECT id, i, j, CAST(w AS BIGINT) AS w FROM cell)),
z AS (SELECT id, list_position({ZZ4}, k) - 1 AS pos, q AS v FROM lev)"""
CONTEXTS = f"""{LEVELS}, grid AS (SELECT id, {T.GRID_OF}, n FROM (SELECT id, count_if(v <> 0) AS n FROM z GROUP BY id)),
ids AS (SELECT g.*, CAST(CASE WHEN l.n IS NOT NULL AND t.n IS NOT NULL THEN (l.n + t.n + 1) >> 1 ELSE coalesce(l.n, t.n, 0) END AS INT) AS nc FROM grid g LEFT JOIN grid l ON l.plane = g.plane AND l.gy = g.gy AND l.gx = g.gx - 1 LEFT JOIN grid t ON t.plane = g.plane AND t.gx = g.gx AND t.gy = g.gy - 1)"""
CHROMA = f"{LEVELS.replace('z AS (', 'z4 AS (')}, z AS (SELECT id // 4 AS id, id % 4 AS pos, v FROM z4 WHERE pos = 0), ids AS (SELECT DISTINCT id, -1 AS nc FROM z)"

FOURS = f"""{LEVELS.replace('z AS (', 'z4 AS (')}, z AS (SELECT id // 4 * 17 + id % 4 * 4 + pos // 4 AS id, pos % 4 AS pos, v FROM z4 UNION ALL SELECT id // 4 * 17 + 16 AS id, id % 4 AS pos, v FROM z4 WHERE pos = 0), ids AS (SELECT DISTINCT id, -1 AS nc FROM z)"""


def _values(name, rows):
    return f"{name}(a, b, w) AS (VALUES " + ", ".join(f"({a}, {b}, '{w}')" for a, row in enumerate(rows) for b, w in enumerate(row)) + ")"


def _sql(chroma):
    many = 4 if chroma else 16
    contexts = (-1,) if chroma else (0, 2, 4, 8)
    tokens = "token(c, a, b, w) AS (VALUES " + ", ".join(f"({c}, {a}, {b}, '{w}')" for c in contexts for a, row in enumerate(cavlc.token_words(c)) for b, w in enumerate(row)) + ")"
    zeros = _values("zero", cavlc.words(cavlc.CHROMA_ZEROS if chroma else cavlc.ZEROS))
    runs = _values("run", cavlc.words(cavlc.RUNS))
    return f"""WITH RECURSIVE {CHROMA if chroma else CONTEXTS}, {tokens}, {zeros}, {runs},
lv AS (SELECT id, pos, v, row_number() OVER (PARTITION BY id ORDER BY pos DESC) - 1 AS k, lead(pos) OVER (PARTITION BY id ORDER BY pos DESC) AS below FROM z WHERE v <> 0 AND pos < {many}),
b AS (SELECT id, nc, count(v) AS total, least(3, coalesce(min(k) FILTER (WHERE abs(v) <> 1), count(v))) AS ones, coalesce(max(pos) + 1 - count(v), 0) AS zeros, CASE WHEN nc < 4 THEN CASE WHEN nc < 0 THEN nc ELSE nc // 2 * 2 END WHEN nc < 8 THEN 4 ELSE 8 END AS c FROM ids LEFT JOIN lv USING (id) GROUP BY id, nc),
st(id, k, s) AS (SELECT id, ones, CASE WHEN total > 10 AND ones < 3 THEN 1 ELSE 0 END FROM b WHERE total > ones
  UNION ALL SELECT st.id, st.k + 1, greatest(st.s, 1) + CASE WHEN abs(lv.v) > 3 * 2 ** (greatest(st.s, 1) - 1) AND greatest(st.s, 1) < 6 THEN 1 ELSE 0 END FROM st JOIN lv USING (id, k)),
code AS (SELECT id, k, s, CAST(CASE WHEN v > 0 THEN 2 * v - 2 ELSE -2 * v - 1 END - CASE WHEN k = ones AND ones < 3 THEN 2 ELSE 0 END AS BIGINT) AS code FROM st JOIN lv USING (id, k) JOIN b USING (id)),
lw AS (SELECT id, string_agg(CASE WHEN s = 0 AND code < 14 THEN repeat('0', code) || '1' WHEN s = 0 AND code < 30 THEN repeat('0', 14) || '1' || lpad(bin(code - 14), 4, '0')
  WHEN s > 0 AND code < 15 * (1 << s) THEN repeat('0', code // (1 << s)) || '1' || lpad(bin(code % (1 << s)), s, '0')
  ELSE repeat('0', length(bin(code - CASE WHEN s = 0 THEN 30 ELSE 15 * (1 << s) END + 4096)) + 2) || '1' || substr(bin(code - CASE WHEN s = 0 THEN 30 ELSE 15 * (1 << s) END + 4096), 2) END, '' ORDER BY k) AS w FROM code GROUP BY id),
sw AS (SELECT id, string_agg(CASE WHEN v < 0 THEN '1' ELSE '0' END, '' ORDER BY k) AS w FROM lv JOIN b USING (id) WHERE k < ones GROUP BY id),
rw AS (SELECT id, string_agg(run.w, '' ORDER BY k) AS w FROM lv JOIN b USING (id) JOIN run ON run.a = least(pos - (total - 1 - k), 7) - 1 AND run.b = pos - below - 1 WHERE k < total - 1 GROUP BY id),
parts AS (SELECT b.*, token.w AS t, coalesce(sw.w, '') AS sg, coalesce(lw.w, '') AS l, coalesce(zero.w, '') AS zw, coalesce(rw.w, '') AS r FROM b JOIN token ON token.c = b.c AND token.a = total AND token.b = ones
  LEFT JOIN zero ON zero.a = total - 1 AND zero.b = zeros AND total < {many} LEFT JOIN lw USING (id) LEFT JOIN sw USING (id) LEFT JOIN rw USING (id))
SELECT id, {'' if chroma else 'nc, '}CAST(total AS INT) AS total, CAST(ones AS INT) AS ones, CAST(zeros AS INT) AS zeros, CAST(length(t) AS INT) AS bits_token, CAST(length(sg) AS INT) AS bits_signs, CAST(length(l) AS INT) AS bits_levels,
 CAST(length(zw) AS INT) AS bits_zero_word, CAST(length(r) AS INT) AS bits_runs, t || sg || l || zw || r AS text FROM parts"""


def _fours_sql():
    """All seventeen fours of a block, whose numbers go with the block's."""
    head, cut, tail = _sql(True).replace(CHROMA, FOURS).rpartition("SELECT id, ")
    return f"{head}SELECT id // 17 AS id, CAST(id % 17 AS INT) AS k, {tail}"


def _back(chroma):
    """The levels themselves, and the bits of their text."""
    head, cut, tail = _sql(chroma).rpartition("SELECT id, ")
    return f"{head.rstrip()}, fin AS ({cut}{tail}), zs AS (SELECT id, string_agg(v, ',' ORDER BY pos) AS z FROM z GROUP BY id) SELECT id, z, CAST(length(text) AS INT) AS used, CAST(NULL AS VARCHAR) AS error FROM fin JOIN zs USING (id)"


PATTERN = f"""WITH {CONTEXTS} SELECT plane * 16 + gy // 4 * 4 + gx // 4 AS mb, CAST(bit_or(CASE WHEN n > 0 THEN 1 << (gy // 2 % 2 * 2 + gx // 2 % 2) ELSE 0 END) AS INT) AS pattern, CAST(count_if(n <> 4 AND nc NOT BETWEEN 4 AND 7) AS BIGINT) AS encodable FROM ids GROUP BY 1"""

QUERIES = {"h264_cavlc": (text, _sql(False)), "h264_cavlc_chroma": (chroma_text, _fours_sql()), "h264_cavlc_back": (back, _back(False)), "h264_cavlc_chroma_back": (chroma_back, _back(True)), "h264_coded_pattern": (pattern, PATTERN)}
