"""Prediction, motion, interpolation and deblocking over blocks; the block before an id is its neighbour or its reference. A 4x4 block is
numbered by its block: those of block n from 4 * n on."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.functions import dims
from lumenflow.functions import scalar as S
from lumenflow.operators import planes, search
from lumenflow.operators import prediction as P
from lumenflow.operators import tables as T
from lumenflow.plans.planes import sql_diamond, sql_edge, sql_quarter

C = F.col


PARTS = [(qy, qx) for qy in (0, 1) for qx in (0, 1)]


def _line(qy: int, qx: int, at: str) -> list[str]:
    """The border of a quarter of a block, from the lowest left sample up to the corner and along eight samples above: of the block itself
    (v) where it has them, else of the block before (w). ``at`` writes a sample of one of them."""
    left = [at.format("v", 8 * (4 * qy + i) + 3) if qx else at.format("w", 8 * (4 * qy + i) + 7) for i in range(3, -1, -1)]
    corner = at.format("v", 27) if qy and qx else at.format("w", 31 if qy else 59 if qx else 63)
    return [*left, corner, *[at.format("v" if qy else "w", (24 if qy else 56) + min(4 * qx + i, 7)) for i in range(8)]]


def _pairs(spark, d):
    """(id, v, w): blocks and the block before each."""
    b = T.blocks(spark, d)
    return b.join(b.select((C("id") + 1).alias("id"), C("v").alias("w")), "id")


def _neighbours(spark, d):
    """(id, line, o): the border of every 4x4 block, and its samples."""
    own = lambda qy, qx: ", ".join(f"get(v, {8 * (4 * qy + r) + 4 * qx + c})" for r in range(4) for c in range(4))
    four = ", ".join(f"struct(array({', '.join(_line(qy, qx, 'get({}, {})'))}) AS line, array({own(qy, qx)}) AS o)" for qy, qx in PARTS)
    each = _pairs(spark, d).select("id", F.posexplode(F.expr(f"array({four})")).alias("part", "e"))
    return each.select((4 * C("id") + C("part")).alias("id"), "e.line", "e.o")


def _costs(rows):
    """An array of (cost, mode) for the nine modes."""
    made = P.intra4([C("line")[5 + i] for i in range(8)], [C("line")[3 - i] for i in range(4)], C("line")[4])
    return F.array(*[F.struct(P.sad(F.array(*p), C("o")).alias("cost"), F.lit(m).alias("mode")) for m, p in made.items()])


def intra_modes(spark, d):
    """Cost of each of the nine 4x4 modes by sums of absolute differences, the two best, and the gap between them."""
    rows = _neighbours(spark, d)
    two = rows.select("id", F.array_sort(_costs(rows)).alias("a"))
    return two.select("id", C("a")[0]["mode"].alias("best"), C("a")[0]["cost"].alias("cost"), C("a")[1]["mode"].alias("second"), (C("a")[1]["cost"] - C("a")[0]["cost"]).alias("gap"))


def widest_gap(spark, d):
    """The block of each plane whose best mode leaves the second one farthest behind; the first of equals."""
    m = T.grid(intra_modes(spark, d)).groupBy("plane").agg(F.min(F.struct((-C("gap")).alias("g"), "id", "best", "second")).alias("m"))
    return m.select("plane", "m.id", "m.best", "m.second", (-C("m.g")).alias("gap"))


def sql_modes(y: str = "y", x: str = "x", dc: str = "(p[1] + p[2] + p[3] + p[4] + p[6] + p[7] + p[8] + p[9] + 4) >> 3") -> str:
    """The nine predictors at place (y, x), written over the border line p (1-based, corner at 5)."""
    s = "((p[{0} - 1] + 2 * p[{0}] + p[least({0} + 1, 13)] + 2) >> 2)"
    m = "((p[{0}] + p[{0} + 1] + 1) >> 1)"
    text = f"""CASE mode WHEN 0 THEN p[6 + x] WHEN 1 THEN p[4 - y] WHEN 2 THEN {dc}
 WHEN 3 THEN {s.format('(7 + x + y)')} WHEN 4 THEN {s.format('(5 + x - y)')}
 WHEN 5 THEN CASE WHEN 2 * x - y = -1 THEN {s.format('5')} WHEN 2 * x - y < -1 THEN {s.format('(6 - y)')} WHEN y % 2 = 0 THEN {m.format('(5 + x - y // 2)')} ELSE {s.format('(5 + x - y // 2)')} END
 WHEN 6 THEN CASE WHEN 2 * y - x = -1 THEN {s.format('5')} WHEN 2 * y - x < -1 THEN {s.format('(4 + x)')} WHEN x % 2 = 0 THEN {m.format('(4 - y + x // 2)')} ELSE {s.format('(5 - y + x // 2)')} END
 WHEN 7 THEN CASE WHEN y % 2 = 0 THEN {m.format('(6 + x + y // 2)')} ELSE {s.format('(7 + x + y // 2)')} END
 ELSE CASE WHEN x + 2 * y > 5 THEN p[1] WHEN x + 2 * y = 5 THEN (p[2] + 3 * p[1] + 2) >> 2 WHEN x % 2 = 0 THEN (p[4 - y - x // 2] + p[3 - y - x // 2] + 1) >> 1 ELSE (p[4 - y - x // 2] + 2 * p[3 - y - x // 2] + p[2 - y - x // 2] + 2) >> 2 END END"""
    return re.sub(r"\b[xy]\b", lambda m: {"x": x, "y": y}[m[0]], text)


def _sql_parts(of) -> str:
    return "CASE part " + " ".join(f"WHEN {k} THEN [{', '.join(of(qy, qx))}]" for k, (qy, qx) in enumerate(PARTS)) + " END"


_OWN = _sql_parts(lambda qy, qx: [f"c.v[{8 * (4 * qy + r) + 4 * qx + k + 1}]" for r in range(4) for k in range(4)])
_BORDER = _sql_parts(lambda qy, qx: [f"{a[0]}.v[{int(a[1:]) + 1}]" for a in (x.replace("w", "n").replace("v", "c") for x in _line(qy, qx, "{}{}"))])
COSTS = f"""WITH {T.BLOCKS}, b AS (SELECT c.id * 4 + part AS id, {_OWN} AS o, {_BORDER} AS p FROM blocks c JOIN blocks n ON c.id = n.id + 1, (SELECT unnest(range(4)) AS part)),
g AS (SELECT id, mode, CAST(sum(abs(({sql_modes()}) - o[4 * y + x + 1])) AS INT) AS cost FROM b, (SELECT CAST(unnest(range(9)) AS INT) AS mode), (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x) GROUP BY id, mode),
"""
BEST = f"""{COSTS}r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, mode) AS k FROM g), m AS (SELECT a.id, a.mode AS best, a.cost, b.mode AS second, b.cost - a.cost AS gap FROM r a JOIN r b ON a.id = b.id AND a.k = 1 AND b.k = 2)"""
MODES = f"{BEST} SELECT * FROM m"
WIDEST = f"{BEST} SELECT plane, id, best, second, gap FROM (SELECT *, row_number() OVER (PARTITION BY plane ORDER BY gap DESC, id) AS n FROM (SELECT *, {T.GRID_OF} FROM m)) WHERE n = 1"


def intra_admissible(spark, d):
    """The cheapest mode whose neighbours exist: none to the left in the first column of a plane, none above in its first row."""
    rows = T.grid(_neighbours(spark, d))
    allowed = F.filter(_costs(rows), lambda c: S.intra4_allowed(c["mode"], C("gx") > 0, C("gy") > 0))
    return rows.select("id", F.array_min(allowed).alias("m")).select("id", "m.mode", "m.cost")


ADMISSIBLE = f"""{COSTS}ok AS (SELECT * FROM (SELECT *, {T.GRID_OF} FROM g) WHERE CASE WHEN mode IN (0, 3, 7) THEN gy > 0 WHEN mode IN (1, 8) THEN gx > 0 WHEN mode = 2 THEN true ELSE gx > 0 AND gy > 0 END)
SELECT id, CAST(min(cost * 16 + mode) % 16 AS INT) AS mode, CAST(min(cost * 16 + mode) // 16 AS INT) AS cost FROM ok GROUP BY id"""


def most_probable(spark, d):
    """The lesser of the modes to the left and above; DC where either is missing."""
    m = T.grid(intra_modes(spark, d).select("id", "best")).repartition("plane")  # one shuffle for both windows
    before = lambda along, across: F.lag(F.struct(along, "best")).over(Window.partitionBy("plane", across).orderBy(along))
    j = m.withColumn("l", before("gx", "gy")).withColumn("t", before("gy", "gx"))
    mode = lambda c, along: F.when(C(f"{c}.{along}") == C(along) - 1, C(f"{c}.best"))
    left, top = mode("l", "gx"), mode("t", "gy")
    probable = F.when(left.isNull() | top.isNull(), 2).otherwise(F.least(left, top))
    return j.select("id", "best", probable.alias("probable"), (C("best") == probable).alias("hit"))


PROBABLE = f"""{BEST}, n AS (SELECT id, best, {T.GRID_OF} FROM m), j AS (SELECT n.id, n.best, CASE WHEN l.best IS NULL OR t.best IS NULL THEN 2 ELSE least(l.best, t.best) END AS probable
 FROM n LEFT JOIN n l ON l.plane = n.plane AND l.gy = n.gy AND l.gx = n.gx - 1 LEFT JOIN n t ON t.plane = n.plane AND t.gx = n.gx AND t.gy = n.gy - 1) SELECT id, best, probable, best = probable AS hit FROM j"""


def _windows(spark, d, reach: int = 2):
    """(id, cur, w): every 4x4 block, and the samples around its place in the block before, whose border repeats."""
    side, wide = 4 + 2 * reach, 8 + 2 * reach
    pad = _pairs(spark, d).select("id", "v", planes.padded(C("w"), 8, reach).alias("w"))
    cut = lambda array, row, y, x, n: f"flatten(array({', '.join(f'slice({array}, {(y + r) * row + x + 1}, {n})' for r in range(n))}))"
    four = ", ".join(f"struct({cut('v', 8, 4 * qy, 4 * qx, 4)} AS cur, {cut('w', wide, 4 * qy, 4 * qx, side)} AS w)" for qy, qx in PARTS)
    each = pad.select("id", F.posexplode(F.expr(f"array({four})")).alias("part", "e"))
    return each.select((4 * C("id") + C("part")).alias("id"), "e.cur", "e.w")


def full_search(spark, d, reach: int = 2):
    """Best displacement of 4x4 blocks against the block before: least difference, then the shorter vector, then raster order."""
    return search.full(_windows(spark, d, reach), ["id"], 4, reach).select("id", "dx", "dy", "sad")


SEARCH = f"""WITH {T.BLOCKS}, o AS (SELECT CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
s AS (SELECT b.id * 4 + p AS id, dx, dy, b.v[y * 8 + x + 1] - n.v[greatest(0, least(7, y + dy)) * 8 + greatest(0, least(7, x + dx)) + 1] AS e
  FROM blocks b JOIN blocks n ON n.id = b.id - 1, o, (SELECT i // 8 AS y, i % 8 AS x, i // 32 * 2 + i % 8 // 4 AS p FROM (SELECT unnest(range(64)) AS i))),
g AS (SELECT id, dx, dy, CAST(sum(abs(e)) AS INT) AS sad FROM s GROUP BY ALL)
SELECT id, dx, dy, sad FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sad, abs(dx) + abs(dy), dy, dx) AS k FROM g) WHERE k = 1"""


def search_summary(spark, d):
    """Full search against a search that only looks at the nine nearest displacements: mean differences and how often they agree."""
    full = full_search(spark, d)
    near = full_search(spark, d, 1).select("id", C("dx").alias("nx"), C("dy").alias("ny"), C("sad").alias("nsad"))
    j = full.join(near, "id").withColumn("bucket", C("id") % 8)
    return j.groupBy("bucket").agg(F.sum("sad").alias("full_sad"), F.sum("nsad").alias("near_sad"), F.round(F.sum("nsad") / F.nullif(F.sum("sad").cast("double"), F.lit(0.0)), 6).alias("ratio"), F.count_if((C("dx") == C("nx")) & (C("dy") == C("ny"))).alias("same"))


SUMMARY = SEARCH[: SEARCH.index("\nSELECT id, dx, dy, sad FROM")] + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sad, abs(dx) + abs(dy), dy, dx) AS k FROM g) WHERE k = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sad, abs(dx) + abs(dy), dy, dx) AS k FROM g WHERE abs(dx) <= 1 AND abs(dy) <= 1) WHERE k = 1)
SELECT f.id % 8 AS bucket, CAST(sum(f.sad) AS BIGINT) AS full_sad, CAST(sum(n.sad) AS BIGINT) AS near_sad, round(CAST(sum(n.sad) AS DOUBLE) / nullif(CAST(sum(f.sad) AS DOUBLE), 0), 6) AS ratio, count_if(f.dx = n.dx AND f.dy = n.dy) AS same FROM f JOIN n ON f.id = n.id GROUP BY 1"""


def _each(df, **arrays):
    """(id, y, x, ...): a row for each sample of 8x8 arrays."""
    rows = df.select("id", F.posexplode_outer(F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])).alias("i", "e"))
    return rows.select("id", S.shift("i", 3).cast("long").alias("y"), C("i").bitwiseAND(7).alias("x"), *[C(f"e.{n}") for n in arrays])


def half_sample(spark, d):
    """Half samples along rows, and quarter samples beside them, in the array of the block."""
    at = lambda i, k: F.get(C("v"), S.shift(i, 3) * 8 + S.clip(i.bitwiseAND(7) + k, 0, 7))
    half = F.transform(planes.cells(64), lambda i: S.clip(S.shift(planes.six(lambda k: at(i, k)) + 16, 5)).cast("int"))
    h = T.blocks(spark, d).select("id", "v", half.alias("h"))
    rows = _each(h, h=C("h"), quarter=F.zip_with("v", "h", lambda s, p: S.shift(s + p + 1, 1)))
    return rows.select("id", "y", C("x").cast("int").alias("x"), "h", "quarter")


HALF = f"""WITH {T.BLOCKS}, c AS (SELECT id, CAST(i // 8 AS BIGINT) AS y, CAST(i % 8 AS INT) AS x, v[i + 1] AS s, list_transform(range(-2, 4), lambda k: v[i // 8 * 8 + greatest(0, least(7, i % 8 + k)) + 1]) AS t FROM blocks, (SELECT unnest(range(64)) AS i)),
h AS (SELECT id, y, x, s, CAST(greatest(0, least(255, (t[1] - 5 * t[2] + 20 * t[3] + 20 * t[4] - 5 * t[5] + t[6] + 16) >> 5)) AS INT) AS h FROM c) SELECT id, y, x, h, (s + h + 1) >> 1 AS quarter FROM h"""


def chroma_eighth(spark, d):
    """Samples three eighths to the right and five below, borders repeated, in the array of the block."""
    at = lambda i, dx, dy: F.get(C("v"), S.clip(S.shift(i, 3) + dy, 0, 7) * 8 + S.clip(i.bitwiseAND(7) + dx, 0, 7))
    made = F.transform(planes.cells(64), lambda i: P.chroma_eighth(at(i, 0, 0), at(i, 1, 0), at(i, 0, 1), at(i, 1, 1), 3, 5).cast("int"))
    return _each(T.blocks(spark, d), s=made)


EIGHTH = f"""WITH {T.BLOCKS}, c AS (SELECT id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, v[i + 1] AS a, v[i // 8 * 8 + least(7, i % 8 + 1) + 1] AS b, v[least(7, i // 8 + 1) * 8 + i % 8 + 1] AS c, v[least(7, i // 8 + 1) * 8 + least(7, i % 8 + 1) + 1] AS e FROM blocks, (SELECT unnest(range(64)) AS i))
SELECT id, y, x, CAST(greatest(0, least(255, (15 * a + 9 * b + 25 * c + 15 * e + 32) >> 6)) AS INT) AS s FROM c"""


def motion_compensated(spark, d):
    """Blocks predicted from the block before, at one of 16 phases, by a vector in quarters that the id makes; the rest after prediction."""
    j = _pairs(spark, d).withColumn("mx", (C("id") % 23 - 11).cast("int")).withColumn("my", (C("id") % 19 - 9).cast("int"))
    p = j.select("id", C("mx").bitwiseAND(3).alias("fx"), C("my").bitwiseAND(3).alias("fy"), "v", planes.quarter(planes.padded(C("w"), 8, 6), 20, 6, 8, C("mx"), C("my")).alias("p"))
    total = lambda of: F.aggregate(F.zip_with("v", "p", of), F.lit(0).cast("long"), lambda s, r: s + r)
    return p.select("id", "fx", "fy", total(lambda s, q: s - q).alias("residual"), total(lambda s, q: F.abs(s - q)).alias("sad"))


COMPENSATED = f"""WITH {T.BLOCKS}, m AS (SELECT b.id, i // 8 AS y, i % 8 AS x, b.v[i + 1] AS s, n.v AS p, CAST(b.id % 23 - 11 AS INT) AS mx, CAST(b.id % 19 - 9 AS INT) AS my FROM blocks b JOIN blocks n ON n.id = b.id - 1, (SELECT unnest(range(64)) AS i)),
c AS (SELECT id, mx & 3 AS fx, my & 3 AS fy, s - ({sql_quarter('p[greatest(0, least(7, y + (my >> 2) + {0})) * 8 + greatest(0, least(7, x + (mx >> 2) + {1})) + 1]', 'mx & 3', 'my & 3')}) AS r FROM m)
SELECT id, fx, fy, CAST(sum(r) AS BIGINT) AS residual, CAST(sum(abs(r)) AS BIGINT) AS sad FROM c GROUP BY ALL"""


def deblocked(spark, d, index: int = 40):
    """Rows of blocks as eight samples across an edge, filtered by strength 0 to 4."""
    b = T.blocks(spark, d).select("id", F.posexplode(F.sequence(F.lit(0), F.lit(7))).alias("y", "_"), "v")
    p, q = [f"p{i}" for i in range(4)], [f"q{i}" for i in range(4)]
    half = lambda i: S.div(F.get(C("v"), C("y") * 8 + i), 4).cast("int")
    edge = b.select("id", "y", *[(96 + half(3 - i)).alias(p[i]) for i in range(4)], *[(96 + half(4 + i)).alias(q[i]) for i in range(4)], ((C("id") + C("y")) % 5).cast("int").alias("strength"))
    return P.deblock(edge, p, q, "strength", index, ["id", "y", "strength"])


def _deblock_sql(index: int = 40) -> str:
    out = sql_edge(str(dims.ALPHA[index]), str(dims.BETA[index]), [str(x[index]) for x in P.TC0])
    rows = ", ".join(f"96 + v[y * 8 + {4 - i}] // 4 AS p{i}, 96 + v[y * 8 + {5 + i}] // 4 AS q{i}" for i in range(4))
    return f"WITH {T.BLOCKS}, e AS (SELECT id, CAST(y AS INT) AS y, CAST((id + y) % 5 AS INT) AS strength, {rows} FROM blocks, (SELECT unnest(range(8)) AS y)) SELECT id, y, strength, {', '.join(f'CAST({e} AS INT) AS {c}' for c, e in out.items())}, p3, q3 FROM e"


def residual_added(spark, d):
    """Prediction plus residual, clipped: blocks with the differences to the block before added twice."""
    j = _pairs(spark, d)
    sums = P.add_residual(C("v"), F.zip_with("v", "w", lambda p, q: p - q))
    return j.select("id", F.aggregate(sums, F.lit(0), lambda s, x: s + x).alias("total"), F.size(F.filter(sums, lambda x: (x == 0) | (x == 255))).alias("clipped"))


ADDED = f"""WITH {T.BLOCKS}, s AS (SELECT b.id, list_transform(range(1, 65), lambda i: greatest(0, least(255, 2 * b.v[i] - n.v[i]))) AS s FROM blocks b JOIN blocks n ON n.id = b.id - 1)
SELECT id, CAST(list_sum(s) AS INT) AS total, CAST(len(list_filter(s, lambda x: x = 0 OR x = 255)) AS INT) AS clipped FROM s"""


def diamond(spark, d):
    """Diamond search of the same blocks as the full search."""
    return search.diamond(_windows(spark, d), ["id"], 4, 2)


DIAMOND = SEARCH.replace("WITH ", "WITH RECURSIVE ", 1)[: SEARCH.index("SELECT id, dx, dy, sad FROM") + len("RECURSIVE ")] + f""", d AS MATERIALIZED (SELECT *, abs(dx) + abs(dy) AS cost FROM g), {sql_diamond('d', 2, 'id')}
SELECT id, dx, dy, CAST(sad AS INT) AS sad, CAST(points AS INT) AS points FROM walked"""

QUERIES = {
    "motion_diamond": (diamond, DIAMOND),
    "intra_modes": (intra_modes, MODES), "intra_widest_gap": (widest_gap, WIDEST), "intra_admissible": (intra_admissible, ADMISSIBLE), "intra_most_probable": (most_probable, PROBABLE), "motion_full_search": (full_search, SEARCH), "motion_summary": (search_summary, SUMMARY),
    "motion_half_sample": (half_sample, HALF), "motion_chroma_eighth": (chroma_eighth, EIGHTH), "motion_compensated": (motion_compensated, COMPENSATED), "deblock_edges": (deblocked, _deblock_sql()), "residual_added": (residual_added, ADDED),
}
