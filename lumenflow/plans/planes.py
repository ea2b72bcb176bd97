"""Motion over planes of macroblocks. The other picture is a copy of the plane, moved by a vector that its number makes, with noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.functions import dims
from lumenflow.functions import scalar as S
from lumenflow.operators import deblock
from lumenflow.operators import planes as P
from lumenflow.operators import search as Q
from lumenflow.operators import tables as T
from lumenflow.operators.prediction import TC0

C = F.col
KEEP = ["plane", "y", "x"]


def pictures(spark, d):
    """(plane, y, x, high, wide, w, cur): macroblocks of the moved copy, and the window of the plane around each."""
    p = C("plane")
    return P.moved(P.windows(T.planes(spark, d)), p % 11 - 5, p % 7 - 3, p + 4660)


def moved_text(spark, d):
    """Samples of the moved copies, macroblock by macroblock."""
    return pictures(spark, d).select(*KEEP, F.array_join(F.transform("cur", lambda v: v.cast("string")), ",").alias("samples"))


#: The generator step by step, all planes together; cur is the moved copy.
CURRENT = f"""{T.PLANES}, lcg(plane, k, s) AS (SELECT DISTINCT plane, CAST(0 AS BIGINT), ((4660 + plane) * 1103515245 + 12345) % 4294967296 FROM plane UNION ALL SELECT plane, k + 1, (s * 1103515245 + 12345) % 4294967296 FROM lcg WHERE k < 4095),
cur AS (SELECT l.plane, l.k, l.k // 64 AS y, l.k % 64 AS x, greatest(0, least(255, r.s + (l.s >> 16 & 32767) % 7 - 3)) AS s
  FROM lcg l JOIN plane r ON r.plane = l.plane AND r.k = greatest(0, least(63, l.k // 64 - (l.plane % 7 - 3))) * 64 + greatest(0, least(63, l.k % 64 - (l.plane % 11 - 5))))"""
MOVED = f"WITH RECURSIVE {CURRENT} SELECT plane, CAST(y // 16 AS INT) AS y, CAST(x // 16 AS INT) AS x, string_agg(s, ',' ORDER BY k) AS samples FROM cur GROUP BY ALL"

_PART = lambda j: " + ".join(f"r[i + {4 * j + k}] - c[{4 * j + k}]" for k in range(1, 5))
#: A line of a macroblock against the line of the plane that a vector leads to; gap sums what the parts of four by four differ in sum.
SADS = f"""{CURRENT}, line AS (SELECT plane, y, x // 16 AS tx, list(s ORDER BY x) AS c FROM cur GROUP BY ALL),
wide AS (SELECT p.plane, p.k // 64 AS y, list(p.s ORDER BY t.x) AS r FROM (SELECT unnest(range(-16, 80)) AS x) t JOIN plane p ON p.k % 64 = greatest(0, least(63, t.x)) GROUP BY ALL),
o AS (SELECT CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy FROM (SELECT unnest(range(-16, 17)) AS dx), (SELECT unnest(range(-16, 17)) AS dy)),
pair AS (SELECT l.plane, l.y, tx, dx, dy, tx * 16 + 16 + dx AS i, c, r FROM line l CROSS JOIN o JOIN wide w ON w.plane = l.plane AND w.y = greatest(0, least(63, l.y + dy))),
q AS (SELECT plane, y // 16 AS y, tx AS x, dx, dy, y // 4 AS v, sum({" + ".join(f"abs(r[i + {k}] - c[{k}])" for k in range(1, 17))}) AS sad, {" + ".join(f"abs(sum({_PART(j)}))" for j in range(4))} AS gap FROM pair GROUP BY ALL),
sads AS MATERIALIZED (SELECT plane, y, x, dx, dy, abs(dx) + abs(dy) AS cost, sum(sad) AS sad, sum(gap) AS gap FROM q GROUP BY ALL)"""
FULL = f"""{SADS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY plane, y, x ORDER BY sad, cost, dy, dx) AS k, coalesce(gap < min(sad) OVER (PARTITION BY plane, y, x ORDER BY cost, dy, dx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS look FROM sads),
looks AS (SELECT plane, y, x, count_if(look) AS looked FROM ranked GROUP BY ALL), best AS (SELECT plane, y, x, dx, dy, sad, looked FROM ranked JOIN looks USING (plane, y, x) WHERE k = 1)"""


def full(spark, d):
    """Best vector of every macroblock within 16 samples, and how many of the 1,089 places had to be compared."""
    return Q.full(pictures(spark, d), KEEP).select(*KEEP, "dx", "dy", "sad", "looked", F.round(1 - C("looked") / 1089.0, 6).alias("ruled_out"))


FULL_SQL = f"WITH RECURSIVE {FULL} SELECT plane, CAST(y AS INT) AS y, CAST(x AS INT) AS x, dx, dy, CAST(sad AS INT) AS sad, CAST(looked AS INT) AS looked, round(1 - looked / 1089.0::DOUBLE, 6) AS ruled_out FROM best"


def _pattern(name: str, places) -> str:
    return f"{name}(k, px, py) AS (VALUES " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(places)) + ")"


def sql_diamond(sads: str, reach: int, key: str) -> str:
    """Walks of all blocks, a step of each at a time, over a table of differences (key, dx, dy, cost, sad)."""
    on = " AND ".join(f"s.{k} = w.{k}" for k in key.split(", "))
    w = ", ".join(f"w.{k}" for k in key.split(", "))
    inside = f"greatest(abs(cx + px), abs(cy + py)) <= {reach}"
    chosen = lambda pattern: f"(SELECT *, row_number() OVER (PARTITION BY {key}, step ORDER BY sad, cost, k) AS r FROM (SELECT {w}, w.step, s.dx, s.dy, s.sad, s.cost, p.k FROM {{}} w CROSS JOIN (SELECT * FROM {pattern} UNION ALL SELECT -1, 0, 0) p JOIN {sads} s ON {on} AND s.dx = w.cx + p.px AND s.dy = w.cy + p.py WHERE {inside}))"
    return f"""{_pattern('large', Q.LARGE)}, {_pattern('small', Q.SMALL)},
walk({key}, step, cx, cy, last) AS (SELECT DISTINCT {key}, 0, 0, 0, false FROM {sads} UNION ALL SELECT {key}, step + 1, dx, dy, k < 0 FROM {chosen('large').format('(SELECT * FROM walk WHERE NOT last)')} WHERE r = 1),
settled AS (SELECT * FROM walk w WHERE last), ends AS (SELECT {key}, dx, dy, sad FROM {chosen('small').format('settled')} WHERE r = 1),
seen AS (SELECT {key}, cx + px AS sx, cy + py AS sy FROM walk w CROSS JOIN (SELECT px, py FROM large UNION ALL SELECT 0, 0) WHERE NOT last AND {inside} UNION SELECT {key}, cx + px, cy + py FROM settled, small WHERE {inside}),
points AS (SELECT {key}, count(*) AS points FROM seen GROUP BY ALL), walked AS (SELECT * FROM ends JOIN points USING ({key}))"""


def diamond(spark, d):
    """The diamond search of the same macroblocks."""
    return Q.diamond(pictures(spark, d), KEEP)


DIAMOND = f"{SADS}, {sql_diamond('sads', 16, 'plane, y, x')}"
DIAMOND_SQL = f"WITH RECURSIVE {DIAMOND} SELECT plane, CAST(y AS INT) AS y, CAST(x AS INT) AS x, dx, dy, CAST(sad AS INT) AS sad, CAST(points AS INT) AS points FROM walked"


def summary(spark, d):
    """Full search against diamond search, by plane: mean places and differences, speed-up and how often the vectors agree."""
    both = pictures(spark, d)
    full_ = Q.full(both, KEEP).select(*KEEP, C("dx").alias("fx"), C("dy").alias("fy"), C("sad").alias("full_sad"), "looked")
    j = Q.diamond(both, KEEP).join(full_, KEEP)
    n = F.count(F.lit(1))
    mean = lambda c: F.round(F.sum(c) / n, 4)
    return j.groupBy("plane").agg(
        n.alias("blocks"), F.lit(1089).alias("full_points"), mean("looked").alias("mean_looked"), mean("points").alias("mean_points"), mean("full_sad").alias("mean_full_sad"), mean("sad").alias("mean_sad"),
        F.round(1089.0 * n / F.sum("points"), 4).alias("speedup"), F.round(F.sum("sad") / F.nullif(F.sum("full_sad").cast("double"), F.lit(0.0)), 6).alias("sad_ratio"), F.count_if((C("dx") == C("fx")) & (C("dy") == C("fy"))).alias("same"),
    )


SUMMARY = f"""WITH RECURSIVE {FULL}, {sql_diamond('sads', 16, 'plane, y, x')}, j AS (SELECT plane, b.dx = w.dx AND b.dy = w.dy AS same, b.sad AS full_sad, w.sad, looked, points FROM best b JOIN walked w USING (plane, y, x))
SELECT plane, count(*) AS blocks, 1089 AS full_points, round(sum(looked)::DOUBLE / count(*), 4) AS mean_looked, round(sum(points)::DOUBLE / count(*), 4) AS mean_points, round(sum(full_sad)::DOUBLE / count(*), 4) AS mean_full_sad, round(sum(sad)::DOUBLE / count(*), 4) AS mean_sad,
 round(1089.0::DOUBLE * count(*) / sum(points)::DOUBLE, 4) AS speedup, round(sum(sad)::DOUBLE / nullif(sum(full_sad)::DOUBLE, 0), 6) AS sad_ratio, count_if(same) AS same FROM j GROUP BY plane"""


def costs(spark, d):
    """SAD and SATD of every macroblock against the plane at its own place, and at the place that the moved copy came from."""
    p = pictures(spark, d)
    at = lambda dx, dy: P.macroblock(C("w"), dx, dy)
    zero = F.lit(0)
    j = p.select(*KEEP, "cur", at(zero, zero).alias("here"), at(-(C("plane") % 11 - 5), -(C("plane") % 7 - 3)).alias("there"))
    return j.select(*KEEP, *[f("cur", c).alias(f"{n}_{c}") for n, f in (("sad", lambda a, b: P.sad16(C(a), C(b))), ("satd", lambda a, b: P.satd16(C(a), C(b)))) for c in ("here", "there")])


def _cost_sql() -> str:
    h = "[" + ", ".join(map(str, P.HADAMARD)) + "]"
    place = {"here": ("c.y", "c.x"), "there": ("c.y - (c.plane % 7 - 3)", "c.x - (c.plane % 11 - 5)")}
    parts = ", ".join(f"""{n} AS (SELECT c.plane, c.y // 4 AS v, c.x // 4 AS u, list(c.s - r.s ORDER BY c.k) AS a FROM cur c JOIN plane r ON r.plane = c.plane AND r.k = greatest(0, least(63, {y})) * 64 + greatest(0, least(63, {x})) GROUP BY ALL),
cost_{n} AS (SELECT plane, v // 4 AS y, u // 4 AS x, sum(list_sum(list_transform(a, lambda e: abs(e)))) AS sad, sum((list_sum(list_transform(range(16), lambda k: abs(list_sum(list_transform(range(16), lambda i: {h}[k * 16 + i + 1] * a[i + 1])))))::BIGINT + 1) >> 1) AS satd FROM {n} GROUP BY ALL)""" for n, (y, x) in place.items())
    return f"WITH RECURSIVE {CURRENT}, {parts} SELECT plane, CAST(h.y AS INT) AS y, CAST(h.x AS INT) AS x, CAST(h.sad AS INT) AS sad_here, CAST(t.sad AS INT) AS sad_there, CAST(h.satd AS INT) AS satd_here, CAST(t.satd AS INT) AS satd_there FROM cost_here h JOIN cost_there t USING (plane, y, x)"


COSTS = _cost_sql()


def sql_quarter(get: str, fx: str, fy: str) -> str:
    """A quarter sample as SQL; ``get`` has {0} and {1} for the steps down and right of a whole sample."""
    g = lambda y, x: get.format(y, x)
    six = lambda at: f"({at(-2)} - 5 * {at(-1)} + 20 * {at(0)} + 20 * {at(1)} - 5 * {at(2)} + {at(3)})"
    clip = lambda v: f"greatest(0, least(255, {v}))"
    across = lambda y, x: clip(f"({six(lambda k: g(y, x + k))} + 16) >> 5")
    down = lambda y, x: clip(f"({six(lambda k: g(y + k, x))} + 16) >> 5")
    centre = clip("(" + six(lambda r: six(lambda k: g(r, k))) + " + 512) >> 10")
    mean = lambda a, b: f"({a} + {b} + 1) >> 1"
    b, h, r, s = across(0, 0), down(0, 0), down(0, 1), across(1, 0)
    cases = [g(0, 0), mean(g(0, 0), b), b, mean(g(0, 1), b), mean(g(0, 0), h), mean(b, h), mean(b, centre), mean(b, r), h, mean(h, centre), centre, mean(centre, r), mean(g(1, 0), h), mean(h, s), mean(centre, s), mean(r, s)]
    return f"CASE 4 * ({fy}) + ({fx}) " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


def compensated(spark, d):
    """Macroblocks predicted from the plane by vectors in quarter samples, each at its own of 16 phases: the prediction and the rest."""
    k = C("plane") * 16 + C("y") * 4 + C("x")
    j = pictures(spark, d).withColumn("mx", (k * 7 % 45 - 22).cast("int")).withColumn("my", (k * 11 % 43 - 21).cast("int"))
    p = j.select(*KEEP, C("mx").bitwiseAND(3).alias("fx"), C("my").bitwiseAND(3).alias("fy"), "cur", P.quarter(C("w"), P.WINDOW, P.TILE, P.TILE, C("mx"), C("my")).alias("p"))
    rest = F.aggregate(F.zip_with("cur", "p", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)
    return p.select(*KEEP, "fx", "fy", rest.alias("sad"), F.array_join(F.transform("p", lambda v: v.cast("string")), ",").alias("samples"))


COMPENSATED = f"""WITH RECURSIVE {CURRENT}, l AS (SELECT plane, list(s ORDER BY k) AS p FROM plane GROUP BY plane),
m AS (SELECT plane, k, y // 16 AS ty, x // 16 AS tx, y, x, s, (plane * 16 + y // 16 * 4 + x // 16) * 7 % 45 - 22 AS mx, (plane * 16 + y // 16 * 4 + x // 16) * 11 % 43 - 21 AS my FROM cur),
c AS (SELECT m.*, CAST({sql_quarter('p[greatest(0, least(63, y + (my >> 2) + {0})) * 64 + greatest(0, least(63, x + (mx >> 2) + {1})) + 1]', 'mx & 3', 'my & 3')} AS INT) AS v FROM m JOIN l USING (plane))
SELECT plane, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, CAST(mx & 3 AS INT) AS fx, CAST(my & 3 AS INT) AS fy, CAST(sum(abs(s - v)) AS INT) AS sad, string_agg(v, ',' ORDER BY k) AS samples FROM c GROUP BY ALL"""

def marked(spark, d):
    """(plane, y, x, high, wide, v, outer, inner, index): macroblocks with the strengths of the edges before them and within, and the index
    of thresholds, which their number makes."""
    k = C("plane") * 16 + C("y") * 4 + C("x")
    intra = k % 7 != 0
    t = T.planes(spark, d)
    strength = lambda outer: S.boundary_strength(intra, F.lit(outer), k % 2 == 0, k % 3 == 0, F.lit(0)).cast("int")
    return t.select("*", strength(True).alias("outer"), strength(False).alias("inner"), (24 + k * 5 % 24).cast("int").alias("index"))


def deblocked(spark, d):
    """Whole planes filtered: all edges from left to right, then all from top to bottom."""
    found = deblock.planes(marked(spark, d))
    return found.select(*KEEP, F.array_join(F.transform("v", lambda v: v.cast("string")), ",").alias("samples"))


def deblocked_chroma(spark, d):
    """The same planes filtered as chroma, two samples at an edge: sums by macroblock."""
    found = deblock.planes(marked(spark, d), chroma=True)
    return found.select(*KEEP, F.aggregate("v", F.lit(0), lambda s, v: s + v).alias("total"), F.aggregate(F.transform("v", lambda v, i: v * (i + 1)), F.lit(0), lambda s, v: s + v).alias("weighted"))


def sql_edge(a: str, b: str, t: list[str], chroma: bool = False) -> dict[str, str]:
    """New samples of an edge (p3..p0, q0..q3) of a strength, with thresholds a and b and the bounds t of strengths 1 to 3."""
    near = lambda s: f"abs({s}2 - {s}0) < {b}"
    tc0 = f"(CASE strength WHEN 1 THEN {t[0]} WHEN 2 THEN {t[1]} ELSE {t[2]} END)"
    clip = lambda v, lo, hi: f"greatest({lo}, least({hi}, {v}))"
    on = f"strength > 0 AND abs(p0 - q0) < {a} AND abs(p1 - p0) < {b} AND abs(q1 - q0) < {b}"
    tc = f"({tc0} + 1)" if chroma else f"({tc0} + CASE WHEN {near('p')} THEN 1 ELSE 0 END + CASE WHEN {near('q')} THEN 1 ELSE 0 END)"
    move = clip("((q0 - p0) * 4 + (p1 - q1) + 4) >> 3", f"-{tc}", tc)
    out = {}
    for s, o, sign in (("p", "q", "+"), ("q", "p", "-")):
        close = "false" if chroma else f"{near(s)} AND abs(p0 - q0) < (({a}) >> 2) + 2"
        inner = f"{s}1 + " + clip(f"({s}2 + ((p0 + q0 + 1) >> 1) - 2 * {s}1) >> 1", f"-{tc0}", tc0)
        out[f"{s}0"] = f"CASE WHEN NOT ({on}) THEN {s}0 WHEN strength = 4 THEN CASE WHEN {close} THEN ({s}2 + 2 * {s}1 + 2 * {s}0 + 2 * {o}0 + {o}1 + 4) >> 3 ELSE (2 * {s}1 + {s}0 + {o}1 + 2) >> 2 END ELSE {clip(f'{s}0 {sign} {move}', 0, 255)} END"
        out[f"{s}1"] = f"{s}1" if chroma else f"CASE WHEN NOT ({on}) THEN {s}1 WHEN strength = 4 THEN CASE WHEN {close} THEN ({s}2 + {s}1 + {s}0 + {o}0 + 2) >> 2 ELSE {s}1 END ELSE CASE WHEN {near(s)} THEN {inner} ELSE {s}1 END END"
        out[f"{s}2"] = f"{s}2" if chroma else f"CASE WHEN NOT ({on}) OR strength < 4 THEN {s}2 WHEN {close} THEN (2 * {s}3 + 3 * {s}2 + {s}1 + {s}0 + {o}0 + 4) >> 3 ELSE {s}2 END"
    return out


def _passes(chroma: bool) -> str:
    """Lines of the planes, filtered edge by edge across and then down; fin has the samples."""
    lists = lambda values: "[" + ", ".join(map(str, values)) + "]"
    e = sql_edge("a", "b", ["t[1]", "t[2]", "t[3]"], chroma)
    mark = "greatest(0, least(4, CASE WHEN m % 7 <> 0 THEN CASE WHEN e % 4 = 0 THEN 4 ELSE 3 END WHEN m % 2 = 0 THEN 2 WHEN m % 3 = 0 THEN 1 ELSE 0 END)) AS strength, 24 + m * 5 % 24 AS i"

    def one(name: str, source: str, block: str) -> str:
        samples = ", ".join(f"l[4 * e - {k}] AS p{k}, l[4 * e + {k + 1}] AS q{k}" for k in range(4))
        looked = f"(SELECT *, {lists(dims.ALPHA)}[i + 1] AS a, {lists(dims.BETA)}[i + 1] AS b, [{', '.join(f'{lists(t)}[i + 1]' for t in TC0)}] AS t FROM (SELECT *, {mark} FROM (SELECT *, {samples}, plane * 16 + {block} AS m FROM {name} WHERE e < 16)))"
        return f"{name}(plane, n, e, l) AS (SELECT plane, n, 1, l FROM {source} UNION ALL SELECT plane, n, e + 1, l[1 : 4 * e - 3] || [{', '.join(f'CAST({e[c]} AS BIGINT)' for c in ('p2', 'p1', 'p0', 'q0', 'q1', 'q2'))}] || l[4 * e + 4 : 64] FROM {looked})"

    return f"""across0 AS (SELECT plane, k // 64 AS n, list(CAST(s AS BIGINT) ORDER BY k) AS l FROM plane GROUP BY ALL), {one('across', 'across0', '(n // 16) * 4 + e // 4')},
turned AS (SELECT plane, n AS y, unnest(range(64)) AS x, unnest(l) AS s FROM across WHERE e = 16), down0 AS (SELECT plane, x AS n, list(s ORDER BY y) AS l FROM turned GROUP BY ALL), {one('down', 'down0', '(e // 4) * 4 + n // 16')},
fin AS (SELECT plane, n AS x, unnest(range(64)) AS y, unnest(l) AS s FROM down WHERE e = 16)"""


DEBLOCKED = f"WITH RECURSIVE {T.PLANES}, {_passes(False)} SELECT plane, CAST(y // 16 AS INT) AS y, CAST(x // 16 AS INT) AS x, string_agg(s, ',' ORDER BY fin.y, fin.x) AS samples FROM fin GROUP BY plane, fin.y // 16, fin.x // 16"
CHROMA = f"WITH RECURSIVE {T.PLANES}, {_passes(True)} SELECT plane, CAST(y // 16 AS INT) AS y, CAST(x // 16 AS INT) AS x, CAST(sum(s) AS INT) AS total, CAST(sum(s * (fin.y % 16 * 16 + fin.x % 16 + 1)) AS INT) AS weighted FROM fin GROUP BY plane, fin.y // 16, fin.x // 16"

QUERIES = {"plane_moved": (moved_text, MOVED), "plane_block_costs": (costs, COSTS), "plane_full_search": (full, FULL_SQL), "plane_diamond": (diamond, DIAMOND_SQL), "plane_search_summary": (summary, SUMMARY), "plane_compensated": (compensated, COMPENSATED), "plane_deblocked": (deblocked, DEBLOCKED), "plane_deblocked_chroma": (deblocked_chroma, CHROMA)}
