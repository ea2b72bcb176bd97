"""Planes coded by intra prediction from what was coded before."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.functions import dims
from lumenflow.operators import tables as T
from lumenflow.operators import wavefront as W
from lumenflow.plans.motion import sql_modes

QP = 28


def coded(spark, d):
    """Modes, costs, contexts and counts of the sixteen blocks of every macroblock, its levels and the samples that a decoder gets."""
    found = W.code(T.planes(spark, d), QP)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return found.select("plane", "y", "x", *[text(c) for c in ("modes", "costs", "contexts", "totals", "levels")], F.aggregate("dropped", F.lit(0), lambda s, v: s + v).alias("dropped"), text("v").alias("samples"))


def _list(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


def _product(m) -> str:
    """The matrix that a two-dimensional transform is, row by row."""
    return _list(m[i][y] * m[j][x] for i in range(4) for j in range(4) for y in range(4) for x in range(4))


def _times(matrix: str, values: str) -> str:
    return f"list_transform(range(16), lambda a: list_sum(list_transform(range(16), lambda b: {matrix}[a * 16 + b + 1] * {values})))"


def _inverse(w: str) -> str:
    """Along rows, then transposed: twice gives both directions."""
    out = []
    for i in range(4):
        r = [f"{w}[{4 * i + k + 1}]" for k in range(4)]
        e, f, g, h = f"{r[0]} + {r[2]}", f"{r[0]} - {r[2]}", f"(({r[1]} >> 1) - {r[3]})", f"({r[1]} + ({r[3]} >> 1))"
        out.append([f"{e} + {h}", f"{f} + {g}", f"{f} - {g}", f"{e} - {h}"])
    return _list(f"CAST({out[i][j]} AS BIGINT)" for j in range(4) for i in range(4))


def _sql() -> str:
    kind = lambda table: _list(table[0] if i // 4 % 2 == i % 4 % 2 == 0 else table[1] if i // 4 % 2 == i % 4 % 2 == 1 else table[2] for i in range(16))
    bits = 15 + QP // 6
    px, py = _list(x for x, _ in W.PLACES), _list(y for _, y in W.PLACES)
    rec = lambda y, x: f"rec[({y}) * 64 + {x} + 1]"
    border = [f"CASE WHEN l THEN {rec(f'y + {3 - i}', 'x - 1')} ELSE 0 END" for i in range(4)] + [f"CASE WHEN l AND t THEN {rec('y - 1', 'x - 1')} ELSE 0 END"]
    border += [f"CASE WHEN t THEN {rec('y - 1', f'x + {i}')} ELSE 0 END" for i in range(4)] + [f"CASE WHEN r THEN {rec('y - 1', f'x + {i}')} WHEN t THEN {rec('y - 1', 'x + 3')} ELSE 0 END" for i in range(4, 8)]
    dc = "CASE WHEN l AND t THEN (p[1] + p[2] + p[3] + p[4] + p[6] + p[7] + p[8] + p[9] + 4) >> 3 WHEN l THEN (p[1] + p[2] + p[3] + p[4] + 2) >> 2 WHEN t THEN (p[6] + p[7] + p[8] + p[9] + 2) >> 2 ELSE 128 END"
    modes = sql_modes("(i // 4)", "(i % 4)", f"({dc})")
    fits = "CASE WHEN mode IN (0, 3, 7) THEN t WHEN mode IN (1, 8) THEN l WHEN mode = 2 THEN true ELSE l AND t END"
    rows = " || ".join(f"rec[(y + {i - 1}) * 64 + x + 5 : (y + {i}) * 64 + x] || v[{4 * i + 1} : {4 * i + 4}]" for i in range(1, 4))
    context = "CASE WHEN l AND t THEN (nz[bj * 16 + bx] + nz[(bj - 1) * 16 + bx + 1] + 1) >> 1 WHEN l THEN nz[bj * 16 + bx] WHEN t THEN nz[(bj - 1) * 16 + bx + 1] ELSE 0 END"
    stages = [
        f"*, k % 16 AS blk, k // 16 % 4 * 4 + {px}[k % 16 + 1] AS bx, k // 64 * 4 + {py}[k % 16 + 1] AS bj FROM (SELECT plane, k + 1 AS k, rec, nz, src FROM code WHERE k < 255)",
        "*, bx * 4 AS x, bj * 4 AS y, bx > 0 AS l, bj > 0 AS t",
        f"*, t AND bx < 15 AND NOT list_contains({_list(W.NO_RIGHT)}, blk) AS r, list_transform(range(16), lambda i: src[(y + i // 4) * 64 + x + i % 4 + 1]) AS o",
        f"*, {_list(border)} AS p",
        f"*, list_transform(range(9), lambda mode: list_transform(range(16), lambda i: CAST({modes} AS BIGINT))) AS made",
        f"*, list_transform(range(9), lambda mode: CASE WHEN {fits} THEN ((list_sum(list_transform({_times(_product(W.HADAMARD.tolist()), '(o[b + 1] - made[mode + 1][b + 1])')}, lambda q: abs(q)))::BIGINT + 1) >> 1) * 16 + mode END) AS rated",
        "*, list_min(rated) % 16 AS mode, list_min(rated) // 16 AS cost",
        f"*, {_times(_product(W.FORWARD.tolist()), '(o[b + 1] - made[mode + 1][b + 1])')} AS w, {context} AS nc",
        f"*, list_transform(range(1, 17), lambda i: CAST(sign(w[i]) * ((CAST(abs(w[i]) AS BIGINT) * {kind(dims.FORWARD[QP % 6])}[i] + {(1 << bits) // 3}) >> {bits}) AS BIGINT)) AS q",
        "*, len(list_filter(q, lambda c: c <> 0)) = 4 OR nc BETWEEN 4 AND 7 AS gone",
        "*, CASE WHEN gone THEN list_transform(q, lambda c: 0::BIGINT) ELSE q END AS lev",
        f"*, list_transform(range(1, 17), lambda i: lev[i] * {kind(dims.LEVEL_SCALE[QP % 6])}[i] * {1 << QP // 6}) AS dq",
        f"*, {_inverse('dq')} AS half",
        f"*, {_inverse('half')} AS rest",
        "*, list_transform(range(1, 17), lambda i: greatest(0, least(255, made[mode + 1][i] + ((rest[i] + 32) >> 6)))) AS v, len(list_filter(lev, lambda c: c <> 0)) AS total",
    ]
    term = stages[0]
    for s in stages[1:]:
        term = f"{s} FROM (SELECT {term})"
    zz = _list(i + 1 for i in dims.zigzag(4))
    step = f"SELECT plane, k, rec[1 : y * 64 + x] || v[1 : 4] || {rows} || rec[(y + 3) * 64 + x + 5 : 4096], nz[1 : bj * 16 + bx] || [total] || nz[bj * 16 + bx + 2 : 256], src, mode, cost, nc, total, lev, gone FROM (SELECT {term})"
    each = lambda c: f"string_agg({c}, ',' ORDER BY k) AS {c}s"
    return f"""WITH RECURSIVE {T.PLANES}, src AS (SELECT plane, list(CAST(s AS BIGINT) ORDER BY k) AS src FROM plane GROUP BY plane),
code(plane, k, rec, nz, src, mode, cost, nc, total, lev, gone) AS (SELECT plane, -1::BIGINT, list_transform(range(4096), lambda i: 0::BIGINT), list_transform(range(256), lambda i: 0::BIGINT), src, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, list_transform(range(16), lambda i: 0::BIGINT), false FROM src
UNION ALL {step}),
m AS (SELECT plane, CAST(k // 64 AS INT) AS y, CAST(k // 16 % 4 AS INT) AS x, string_agg(mode, ',' ORDER BY k) AS modes, string_agg(cost, ',' ORDER BY k) AS costs, string_agg(nc, ',' ORDER BY k) AS contexts, string_agg(total, ',' ORDER BY k) AS totals,
  string_agg(array_to_string(list_transform({zz}, lambda i: lev[i]), ','), ',' ORDER BY k) AS levels, CAST(count_if(gone) AS INT) AS dropped FROM code WHERE k >= 0 GROUP BY plane, k // 64, k // 16 % 4),
f AS (SELECT plane, unnest(range(4096)) AS k, unnest(rec) AS s FROM code WHERE k = 255), g AS (SELECT plane, k // 1024 AS y, k % 64 // 16 AS x, string_agg(s, ',' ORDER BY k) AS samples FROM f GROUP BY ALL)
SELECT m.*, samples FROM m JOIN g ON g.plane = m.plane AND g.y = m.y AND g.x = m.x"""


QUERIES = {"plane_intra_coded": (coded, _sql())}
