"""Transforms, quantisation, scans and entropy costs over blocks."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.functions import dims
from lumenflow.functions import scalar as S
from lumenflow.operators import prediction as P
from lumenflow.operators import tables as T
from lumenflow.operators import transforms as X

C = F.col
BASIS = "basis AS (SELECT CAST(u AS INT) AS u, CAST(x AS INT) AS x, cos((2 * x + 1) * u * pi() / 16) * sqrt(CASE WHEN u = 0 THEN 1 ELSE 2 END / 8.0::DOUBLE) AS c FROM (SELECT unnest(range(8)) AS u) CROSS JOIN (SELECT unnest(range(8)) AS x))"
STEPS = "steps(v, u, step) AS (VALUES " + ", ".join(f"({i // 8}, {i % 8}, {s})" for i, s in enumerate(dims.LUMA_STEPS)) + ")"
ZZ = "[" + ", ".join(str(i + 1) for i in dims.zigzag()) + "]"


def _steps(quality, table: str = "luma"):
    """Scaled steps of a quality, row by row, as an array of fixed numbers."""
    steps = dims.LUMA_STEPS if table == "luma" else dims.CHROMA_STEPS
    return S.constants([S.scaled(s, quality) for s in steps]) if isinstance(quality, int) else F.array(*[S.scaled_step(F.lit(s), quality) for s in steps])


def transform_bits(spark, d):
    """Cosine transform, quantisation at quality 75, non-zero count and bits of magnitude of eight of an order's samples each."""
    held = T.samples(spark, d).groupBy("block", "part").agg(F.array_sort(F.collect_list(F.struct("x", "s"))).alias("a"))  # eight at most
    line = [F.coalesce(F.get(C("a"), F.lit(x))["s"] - 128, F.lit(0)) for x in range(8)]
    coef = held.select("block", "part", F.array(*X.cosine_line(line)).alias("coef"))
    q = coef.select("block", "part", F.zip_with("coef", F.slice(_steps(75), 1, 8), lambda c, step: S.quantize(F.round(c, 6), step)).alias("q"))
    bits = F.aggregate("q", F.lit(0).cast("long"), lambda n, v: n + S.category(v))
    return q.select("block", "part", F.size(F.filter("q", lambda v: v != 0)).cast("long").alias("nonzero"), bits.alias("bits"), F.array_max(F.transform("q", F.abs)).alias("largest"))


SCALED75 = "greatest(1, least(255, (step * 50 + 50) // 100))"
BITS = f"""WITH {T.SAMPLES}, {BASIS}, {STEPS}, coef AS (SELECT block, part, u, sum((s - 128) * c) AS coef FROM samples JOIN basis USING (x) GROUP BY ALL),
q AS (SELECT block, part, CAST(round(round(coef, 6) / {SCALED75}) AS BIGINT) AS q FROM coef JOIN steps ON steps.u = coef.u AND v = 0)
SELECT block, part, count_if(q <> 0) AS nonzero, CAST(sum(CASE WHEN q = 0 THEN 0 ELSE length(bin(abs(q))) END) AS BIGINT) AS bits, max(abs(q)) AS largest FROM q GROUP BY block, part"""


def quantized(spark, d, quality=75):
    """(id, v, coef, q): samples, coefficients of every block and their levels, row by row; a block stays one row. Arrays made of these are never
    empty: outer generators spare the optimizer a filter that repeats the transform."""
    shifted = T.blocks(spark, d).select("id", "v", F.transform("v", lambda s: (s - 128).cast("double")).alias("coef"))
    return X.dct(shifted, "coef", ["id", "v"]).select("id", "v", "coef", F.zip_with("coef", _steps(quality), lambda c, step: S.quantize(F.round(c, 6), step).cast("int")).alias("q"))


QUANT = f"""{T.BLOCKS}, {T.ROWS}, {BASIS}, {STEPS},
t AS (SELECT id, y, u, sum((s - 128) * c) AS t FROM rows_ JOIN basis USING (x) GROUP BY ALL),
coef AS (SELECT id, b.u AS v, t.u AS u, sum(t.t * b.c) AS coef FROM t JOIN basis b ON b.x = t.y GROUP BY ALL),
quant AS (SELECT id, coef.v, coef.u, coef, {SCALED75} AS step, CAST(round(round(coef, 6) / {SCALED75}) AS INT) AS q FROM coef JOIN steps ON steps.u = coef.u AND steps.v = coef.v)"""


def dct8(spark, d):
    each = quantized(spark, d).select("id", "coef", F.posexplode_outer("q").alias("i", "q"))
    return each.select("id", S.div(C("i"), 8).cast("int").alias("v"), (C("i") % 8).alias("u"), (F.round(F.get("coef", "i"), 3) + 0.0).alias("coef"), "q")


DCT8 = f"WITH {QUANT} SELECT id, v, u, round(coef, 3) + CAST(0 AS DOUBLE) AS coef, q FROM quant"


def idct8(spark, d):
    """Worst and total error of blocks after quantisation and back."""
    levels = quantized(spark, d).select("id", "v", F.zip_with("q", _steps(75), lambda q, step: (q * step).cast("double")).alias("back"))
    back = X.idct(levels, "back", ["id", "v"])
    err = F.zip_with("v", "back", lambda s, t: F.abs(s - S.clip(F.round(F.round(t, 6) + 128)).cast("int")))
    return back.select("id", err.alias("e")).select("id", F.array_max("e").alias("worst"), F.aggregate("e", F.lit(0).cast("long"), lambda n, e: n + e).alias("total"))


IDCT8 = f"""WITH {QUANT}, a AS (SELECT id, v, x, sum(CAST(q * step AS DOUBLE) * c) AS t FROM quant JOIN basis USING (u) GROUP BY ALL),
o AS (SELECT id, b.x AS y, a.x AS x, CAST(greatest(0, least(255, round(round(sum(a.t * b.c), 6) + 128))) AS INT) AS t FROM a JOIN basis b ON b.u = a.v GROUP BY id, b.x, a.x)
SELECT id, max(abs(s - t)) AS worst, CAST(sum(abs(s - t)) AS BIGINT) AS total FROM rows_ JOIN o USING (id, y, x) GROUP BY id"""


def energy(spark, d):
    """Total energy of coefficients and the shares of DC and of the lowest sixteen."""
    e = quantized(spark, d).select("id", F.transform("coef", lambda c: F.round(c, 3) * F.round(c, 3)).alias("e"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda n, x: n + x)
    low = add(F.filter("e", lambda x, i: (i % 8 < 4) & (i < 32)))
    return e.select("id", add(C("e")).alias("all"), low.alias("low"), F.get("e", F.lit(0)).alias("dc")).select("id", F.round("all", 1).alias("total"), F.round(C("dc") / C("all"), 6).alias("dc"), F.round(C("low") / C("all"), 6).alias("low"))


ENERGY = f"""WITH {QUANT}, e AS (SELECT id, u, v, round(coef, 3) * round(coef, 3) AS e FROM quant)
SELECT id, round(sum(e), 1) AS total, round(sum(e) FILTER (WHERE u = 0 AND v = 0) / sum(e), 6) AS dc, round(sum(e) FILTER (WHERE u < 4 AND v < 4) / sum(e), 6) AS low FROM e GROUP BY id"""


def rmse_sweep(spark, d):
    """Root mean square error of quantisation at qualities from 1 to 100. A block gives its squared errors of all qualities as one
    array, so that sums are made before anything is shuffled."""
    coef = quantized(spark, d).select(F.transform("coef", lambda c: F.abs(F.round(c, 3))).alias("coef"))
    scaled = [[max(1, min(255, (s * (5000 // q if q < 50 else 200 - 2 * q) + 50) // 100)) for s in dims.LUMA_STEPS] for q in range(1, 101)]
    steps = F.from_json(F.lit(str(scaled)), "array<array<int>>")  # folded to one constant
    error = lambda c, s: F.floor(c / s + 0.5) * s - c
    sums = F.transform(steps, lambda its: F.aggregate(F.zip_with("coef", its, error), F.lit(0.0), lambda n, e: n + e * e))
    each = coef.select(F.posexplode_outer(sums).alias("i", "e")).groupBy((C("i") + 1).alias("quality"))
    return each.agg(F.round(F.sqrt(F.sum("e") / (64 * F.count(F.lit(1)))), 5).alias("rmse"))


SWEEP = f"""WITH {QUANT}, k AS (SELECT unnest(range(1, 101)) AS quality), st AS (SELECT v, u, CAST(quality AS INT) AS quality, greatest(1, least(255, (step * (CASE WHEN quality < 50 THEN 5000 // quality ELSE 200 - 2 * quality END) + 50) // 100)) AS s FROM steps CROSS JOIN k)
SELECT quality, round(sqrt(avg((round(round(coef, 3) / s) * s - round(coef, 3)) ** 2)), 5) AS rmse FROM quant JOIN st ON st.u = quant.u AND st.v = quant.v GROUP BY quality"""


def scanned(spark, d):
    """(id, a, z): quantised coefficients of a block, row by row and in zigzag order."""
    return quantized(spark, d).select("id", C("q").alias("a")).select("id", "a", X.zigzag("a").alias("z"))


SCAN = f"{QUANT}, scan AS (SELECT id, list_transform({ZZ}, lambda i: a[i]) AS z FROM (SELECT id, list(q ORDER BY v, u) AS a FROM quant GROUP BY id))"


def zigzag(spark, d):
    return scanned(spark, d).select("id", F.array_join(F.transform("z", lambda x: x.cast("string")), " ").alias("scan"), (X.unzigzag("z") == C("a")).alias("same"), F.size(F.filter("z", lambda x: x != 0)).alias("nonzero"))


ZIGZAG = f"WITH {SCAN} SELECT id, array_to_string(z, ' ') AS scan, true AS same, CAST(len(list_filter(z, lambda x: x <> 0)) AS INT) AS nonzero FROM scan"


def symbols(spark, d):
    """(id, symbols): run lengths of the coefficients but DC."""
    return X.run_symbols(scanned(spark, d), "z", ["id"])


def run_lengths(spark, d):
    return symbols(spark, d).select("id", F.inline_outer("symbols"))


RUNS = f"""{SCAN}, p AS (SELECT id, CAST(i AS INT) AS pos, z[i + 1] AS value FROM scan, (SELECT unnest(range(64)) AS i)),
nz AS (SELECT id, pos, value, pos - coalesce(lag(pos) OVER (PARTITION BY id ORDER BY pos), 0) - 1 AS run FROM p WHERE pos > 0 AND value <> 0),
sym AS (SELECT id, pos, CAST(k AS INT) AS k, CAST(CASE WHEN k = run // 16 THEN run % 16 ELSE 15 END AS INT) AS run, CASE WHEN k = run // 16 THEN value ELSE 0 END AS value FROM (SELECT *, unnest(range(run // 16 + 1)) AS k FROM nz)),
ends AS (SELECT id, 64 AS pos, 0 AS k, 0 AS run, 0 AS value FROM p GROUP BY id HAVING coalesce(max(CASE WHEN pos > 0 AND value <> 0 THEN pos END), 0) < 63),
rle AS (SELECT * FROM sym UNION ALL SELECT * FROM ends)"""
RLE = f"WITH {RUNS} SELECT id, pos, k, run, value FROM rle"


def run_expand(spark, d):
    """Run lengths expanded again: the places and values of all coefficients but DC."""
    return symbols(spark, d).select("id", X.run_values("symbols").alias("v")).select("id", F.inline_outer("v")).filter("pos is not null")


EXPAND = f"WITH {RUNS} SELECT id, pos, value FROM p WHERE pos > 0 AND value <> 0"


def _ac(of):
    """An entry for each of the 256 AC symbols from the standard luma codes (symbol, len, code); null where there is no code."""
    made = {s: of(n, c) for s, n, c in dims.huffman_codes("ac_luma")}
    return S.constants([made.get(s) for s in range(256)])


def huffman_bits(spark, d):
    """Entropy-coded bits of every block's AC symbols by the standard luma table, and the ratio to 8 bits a sample."""
    lengths = _ac(lambda n, c: n)
    size = lambda e: S.category(e["value"])
    bits = F.aggregate("symbols", F.lit(0).cast("long"), lambda n, e: n + F.get(lengths, e["run"] * 16 + size(e)) + size(e))
    return symbols(spark, d).select("id", bits.alias("bits"), F.size("symbols").cast("long").alias("symbols")).withColumn("ratio", F.round(512 / C("bits"), 6))


AC = "ac(symbol, len) AS (VALUES " + ", ".join(f"({s}, {n})" for s, n, _ in dims.huffman_codes("ac_luma")) + ")"
HUFF = f"""WITH {RUNS}, {AC}, c AS (SELECT id, run * 16 + CASE WHEN value = 0 THEN 0 ELSE length(bin(abs(value))) END AS symbol, CASE WHEN value = 0 THEN 0 ELSE length(bin(abs(value))) END AS size FROM rle)
SELECT id, CAST(sum(len + size) AS BIGINT) AS bits, count(*) AS symbols, round(512.0::DOUBLE / sum(len + size), 6) AS ratio FROM c JOIN ac USING (symbol) GROUP BY id"""


def huffman_text(spark, d):
    """Coded AC symbols of a block as text of zeros and ones, padded with ones to whole bytes, FF bytes stuffed."""
    codes = _ac(lambda n, c: f"{c:0{n}b}")

    def coded(e):
        size = S.category(e["value"])
        extra = F.when(size == 0, "").otherwise(F.lpad(F.bin(S.magnitude_bits(e["value"].cast("long"))), size, F.lit("0")))
        return F.concat(F.get(codes, e["run"] * 16 + size), extra)

    whole = symbols(spark, d).select("id", F.array_join(F.transform("symbols", coded), "").alias("t"))
    padded = whole.select("id", F.rpad("t", (F.ceil(F.length("t") / 8) * 8).cast("int"), F.lit("1")).alias("t"))
    nbytes = F.transform(F.sequence(F.lit(1), F.length("t") - 7, F.lit(8)), lambda i: F.conv(F.call_function("substring", C("t"), i, F.lit(8)), 2, 16))
    return padded.select("id", F.array_join(F.transform(nbytes, lambda b: F.when(b == "FF", "FF00").otherwise(F.lpad(b, 2, "0"))), "").alias("coded"))


ACC = "acc(symbol, code) AS (VALUES " + ", ".join(f"({s}, '{c:0{n}b}')" for s, n, c in dims.huffman_codes("ac_luma")) + ")"
HUFFTEXT = f"""WITH {RUNS}, {ACC}, c AS (SELECT id, pos, k, value, CASE WHEN value = 0 THEN 0 ELSE length(bin(abs(value))) END AS size, run FROM rle),
b AS (SELECT id, pos, k, code || CASE WHEN size = 0 THEN '' ELSE lpad(bin(CASE WHEN value > 0 THEN value ELSE value + (1 << size) - 1 END), CAST(size AS INT), '0') END AS b FROM c JOIN acc ON symbol = run * 16 + size),
txt AS (SELECT id, string_agg(b, '' ORDER BY pos, k) AS t FROM b GROUP BY id), f AS (SELECT id, rpad(t, CAST(ceil(length(t) / 8.0) * 8 AS INT), '1') AS t FROM txt)
SELECT id, array_to_string(list_transform(range(1, length(t), 8), lambda i: CASE WHEN substr(t, i, 8) = '11111111' THEN 'FF00' ELSE
 substr('0123456789ABCDEF', 1 + 8 * CAST(substr(t, i, 1) AS INT) + 4 * CAST(substr(t, i + 1, 1) AS INT) + 2 * CAST(substr(t, i + 2, 1) AS INT) + CAST(substr(t, i + 3, 1) AS INT), 1) ||
 substr('0123456789ABCDEF', 1 + 8 * CAST(substr(t, i + 4, 1) AS INT) + 4 * CAST(substr(t, i + 5, 1) AS INT) + 2 * CAST(substr(t, i + 6, 1) AS INT) + CAST(substr(t, i + 7, 1) AS INT), 1) END), '') AS coded FROM f"""


def huffman_table(spark, d):
    """Canonical codes by window, from nothing but their lengths: a code is the sum of what the shorter codes before it take, at its own
    length. Beside each, how often the blocks' AC symbols use it and the bits that this takes."""
    codes = dims.huffman(spark)
    w = Window.partitionBy("table").orderBy("len", "code").rowsBetween(Window.unboundedPreceding, -1)
    take = F.coalesce(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(16) - C("len"))).over(w), F.lit(0))
    made = F.call_function("shiftright", take, F.lit(16) - C("len"))
    each = symbols(spark, d).select(F.explode(F.transform("symbols", lambda e: e["run"] * 16 + S.category(e["value"]))).alias("symbol"))
    used = each.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit("ac_luma"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    rows = codes.select("table", "symbol", "len", C("code").cast("long").alias("code"), (made == C("code")).alias("canonical")).join(used, ["table", "symbol"], "left")
    return rows.select("table", "symbol", "len", "code", "canonical", n.alias("used"), (n * C("len")).alias("bits"))


HUFFTABLE = f"WITH {RUNS}, codes(\"table\", symbol, len, code) AS (VALUES " + ", ".join(f"('{t}', {s}, {n}, {c})" for t in dims.HUFFMAN for s, n, c in dims.huffman_codes(t)) + """),
u AS (SELECT run * 16 + CASE WHEN value = 0 THEN 0 ELSE length(bin(abs(value))) END AS symbol, count(*) AS n FROM rle GROUP BY 1)
SELECT "table", codes.symbol, len, CAST(code AS BIGINT) AS code, true AS canonical, CAST(coalesce(n, 0) AS BIGINT) AS used, CAST(coalesce(n, 0) * len AS BIGINT) AS bits FROM codes LEFT JOIN u ON "table" = 'ac_luma' AND u.symbol = codes.symbol"""


#: Ids of blocks that are ranked together.
RANGE = 4096


def dc_dpcm(spark, d):
    """Differences of DC values in scan order, and their running sum within restart segments of eight blocks."""
    bucket = F.expr(f"id div {RANGE}").alias("bucket")
    dc = quantized(spark, d).select((C("id") % 4).alias("component"), bucket, "id", F.get("q", F.lit(0)).alias("dc"))
    # A block's rank is its rank in a range of ids and the number of blocks before that range.
    counts = T.blocks(spark, d).select((C("id") % 4).alias("component"), bucket).groupBy("component", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("component").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("component", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("component", "bucket").orderBy("id")
    ranked = dc.withColumn("r", F.row_number().over(within) - 1).join(first, ["component", "bucket"]).withColumn("rank", C("first") + C("r"))
    seg = ranked.withColumn("segment", F.expr("rank div 8")).withColumn("shifted", F.expr("(rank + 4) div 8"))
    # The block before the first of a segment is in the same segment when these are shifted by half.
    s, h = (Window.partitionBy("component", x).orderBy("id") for x in ("segment", "shifted"))
    diff = seg.withColumn("across", F.lag("dc").over(h)).withColumn("last", F.lag("dc").over(s)).withColumn("diff", C("dc") - F.coalesce("last", F.lit(0)))
    return diff.select("component", "id", "segment", (C("dc") - F.coalesce("last", "across", F.lit(0))).alias("whole"), "diff", F.sum("diff").over(s).alias("again"))


DPCM = f"""WITH {QUANT}, dc AS (SELECT id % 4 AS component, id, q AS dc, (row_number() OVER (PARTITION BY id % 4 ORDER BY id) - 1) // 8 AS segment FROM quant WHERE u = 0 AND v = 0)
SELECT component, id, segment, dc - coalesce(lag(dc) OVER (PARTITION BY component ORDER BY id), 0) AS whole, dc - coalesce(lag(dc) OVER (PARTITION BY component, segment ORDER BY id), 0) AS diff, CAST(dc AS BIGINT) AS again FROM dc"""


def variance(spark, d):
    """Integer variance of blocks; by bucket the one with most, and the one with the least above zero; first wins."""
    s = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
    q = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    v = T.blocks(spark, d).select((C("id") % 16).alias("bucket"), "id", (q - S.div(s * s, 64)).alias("var"))
    most = v.groupBy("bucket").agg(F.min(F.struct((-C("var")).alias("n"), "id")).alias("m"), F.min(F.when(C("var") > 0, F.struct("var", "id"))).alias("l"))
    return most.select("bucket", C("m.id").alias("most"), (-C("m.n")).alias("most_var"), C("l.id").alias("least"), C("l.var").alias("least_var"))


VARIANCE = f"""WITH {T.BLOCKS}, v AS (SELECT id % 16 AS bucket, id, CAST(list_sum(list_transform(v, lambda x: x * x)) AS BIGINT) - CAST(list_sum(v) AS BIGINT) * CAST(list_sum(v) AS BIGINT) // 64 AS var FROM blocks),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY var DESC, id) AS a, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN var > 0 THEN 0 ELSE 1 END, var, id) AS b FROM v)
SELECT m.bucket, m.id AS most, m.var AS most_var, l.id AS least, l.var AS least_var FROM r m JOIN r l ON l.bucket = m.bucket AND m.a = 1 AND l.b = 1"""


def four(spark, d):
    """(id, a): the 4x4 blocks of every block less their integer mean, as residuals."""
    b = T.quarters(T.blocks(spark, d))
    mean = S.div(F.aggregate("v", F.lit(0), lambda s, x: s + x), 16).cast("int")
    return b.select("id", F.zip_with("v", F.array_repeat(mean, 16), lambda x, m: x - m).alias("a"))


FOUR = f"{T.QUARTERS}, four AS (SELECT id, list_transform(v, lambda x: x - CAST(list_sum(v) AS INT) // 16) AS a FROM quarters)"
M4 = "[[1, 1, 1, 1], [2, 1, -1, -2], [1, -1, -1, 1], [1, -2, 2, -1]]"
FWD = f"""{FOUR}, c4 AS (SELECT {M4} AS m), cell AS (SELECT id, i, j, sum(m[i][y] * m[j][x] * a[(y - 1) * 4 + x]) AS w FROM four, c4, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 5)) AS j), (SELECT unnest(range(1, 5)) AS y), (SELECT unnest(range(1, 5)) AS x) GROUP BY id, i, j)"""


def levels4(spark, d, qp=28):
    """(id, a, w, intra, inter): residuals, their core transform and its levels with intra and inter rounding, each an array of 16."""
    w = X.both_ways(four(spark, d).withColumn("w", C("a")), "w", X.forward4, ["id", "a"])
    return w.select("id", "a", "w", X.quantized4("w", qp).alias("intra"), X.quantized4("w", qp, False).alias("inter"))


def h264_forward(spark, d, qp=28):
    """Core transform and quantisation of residuals, a row for each place."""
    each = levels4(spark, d, qp).select("id", F.posexplode_outer(F.arrays_zip("w", "intra", "inter")).alias("k", "e"))
    return each.select("id", "k", C("e.w").cast("long").alias("w"), "e.intra", "e.inter")


def _by_class(table, qp, i="i", j="j"):
    a, b, c = table[qp % 6]
    return f"CASE WHEN {i} % 2 = 1 AND {j} % 2 = 1 THEN {a} WHEN {i} % 2 = 0 AND {j} % 2 = 0 THEN {b} ELSE {c} END"


LEVELQ = f"sign(w) * ((abs(w) * ({_by_class(dims.FORWARD, 28)}) + {{f}}) >> 19)"
H264F = f"""WITH {FWD} SELECT id, CAST((i - 1) * 4 + j - 1 AS INT) AS k, CAST(w AS BIGINT) AS w, CAST({LEVELQ.format(f=(1 << 19) // 3)} AS BIGINT) AS intra, CAST({LEVELQ.format(f=(1 << 19) // 6)} AS BIGINT) AS inter
FROM (SELECT id, i, j, CAST(w AS BIGINT) AS w FROM cell)"""


def h264_roundtrip(spark, d, qp=28):
    """Residuals after transform, quantisation and back; their sum and worst error, by block."""
    q = levels4(spark, d, qp).select("id", "a", X.dequantized4("intra", qp).alias("b"))
    back = X.residual4(q, "b", ["id", "a"])
    err = F.zip_with("a", "b", lambda p, q: F.abs(p - q))
    return back.select("id", F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max(err).cast("long").alias("worst"))


INV = "[{0}1 + {0}3 + {0}2 + ({0}4 >> 1), {0}1 - {0}3 + ({0}2 >> 1) - {0}4, {0}1 - {0}3 - ({0}2 >> 1) + {0}4, {0}1 + {0}3 - {0}2 - ({0}4 >> 1)]"
H264R = f"""WITH {FWD}, w AS (SELECT id, i, j, CAST(w AS BIGINT) AS w FROM cell), q AS (SELECT id, i, j, CAST({LEVELQ.format(f=(1 << 19) // 3)} AS BIGINT) * ({_by_class(dims.LEVEL_SCALE, 28)}) * 16 AS w FROM w),
r AS (SELECT id, i, max(w) FILTER (WHERE j = 1) AS r1, max(w) FILTER (WHERE j = 2) AS r2, max(w) FILTER (WHERE j = 3) AS r3, max(w) FILTER (WHERE j = 4) AS r4 FROM q GROUP BY id, i),
h AS (SELECT id, i, {INV.format('r')} AS h FROM r), c AS (SELECT id, x, max(h[x]) FILTER (WHERE i = 1) AS c1, max(h[x]) FILTER (WHERE i = 2) AS c2, max(h[x]) FILTER (WHERE i = 3) AS c3, max(h[x]) FILTER (WHERE i = 4) AS c4 FROM h, (SELECT unnest(range(1, 5)) AS x) GROUP BY id, x),
o AS (SELECT id, x, {INV.format('c')} AS o FROM c), p AS (SELECT o.id, (o[y] + 32) >> 6 AS b, a[(y - 1) * 4 + x] AS a FROM o JOIN four USING (id), (SELECT unnest(range(1, 5)) AS y))
SELECT id, CAST(sum(b) AS BIGINT) AS total, CAST(max(abs(a - b)) AS BIGINT) AS worst FROM p GROUP BY id"""


def dc_hadamard(spark, d, qp=29):
    """Scaled Hadamard transform of sixteen luma DC values and of four chroma ones."""
    luma = X.luma_dc(four(spark, d).withColumn("b", C("a")), "b", qp, ["id", "a"])
    at = lambda i: P.at("a", i)
    return luma.select("id", F.transform("b", lambda x: x.cast("long")).getItem(0).alias("l0"), C("b")[5].cast("long").alias("l5"), C("b")[15].cast("long").alias("l15"), *[x.cast("long").alias(f"c{i}") for i, x in enumerate(X.chroma_dc(at(0), at(1), at(2), at(3), qp))])


HAD = "[[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]]"
HADAMARD = f"""WITH {FOUR}, m AS (SELECT {HAD} AS m), f AS (SELECT id, i, j, CAST(sum(m[i][y] * m[j][x] * a[(y - 1) * 4 + x]) AS BIGINT) AS f FROM four, m, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 5)) AS j), (SELECT unnest(range(1, 5)) AS y), (SELECT unnest(range(1, 5)) AS x) GROUP BY id, i, j)
SELECT f.id, max(f * 18 * 4) FILTER (WHERE i = 1 AND j = 1) AS l0, max(f * 18 * 4) FILTER (WHERE i = 2 AND j = 2) AS l5, max(f * 18 * 4) FILTER (WHERE i = 4 AND j = 4) AS l15,
 any_value(((a[1] + a[2] + a[3] + a[4]) * 18 * 16) >> 5)::BIGINT AS c0, any_value(((a[1] - a[2] + a[3] - a[4]) * 18 * 16) >> 5)::BIGINT AS c1, any_value(((a[1] + a[2] - a[3] - a[4]) * 18 * 16) >> 5)::BIGINT AS c2, any_value(((a[1] - a[2] - a[3] + a[4]) * 18 * 16) >> 5)::BIGINT AS c3
FROM f JOIN four USING (id) GROUP BY f.id"""


def satd(spark, d):
    """SAD and SATD of 4x4 blocks against those at the same place of the next block."""
    b = T.blocks(spark, d)
    j = b.join(b.select((C("id") - 1).alias("id"), C("v").alias("w")), "id").select("id", F.zip_with("v", "w", lambda p, q: p - q).alias("a"))
    j = T.quarters(j, "a")
    s = F.aggregate("a", F.lit(0), lambda t, x: t + F.abs(x))
    return X.both_ways(j.withColumn("sad", s), "a", X.hadamard4, ["id", "sad"]).select("id", "sad", X.satd("a").alias("satd"))


SATD = f"""WITH {T.QUARTERS}, f0 AS (SELECT b.id, list_transform(range(1, 17), lambda i: b.v[i] - n.v[i]) AS a FROM quarters b JOIN quarters n ON n.id = b.id + 4), m AS (SELECT {HAD} AS m),
f AS (SELECT id, i, j, CAST(sum(m[i][y] * m[j][x] * a[(y - 1) * 4 + x]) AS BIGINT) AS f FROM f0, m, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 5)) AS j), (SELECT unnest(range(1, 5)) AS y), (SELECT unnest(range(1, 5)) AS x) GROUP BY id, i, j)
SELECT f.id, any_value(CAST(list_sum(list_transform(a, lambda x: abs(x))) AS INT)) AS sad, CAST((sum(abs(f)) + 1) >> 1 AS INT) AS satd FROM f JOIN f0 USING (id) GROUP BY f.id"""

QUERIES = {
    "blk_transform_bits": (transform_bits, BITS), "blk_dct8": (dct8, DCT8), "blk_idct8_error": (idct8, IDCT8), "blk_energy": (energy, ENERGY), "blk_rmse_sweep": (rmse_sweep, SWEEP), "blk_zigzag": (zigzag, ZIGZAG),
    "blk_run_lengths": (run_lengths, RLE), "blk_run_expand": (run_expand, EXPAND), "blk_huffman_bits": (huffman_bits, HUFF), "blk_huffman_text": (huffman_text, HUFFTEXT), "blk_huffman_table": (huffman_table, HUFFTABLE),
    "blk_dc_dpcm": (dc_dpcm, DPCM), "blk_variance": (variance, VARIANCE), "h264_forward": (h264_forward, H264F), "h264_roundtrip": (h264_roundtrip, H264R), "h264_dc_hadamard": (dc_hadamard, HADAMARD), "h264_satd": (satd, SATD),
}
