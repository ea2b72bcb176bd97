"""Reports over frames: sizes, order, seeking, parameter sets and rate control."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.functions import dims
from lumenflow.functions import scalar as S
from lumenflow.operators import rate
from lumenflow.operators import tables as T

C = F.col


def type_histogram(spark, d):
    """Count, bytes and share of each kind of frame, largest first."""
    g = T.frames(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    whole = g.agg(F.sum("bytes").alias("all"))
    rank = F.row_number().over(Window.orderBy(F.desc("bytes"), "kind"))  # a row for each kind
    return g.crossJoin(F.broadcast(whole)).select("kind", "n", "bytes", F.round(C("bytes") / C("all"), 6).alias("share"), rank.alias("rank"))


HIST = f"WITH {T.FRAMES} SELECT kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, round(CAST(sum(bytes) AS DOUBLE) / CAST(sum(sum(bytes)) OVER () AS DOUBLE), 6) AS share, row_number() OVER (ORDER BY sum(bytes) DESC, kind) AS rank FROM frames GROUP BY kind"


def size_stats(spark, d):
    """Least, most, integer and true mean, spread and relative spread of frame sizes, the peak frame, and the bitrate at 30 fps."""
    f = T.frames(spark, d)
    n, s, s2 = F.count(F.lit(1)), F.sum("bytes"), F.sum(C("bytes") * C("bytes"))
    sd = F.sqrt((s2 - s / n * s) / n)
    return f.groupBy("kind").agg(
        n.alias("n"), F.min("bytes").alias("least"), F.max("bytes").alias("most"), S.div(s, n).alias("mean_int"), F.round(s / n, 5).alias("mean"), F.round(sd, 4).alias("sd"), F.round(sd / F.nullif(s / n, F.lit(0.0)), 6).alias("cv"),
        F.min(F.struct((-C("bytes")).alias("b"), "n"))["n"].alias("peak"), F.round(s * 8 * 30 / n / 1000, 5).alias("kbps"),
    )


STATS = f"""WITH {T.FRAMES}, g AS (SELECT kind, count(*) AS n, min(bytes) AS least, max(bytes) AS most, CAST(sum(bytes) AS DOUBLE) AS s, CAST(sum(bytes * bytes) AS DOUBLE) AS s2, CAST(sum(bytes) // count(*) AS BIGINT) AS mean_int, arg_min(n, (-bytes, n)) AS peak FROM frames GROUP BY kind)
SELECT kind, n, least, most, mean_int, round(s / n, 5) AS mean, round(sqrt((s2 - s / n * s) / n), 4) AS sd, round(sqrt((s2 - s / n * s) / n) / (s / n), 6) AS cv, peak, round(s * 8 * 30 / n / 1000, 5) AS kbps FROM g"""


def index_offsets(spark, d):
    """Offsets of chunks in a container: eight bytes of header each, odd sizes padded."""
    w = Window.partitionBy("stream").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    f = T.frames(spark, d)
    return f.select("stream", "n", (4 + F.coalesce(F.sum(8 + C("bytes") + C("bytes") % 2).over(w), F.lit(0))).alias("offset"), C("bytes").alias("size"))


OFFSETS = f"WITH {T.FRAMES} SELECT stream, n, 4 + CAST(coalesce(sum(8 + bytes + bytes % 2) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", bytes AS size FROM frames"


def worst_gap(spark, d):
    """Longest wait between key frames (clicks), in milliseconds; ten seconds where there is one only."""
    f = T.frames(spark, d).filter("kind = 'click'")
    gap = F.lead("us").over(Window.partitionBy("stream").orderBy("us", "n")) - C("us")
    return f.withColumn("gap", gap).groupBy("stream").agg(F.coalesce(S.div(F.max("gap"), 1000), F.lit(10000)).alias("worst_ms"), F.count(F.lit(1)).alias("n"))


GAP = f"WITH {T.FRAMES}, g AS (SELECT stream, lead(us) OVER (PARTITION BY stream ORDER BY us, n) - us AS gap FROM frames WHERE kind = 'click') SELECT stream, coalesce(max(gap) // 1000, 10000) AS worst_ms, count(*) AS n FROM g GROUP BY stream"


def display_order(spark, d):
    """Place of each frame by time against its place by decoding, and whether it moved."""
    f = T.frames(spark, d)
    shown = F.row_number().over(Window.partitionBy("stream").orderBy("us", "n"))
    decoded = F.row_number().over(Window.partitionBy("stream").orderBy("n"))
    ranked = f.select("stream", "n", shown.alias("shown"), decoded.alias("decoded"))
    other = ranked.select("stream", C("shown").alias("decoded"), C("n").alias("shown_here"))
    return ranked.join(other, ["stream", "decoded"]).select("stream", "n", "shown", "decoded", "shown_here", (C("shown") != C("decoded")).alias("moved"))


ORDER = f"""WITH {T.FRAMES}, r AS (SELECT stream, n, row_number() OVER (PARTITION BY stream ORDER BY us, n) AS shown, row_number() OVER (PARTITION BY stream ORDER BY n) AS decoded FROM frames)
SELECT r.stream, r.n, r.shown, r.decoded, o.n AS shown_here, r.shown <> r.decoded AS moved FROM r JOIN r o ON o.stream = r.stream AND o.shown = r.decoded"""


def parameter_sets(spark, d):
    """The latest parameter set (a purchase) before each slice (any other kind); one of odd size cannot be read and clears it."""
    f = T.frames(spark, d)
    mark = F.when(C("kind") == "purchase", F.struct("n", (C("bytes") % 2 == 0).alias("ok")))
    w = Window.partitionBy("stream").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    held = f.withColumn("set", F.last(mark, ignorenulls=True).over(w)).filter("kind <> 'purchase'")
    return held.select("stream", "n", F.when(C("set.ok"), C("set.n")).alias("set_n"), F.coalesce(C("set.ok"), F.lit(False)).alias("decodable"))


SETS = f"""WITH {T.FRAMES}, p AS (SELECT stream, n, kind, last_value(CASE WHEN kind = 'purchase' THEN n END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN kind = 'purchase' THEN bytes % 2 = 0 END IGNORE NULLS) OVER w AS ok FROM frames
WINDOW w AS (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT stream, n, CASE WHEN ok THEN s END AS set_n, coalesce(ok, false) AS decodable FROM p WHERE kind <> 'purchase'"""


def first_frames(spark, d):
    """The first twelve frames of each stream in decoding order."""
    at = F.row_number().over(Window.partitionBy("stream").orderBy("n"))
    return T.frames(spark, d).withColumn("at", at).filter("at <= 12").select("stream", "at", "n", "bytes")


FIRST = f"WITH {T.FRAMES} SELECT stream, \"at\", n, bytes FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY n) AS \"at\" FROM frames) WHERE \"at\" <= 12"


def paired_series(spark, d):
    """Two series side by side, as long as the shorter: sizes of views and of clicks of a stream."""
    f = T.frames(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("stream", "kind").orderBy("n")))
    a, b = (f.filter(C("kind") == k).select("stream", "at", C("bytes").alias(name)) for k, name in (("view", "views"), ("click", "clicks")))
    return a.join(b, ["stream", "at"]).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"), F.sum("clicks").alias("clicks"), F.round(F.sum("views") / F.sum("clicks"), 6).alias("ratio"))


PAIRS = f"""WITH {T.FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY stream, kind ORDER BY n) AS i FROM frames)
SELECT a.stream, count(*) AS n, CAST(sum(a.bytes) AS BIGINT) AS views, CAST(sum(b.bytes) AS BIGINT) AS clicks, round(CAST(sum(a.bytes) AS DOUBLE) / CAST(sum(b.bytes) AS DOUBLE), 6) AS ratio FROM r a JOIN r b ON a.stream = b.stream AND a.i = b.i AND a.kind = 'view' AND b.kind = 'click' GROUP BY a.stream"""


def rate_control(spark, d):
    """Constant bitrate over the frames of each stream, 600 kbit/s."""
    f = T.frames(spark, d).select("stream", "n", (C("bytes") * 8.0).alias("complexity"))
    return rate.control(f, 600).select("stream", "n", "qp", "bits", F.round("fullness", 3).alias("fullness"))


RATE = f"""WITH RECURSIVE {T.FRAMES}, f AS (SELECT stream, n, CAST(bytes * 8 AS DOUBLE) AS c, row_number() OVER (PARTITION BY stream ORDER BY n) AS i FROM frames),
r AS (SELECT stream, 0::BIGINT AS i, 0::BIGINT AS n, 0 AS qp, 0::BIGINT AS bits, 600000.0::DOUBLE AS fullness FROM f GROUP BY stream
 UNION ALL SELECT stream, i, n, qp, bits, greatest(0.0::DOUBLE, least(1200000.0::DOUBLE, fullness + bits - 20000.0::DOUBLE)) FROM
 (SELECT stream, i, n, qp, fullness, CASE WHEN c <= 0 THEN 0 ELSE CAST(floor(round(c * pow(2.0::DOUBLE, -(qp - 28) / 6.0::DOUBLE), 6)) AS BIGINT) END AS bits FROM
 (SELECT f.stream, f.i, f.n, f.c, r.fullness, CAST(greatest(0, least(51, 28 + round(round((r.fullness / 1200000.0::DOUBLE - 0.5::DOUBLE) * 18.0::DOUBLE + CASE WHEN floor(round(f.c, 6)) > 0 THEN log2(floor(round(f.c, 6)) / 20000.0::DOUBLE) * 3.0::DOUBLE ELSE 0 END, 9)))) AS INT) AS qp
 FROM r JOIN f ON f.stream = r.stream AND f.i = r.i + 1)))
SELECT stream, n, qp, bits, round(fullness, 3) AS fullness FROM r WHERE i > 0"""


def fixed_qp(spark, d):
    """Bits at a fixed parameter, and at six more: half of them."""
    f = T.frames(spark, d).select("stream", "n", (C("bytes") * 8.0).alias("complexity"))
    a, b = rate.fixed(f, 28), rate.fixed(f, 34).select("stream", "n", C("bits").alias("coarser"))
    return a.join(b, ["stream", "n"]).groupBy("stream").agg(F.sum("bits").alias("bits"), F.sum("coarser").alias("coarser"))


FIXED = f"WITH {T.FRAMES} SELECT stream, CAST(sum(bytes * 8) AS BIGINT) AS bits, CAST(sum(bytes * 4) AS BIGINT) AS coarser FROM frames GROUP BY stream"


def table_binding(spark, d):
    """Components bound to tables by number: nations to regions, with 0 for those unbound; the first of equal numbers wins."""
    n, r = T.read(spark, d, "nation"), T.read(spark, d, "region")
    tables = r.groupBy(C("r_regionkey").alias("k")).agg(F.min("r_name").alias("name")).filter("k < 4")
    return n.select("n_nationkey", "n_name", C("n_regionkey").alias("k")).join(F.broadcast(tables), "k", "left").select("n_nationkey", "n_name", F.when(C("name").isNull(), 0).otherwise(C("k")).alias("table"), F.coalesce("name", F.lit("missing")).alias("name"))


BINDING = "SELECT n_nationkey, n_name, CASE WHEN r_name IS NULL THEN 0 ELSE n_regionkey END AS \"table\", coalesce(r_name, 'missing') AS name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 4"


def missing_tables(spark, d):
    """Customers whose table (an order) is missing: errors, counted by segment."""
    c, o = T.read(spark, d, "customer"), T.read(spark, d, "orders")
    lost = c.join(o.select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    found = c.join(o.select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    count = lambda x, name: x.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias(name))
    return count(found, "found").join(count(lost, "missing"), "c_mktsegment", "left").select("c_mktsegment", "found", F.coalesce("missing", F.lit(0)).alias("missing"))


MISSING = "SELECT c_mktsegment, count_if(c_custkey IN (SELECT o_custkey FROM orders)) AS found, count_if(c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing FROM customer GROUP BY 1"


def names(spark, d):
    """Names of NAL types, slice kinds, macroblock classes and intra modes for the numbers that parts make."""
    p = T.read(spark, d, "part").select("p_partkey", (C("p_size") % 32).alias("t"))
    nal = dims.names(spark, dims.NAL_TYPES).select(C("code").alias("t"), "name")
    mode, chroma, luma = S.intra16_parts(C("t"))
    j = p.join(F.broadcast(nal), "t", "left")
    return j.select("p_partkey", F.coalesce("name", F.format_string("TYPE%d", "t")).alias("nal"), S.slice_kind(C("t") % 10).alias("slice"), S.mb_class_i(C("t")).alias("class_i"), S.mb_class_p(C("t")).alias("class_p"), S.pick(dims.INTRA4_MODES, C("t") % 9).alias("mode"), F.when(C("t").between(1, 24), F.concat_ws("/", mode, chroma, luma)).alias("i16"))


def _case(of: dict) -> str:
    return "CASE t " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in of.items()) + " END"


def _class(t: str) -> str:
    return f"CASE WHEN {t} = 0 THEN 'I4x4' WHEN {t} <= 24 THEN 'I16x16' WHEN {t} = 25 THEN 'IPCM' ELSE 'invalid' END"


NAMES = f"""WITH p AS (SELECT p_partkey, p_size % 32 AS t FROM part) SELECT p_partkey, coalesce({_case(dims.NAL_TYPES)}, 'TYPE' || t) AS nal, ['P', 'B', 'I', 'SP', 'SI'][t % 10 % 5 + 1] AS slice, {_class('t')} AS class_i,
CASE WHEN t <= 4 THEN 'P' ELSE {_class('(t - 5)')} END AS class_p, {list(dims.INTRA4_MODES)}[t % 9 + 1] AS mode, CASE WHEN t BETWEEN 1 AND 24 THEN ((t - 1) % 4) || '/' || ((t - 1) // 4 % 3) || '/' || CASE WHEN t >= 13 THEN 15 ELSE 0 END END AS i16 FROM p"""

QUERIES = {
    "frame_type_histogram": (type_histogram, HIST), "frame_size_stats": (size_stats, STATS), "frame_index_offsets": (index_offsets, OFFSETS), "frame_worst_gap": (worst_gap, GAP), "frame_display_order": (display_order, ORDER),
    "frame_parameter_sets": (parameter_sets, SETS), "frame_first": (first_frames, FIRST), "frame_paired_series": (paired_series, PAIRS), "rate_control": (rate_control, RATE), "rate_fixed": (fixed_qp, FIXED),
    "join_table_binding": (table_binding, BINDING), "join_missing_tables": (missing_tables, MISSING), "names_by_code": (names, NAMES),
}


def window_report(spark, d):
    """Kinds of frames by windows of ten minutes; an extension that the batch and the streaming form share."""
    from lumenflow.streaming import frames as live

    e = T.read(spark, d, "events").select(C("ts").cast("timestamp").alias("ts"), C("event_type").alias("kind"), F.floor(C("value") * 100).cast("long").alias("bytes"))
    return live.window_report(e).select(F.unix_micros("start").alias("start"), "kind", "n", "bytes")


WINDOWS = "SELECT epoch_us(time_bucket(INTERVAL '10 minutes', ts)) AS start, event_type AS kind, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY ALL"
QUERIES["frame_window_report"] = (window_report, WINDOWS)
