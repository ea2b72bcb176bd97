"""Operator 9: mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The rows of a source are dealt, in an order that a digest of their id fixes, into blocks. Block k of a source whose target is m
of M slots may start no earlier than slot floor(k * M / m) and must be over by slot ceil((k + 1) * M / m). Earliest deadline
first over released blocks meets every deadline, so at any time each source is less than one block away from its target. The
windows repeat after M slots, so the schedule of M slots is made once, in one small row, and every block looks its slot up.

Weights that are given are met exactly where their ratio is one of whole numbers that add up to EXACT slots at most (0.7, 0.2, 0.1 or
thirds, or 0.0001 of the whole): the cycle is that sum. Beyond, and for the targets that are made of the rows, a cycle has about UNITS slots and targets are
the nearest multiples of one of them. A positive weight has one slot at least. A source of weight 0 has no slot among the others: it
comes after them.
"""

from __future__ import annotations

import re
from fractions import Fraction
from itertools import accumulate
from math import gcd, lcm

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import small, stored, table

#: Slots that are dealt out by weight before the schedule repeats: the resolution of targets that no shorter cycle meets exactly.
UNITS = 4096
#: Slots of the longest cycle that meets weights exactly: one task makes it.
EXACT = 32768
BLOCK_ROWS = 16
#: Rows of a source that are ordered together, about.
RUN_ROWS = 256


def ratio(weights: dict[str, float]) -> dict[str, int] | None:
    """The smallest whole numbers in the ratio of the weights, which are read as fractions of denominators up to a million; None where they
    add up to more than EXACT."""
    parts = {k: Fraction(v).limit_denominator(10**6) for k, v in weights.items()}
    if any(v > 0 and not parts[k] for k, v in weights.items()):
        return None
    common = lcm(*(p.denominator for p in parts.values()))
    whole = {k: int(p * common) for k, p in parts.items()}
    least = gcd(*whole.values()) or 1
    whole = {k: n // least for k, n in whole.items()}
    return whole if sum(whole.values()) <= EXACT else None


def shares(counts: DataFrame, weights: dict[str, float] | None = None, units: int = UNITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, n, m, cycle, after): m of cycle slots are the source's; the slots from ``after`` on are free for it once the others
    have ended. Without weights, targets go with the square root of a source's rows, which lifts small sources against large ones.
    A source that ``weights`` does not name has weight 0."""
    if weights is None:
        w = F.floor(1000 * F.sqrt("n"))
    else:
        there = {r[0] for r in counts.filter(F.col("source").isin(list(weights))).select("source").collect()}  # no more than weights names
        whole = ratio({k: v for k, v in weights.items() if k in there})
        if whole and sum(whole.values()):
            units = sum(whole.values())
        given = whole or {k: round(v * 1e6) or int(v > 0) for k, v in weights.items()}
        pairs = [F.lit(x) for k, v in given.items() for x in (k, v)]
        w = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0)) if pairs else F.lit(1)
    out = counts.withColumn("w", w.cast("long"))
    total = F.greatest(F.lit(1), F.coalesce(F.sum("w"), F.lit(0))).alias("total")
    out = out.crossJoin(out.agg(total)).withColumn("m", F.expr(f"if(w > 0, greatest(1, ({units} * w + total div 2) div total), 0)"))  # one row
    out = out.withColumn("blocks", F.expr(f"(n + {block_rows - 1}) div {block_rows}"))
    whole = out.agg(F.sum("m").alias("cycle"), F.coalesce(F.max(F.expr("if(m > 0, (blocks + m - 1) div m, 0)")), F.lit(0)).alias("cycles"))  # one row
    before = Window.partitionBy("m").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)  # a row for each source
    after = F.expr("cycles * cycle") + F.when(F.col("m") == 0, F.coalesce(F.sum("blocks").over(before), F.lit(0))).otherwise(0)
    return out.crossJoin(whole).select("source", "n", "m", "cycle", after.alias("after"))


def pattern(share: DataFrame) -> DataFrame:
    """(source, k, at): the slot of each source's k-th block in a cycle, by earliest deadline first; equal deadlines go by name."""
    one = share.filter("m > 0").groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("source", "m"))).alias("s"))
    picks = """
        aggregate(sequence(0, int(cycle) - 1), named_struct('done', transform(s, x -> 0L), 'picks', cast(array() as array<int>)),
          (acc, t) -> transform(array(array_min(filter(transform(s, (x, i) -> if(acc.done[i] < x.m and (acc.done[i] * cycle) div x.m <= t,
              named_struct('d', ((acc.done[i] + 1) * cycle + x.m - 1) div x.m, 'i', i), null)), c -> c is not null)).i),
            i -> named_struct('done', transform(acc.done, (n, j) -> if(j = i, n + 1, n)), 'picks', concat(acc.picks, array(i))))[0],
          acc -> acc.picks)"""
    slots = one.select("s", F.posexplode(F.expr(picks)).alias("at", "i")).select(F.expr("s[i].source").alias("source"), "at")
    return slots.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1).alias("k"), "at")


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, units: int = UNITS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: (row struct with all columns, source, block_no, block_pos, slot, release, deadline).

    Sorted by (slot, block_pos) the rows are mixed. A null source counts as the empty name; a null id is ordered as empty text;
    repeated rows each have a place, and rows that repeat an id are told apart by their other columns. When a source is used up its
    slots stay empty and the others go on; blocks of weight 0 follow in order of source, released when they come and without a
    deadline. An empty table gives an empty result. Nothing is dropped. Columns of ``docs`` may have any names: they travel in
    ``row``."""
    rows = docs.select(F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"), F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")).alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    keys = docs.select(F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"), F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")).alias("h"))
    # Runs of a source's order: by the first digits of the digest, four where the table is large.
    fine = stored(keys.groupBy("source", F.substring("h", 1, 4).alias("b")).count())
    counts = fine.groupBy("source").agg(F.sum("count").alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    digits = next((d for d in range(1, 4) if largest <= RUN_ROWS * 16**d), 4)
    run = F.substring("b", 1, digits)
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = fine.groupBy("source", run.alias("b")).agg(F.sum("count").alias("c")).select("source", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    # A row for each source, and M rows of the pattern.
    share = stored(shares(counts, weights, units, block_rows))
    slots = stored(pattern(share))
    sent = F.broadcast if small(share) else lambda d: d
    told = F.xxhash64(*[F.col("row")[c].cast("string") for c in docs.columns])
    within = Window.partitionBy("source", "b").orderBy("h", told)
    placed = rows.withColumn("b", F.substring("h", 1, digits)).withColumn("r", F.row_number().over(within) - 1)
    blocks = placed.join(stored(offsets).hint("merge"), ["source", "b"]).join(sent(share), "source").withColumn("pos", F.col("first") + F.col("r"))
    blocks = blocks.withColumn("block_no", F.expr(f"pos div {block_rows}")).withColumn("block_pos", F.expr(f"pos % {block_rows}"))
    out = blocks.withColumn("k", F.expr("if(m > 0, int(block_no % m), null)")).join(sent(slots), ["source", "k"], "left")
    slot = F.expr("if(m > 0, (block_no div m) * cycle + at, after + block_no)").alias("slot")
    release = F.expr("if(m > 0, (block_no * cycle) div m, after + block_no)").alias("release")
    return out.select("row", "source", "block_no", "block_pos", slot, release, F.expr("if(m > 0, ((block_no + 1) * cycle + m - 1) div m, null)").alias("deadline"))


def mixed(docs: DataFrame, slots_per_run: int = 64, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, within each partition and from one to the next: written, the files follow it."""
    plan = schedule(docs, **options).withColumn("part", F.expr(f"slot div {slots_per_run}"))
    return plan.repartitionByRange("part").sortWithinPartitions("slot", "source", "block_pos").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def placed(docs: DataFrame, *columns: str, name: str = "place") -> DataFrame:
    """Columns of ``docs`` as read from files and the number of each row, from 0 on, in the order in which the files were written.
    Rows that do not come from Parquet files have no such order, and no such column."""
    try:
        rows = docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"))
    except AnalysisException:
        return docs.select(*columns)
    counts = [(r[0], r[1]) for r in rows.groupBy("file").count().collect()]  # a row for each file
    part = lambda path: (int((re.findall(r"part-(\d+)", path) or ["0"])[-1]), path)
    counts.sort(key=lambda c: part(c[0]))
    first = list(accumulate((n for _, n in counts), initial=0))
    starts = docs.sparkSession.createDataFrame([(f, i) for (f, _), i in zip(counts, first, strict=False)], "file string, start long")
    return rows.join(F.broadcast(starts), "file").select(*columns, (F.col("start") + F.col("nth")).alias(name))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the place of every document in the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return schedule(docs).select("row.doc_id", "source", "block_no", "block_pos", "slot", "release", "deadline")


SQL = f"""
WITH RECURSIVE
c AS (SELECT coalesce(source, '') AS source, count(*) AS n, CAST(floor(1000 * sqrt(count(*))) AS BIGINT) AS w FROM documents GROUP BY 1),
g AS (SELECT source, n, greatest(1, ({UNITS} * w + (SELECT sum(w) FROM c) // 2) // (SELECT sum(w) FROM c))::BIGINT AS m FROM c),
s AS (SELECT source, n, m, (SELECT sum(m) FROM g)::BIGINT AS mm, row_number() OVER (ORDER BY source) AS i FROM g),
l AS (SELECT list(m ORDER BY i) AS ms, max(mm) AS mm, count(*) AS k FROM s),
e AS (
  SELECT 0::BIGINT AS t, list_transform(ms, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM l
  UNION ALL
  SELECT t + 1, list_transform(range(1, k + 1), lambda j: done[j] + CASE WHEN j = p THEN 1 ELSE 0 END), p
  FROM (SELECT t, done, k, list_min(list_filter(list_transform(range(1, k + 1), lambda j:
            CASE WHEN done[j] < ms[j] AND (done[j] * mm) // ms[j] <= t THEN (((done[j] + 1) * mm + ms[j] - 1) // ms[j]) * 1000000 + j END),
            lambda x: x IS NOT NULL)) % 1000000 AS p
        FROM e, l WHERE t < mm)
),
a AS (SELECT pick AS i, t - 1 AS off, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM e WHERE t > 0),
d AS (SELECT doc_id, coalesce(source, '') AS source,
             row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), ''))) - 1 AS pos FROM documents),
b AS (SELECT doc_id, d.source, pos // {BLOCK_ROWS} AS block_no, pos % {BLOCK_ROWS} AS block_pos, m, mm, i FROM d JOIN s ON d.source = s.source)
SELECT doc_id, source, block_no, block_pos, (block_no // m) * mm + off AS slot, (block_no * mm) // m AS release,
       ((block_no + 1) * mm + m - 1) // m AS deadline
FROM b JOIN a ON a.i = b.i AND a.k = b.block_no % m
"""
