"""Operator 11: how five filters interact, with duplicates found by partition refinement.

Documents are split by their number of code points, then by a hash of one block of text after the other, and whoever is alone in its
part drops out. What is left is compared by whole texts: Spark groups them by (part, text), so that copies meet as one row a task
before anything moves, and a part that held two different texts is split by its texts. Ids that are not the smallest of their text fail
filter E. Every document is then a mask of five bits; masks are counted, and all 120 orders of the filters are told from the counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.common import small, stored, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Ends of the blocks in code points; the last block is the rest of the text, however long.
ENDS = (512, 4096, 32768)
BLOCKS = [f"h{k}" for k in range(len(ENDS) + 1)]
KEY = ["n", *BLOCKS]


def block_hashes(text: Column, identity=F.xxhash64) -> list[Column]:
    """(n, h0, h1, ...): code points of a text and the hashes of its blocks; 0 for blocks that it does not reach."""
    n = F.length(text)
    starts = (0, *ENDS)
    widths = [*(b - a for a, b in zip(starts, ENDS, strict=False)), None]
    hashes = [F.when(n > s, identity(F.substring(text, s + 1, w) if w else F.substr(text, F.lit(s + 1)))).otherwise(F.lit(0)).cast("long") for s, w in zip(starts, widths, strict=True)]
    return [n.alias("n"), *[h.alias(name) for h, name in zip(hashes, BLOCKS, strict=True)]]


def masks(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for a text that fails A, B, C and D."""
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    few = lambda w: F.when(F.size(w) < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    loud = F.when(100 * capitals.cast("long") > 3 * F.length(text).cast("long"), 4).otherwise(0)
    odd = F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    # The words are made once: as the one element of an array that a lambda takes.
    return F.element_at(F.transform(F.array(words), few), 1) + loud + odd


def _texts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col], F.lit("")).alias("t"))


def _sent(keys: DataFrame) -> DataFrame:
    """A stored table for a join: broadcast if it is small; beyond, both sides are shuffled, and Spark splits a hot key."""
    return F.broadcast(keys) if small(keys) else keys


def refined(rows: DataFrame) -> DataFrame:
    """KEY of every class of more than one of ``rows`` (KEY): by length, then block by block; those alone are dropped at each step."""
    alive = rows.select(KEY)
    for k in range(len(KEY)):
        by = KEY[: k + 1]
        several = stored(alive.groupBy(by).count().filter("count > 1").select(by))
        alive = alive.join(_sent(several), by, "left_semi")
        if k == 0:  # most rows are gone: the rest is read again and again
            alive = stored(alive)
    return several


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", identity=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: (id, part, mask). Bit 16 is set where a row with a smaller id has the same text.

    A null id is neither smaller nor larger than others; rows that repeat an id are no smaller than each other. A null text is empty
    and equals other empty texts; a null part is the empty name. ``identity`` hashes a block: classes are split by whole texts
    whatever it does."""
    texts = _texts(docs, id_col, text_col, part_col)
    signed = texts.select("*", *block_hashes(F.col("t"), identity))
    rows = stored(signed.select("id", "part", masks(F.col("t")).alias("mask"), *KEY))
    classes = refined(rows)
    left = signed.join(_sent(classes), KEY, "left_semi")
    # Whole texts are compared here: a row for each text of a class.
    seen = stored(left.groupBy(*KEY, "t").agg(F.min("id").alias("first")).select(*KEY, "first"))
    counted = stored(seen.groupBy(KEY).agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")))
    pure = counted.filter("texts = 1").select(*KEY, "first")
    mixed = stored(counted.filter("texts > 1").select(KEY))
    marked = lambda r: r.select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)).alias("mask"))
    if mixed.isEmpty():
        return marked(rows.join(_sent(pure), KEY, "left"))
    # Different texts with equal lengths and hashes: these rows go by their texts.
    out = marked(rows.join(_sent(mixed), KEY, "left_anti").join(_sent(pure), KEY, "left"))
    again = signed.join(_sent(mixed), KEY, "left_semi")
    firsts = again.groupBy("t").agg(F.min("id").alias("first"))
    return out.unionByName(marked(again.withColumn("mask", masks(F.col("t"))).join(firsts, "t")))


def counts(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic) of rows (id, part, mask): documents, and those that ``labels`` marks as good and as toxic.

    An id with several labels is good (toxic) if one of them says so; null labels say nothing."""
    said = labels.groupBy(labels[id_col].alias("id")).agg(F.max(F.when(labels["quality"] == 1, 1).otherwise(0)).alias("good"), F.max(F.when(labels["toxic"] == 1, 1).otherwise(0)).alias("toxic"))
    said = stored(said.filter("good + toxic > 0 and id is not null"))
    return rows.join(_sent(said), "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(found: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from counts (part, mask, n, good, toxic): at most 32 of them a part."""
    held = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    bit = "shiftleft(1, instr('ABCDE', substring(filter_order, {}, 1)) - 1)"
    steps = held.select("part", "m", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.select("*", F.expr(bit.format("step")).alias("own"), F.expr(f"aggregate(filter(sequence(1, 5), i -> i < step), 0, (a, i) -> a | {bit.format('i')})").alias("before"))
    sums = {
        "kept": "if(x.mask & (before | own) = 0, x.n, 0)",
        "removed": "if(x.mask & own <> 0 and x.mask & before = 0, x.n, 0)",
        "redundant": "if(x.mask & own <> 0 and x.mask & before <> 0, x.n, 0)",
        "unique_fails": "if(x.mask = own, x.n, 0)",
        "good_lost": "if(x.mask & own <> 0 and x.mask & before = 0, x.good, 0)",
        "toxic_lost": "if(x.mask & own <> 0 and x.mask & before = 0, x.toxic, 0)",
        # Of all orders, a filter comes first among the b that a document fails in one of b.
        "shapley": f"if(x.mask & own <> 0, x.n * {len(ORDERS)} div bit_count(x.mask), 0)",
    }
    return steps.select("part", "filter_order", "step", *[F.expr(f"aggregate(m, 0L, (a, x) -> a + {e})").alias(name) for name, e in sums.items()])


def query(spark, sf_dir: str) -> DataFrame:
    """op11: what each filter removes at each place of each order, by language."""
    return audit(counts(flagged(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > lo, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, CAST(a AS INT) + b::INT + c::INT + d::INT + e::INT AS bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
o AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1 : step - 1] AS before FROM p, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
r AS (SELECT part, filter_order, step, n, good, toxic, bits, fails[own] AS own, len(list_filter(string_split(before, ''), lambda k: k <> '' AND fails[k])) > 0 AS gone FROM g, o)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE own AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE own AND bits = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(bits, 1)) FILTER (WHERE own), 0) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step
"""
