"""Operator 10: exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so. Every distinct chunk gets an identifier that is verified against the chunk's whole
content; a text is then its ordered list of identifiers, and texts are equal if and only if their lists are. Chunk contents move
once, to be verified; afterwards documents move as short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.common import ascii_lower, by_ids, stored, table

#: At least 512 characters, then up to the next end of a sentence or line; 4,096 at most.
CHUNK = r"(?s).{512,4096}?(?:[.\n]|\z)|.{1,4096}"


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; together they are the text. An empty text has none."""
    return F.filter(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)), lambda c: c != "")


def collisions(texts: DataFrame, identity) -> dict[str, int]:
    """Chunks whose identifier stands for other contents too, with a number that tells them apart.

    Compares whole contents. For 64-bit identifiers of n chunks about n * n / 2**65 collide, so that the result is empty or a
    handful even for 10**11 chunks; it is the only thing that comes to the driver."""
    distinct = texts.select(F.explode(chunks(F.col("_t"))).alias("_c")).groupBy(identity(F.col("_c")).alias("_h"), "_c").agg(F.lit(1).alias("_n"))
    twice = stored(distinct.groupBy("_h").count().filter("count > 1").select("_h"))
    if twice.isEmpty():
        return {}
    found = texts.select(F.explode(chunks(F.col("_t"))).alias("_c")).select(identity(F.col("_c")).alias("_h"), "_c").join(twice, "_h", "left_semi").distinct()
    out: dict[str, int] = {}
    last, n = None, 0
    for h, c in found.orderBy("_h", "_c").collect():
        last, n = h, n + 1 if h == last else 0
        out[c] = n
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identity=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts equal each other. Of equal texts
    the row with the largest id stays (a null id never does while there is another); rows that repeat that id are marked as kept
    too, since nothing tells them apart. Other columns are ignored."""
    texts = docs.select(docs[id_col].alias("_id"), ascii_lower(F.coalesce(docs[text_col], F.lit(""))).alias("_t"))
    number = collisions(texts, identity)
    recipe = [F.transform("_c", lambda c: identity(c)).alias("_r")]
    if number:
        known = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
        recipe.append(F.transform("_c", lambda c: F.coalesce(known[c], F.lit(0))).alias("_o"))
    else:
        recipe.append(F.array().cast("array<int>").alias("_o"))
    rows = stored(texts.select("_id", chunks(F.col("_t")).alias("_c"), F.sha2("_t", 256).alias("_s")).select("_id", *recipe, "_s"))
    # Only groups of several rows are joined back. Both sides of the join are read from storage, so that Spark may split a group
    # that holds a large part of all rows.
    several = stored(rows.groupBy("_r", "_o").agg(F.max("_id").alias("_k"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    out = rows.join(several, ["_r", "_o"], "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_k"))
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_s").alias("text_sha256"))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; of rows that repeat an id and a text one stays.

    Texts are not moved by content: the ids that go are, and they meet the rows by id."""
    found = stored(groups(docs, id_col, text_col).filter("group_size > 1").select(id_col, "keep_id", "kept", "text_sha256"))
    gone = stored(found.filter("not kept").select(id_col).distinct())
    rest = by_ids(docs, gone, id_col, "left_anti")
    blank = docs.filter(F.col(id_col).isNull())
    if not blank.isEmpty():  # rows that no id can name: they meet the groups by content
        norm = blank.withColumn("_t", ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_s", F.sha2("_t", 256))
        named = found.filter("keep_id is not null").select(F.col("text_sha256").alias("_s")).distinct()
        rest = rest.filter(F.col(id_col).isNotNull()).unionByName(norm.join(named, "_s", "left_anti").dropDuplicates(["_t"]).select(docs.columns))
    twice = stored(found.filter("kept").groupBy(id_col, "text_sha256").count().filter("count > 1").select(id_col).distinct())
    if twice.isEmpty():
        return rest
    again = by_ids(rest, twice, id_col, "left_semi").withColumn("_t", ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([id_col, "_t"]).drop("_t")
    return by_ids(rest, twice, id_col, "left_anti").unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: group and decision of every document."""
    return groups(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
