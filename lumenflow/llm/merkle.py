"""Operator 12: a Merkle manifest of a table, with a proof for every row.

Each row is a leaf; leaves of a source are in order of their ids, and runs of three become the hash of their digests until one is left,
the subroot; subroots are treated likewise and give the root. Aligned blocks of 3**5 nodes are whole subtrees: one group each,
walked in postorder by a recursion that returns the digest of a subtree and, while it unwinds, appends siblings to the leaves below.
The roots of blocks are the nodes of the next distributed traversal. On the way down each block meets the path of its root, so that a
leaf's siblings up to the root come together without being stored. Texts stay where they are: a row moves as two digests.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import fold, small, stored, table

ARITY = 3
#: Levels that are walked within a block: it has ARITY**LEVELS nodes.
LEVELS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """Digest of a row: each value by its length in bytes, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def traverse(nodes: list[str], levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Digest of an aligned subtree of ``levels`` levels over its nodes, and for each of them the siblings to the left and to the right at
    each level, from below."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]

    def visit(start: int, level: int) -> str:
        if level == 0:
            return nodes[start]
        step = ARITY ** (level - 1)
        places = range(start, min(start + ARITY * step, len(nodes)), step)
        found = [visit(p, level - 1) for p in places]
        for k, p in enumerate(places):
            beside = "".join(found[:k]), "".join(found[k + 1 :])
            for path in paths[p : p + step]:
                path.append(beside)
        return digest("".join(found))

    return visit(0, levels), paths


def height(n: int, most: int) -> int:
    """Levels to walk in a block of a group of n nodes: ``most``, or as many as leave one node."""
    levels = 0
    while levels < most and ARITY**levels < n:
        levels += 1
    return levels


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with idx, the place within their key in the given order, and n, the rows of that key.

    ``rows`` is stored. Rows are dealt by ranges of (key, order), so that a large key lies over many partitions; a range begins where
    those before it end. Rows that are equal in all of it are dealt too, by where they were read."""
    by = ["key", *order, "_nth"]
    dealt = rows.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = stored(dealt.drop("_nth").select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")))
    runs = stored(dealt.groupBy("key", "_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_c")))  # a row for each key and range
    whole = Window.partitionBy("key")
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(runs.select("key", "_p", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_c").over(whole).alias("n")))
    joined = dealt.join(F.broadcast(starts) if small(starts) else starts, ["key", "_p"])
    return joined.select(*rows.columns, (F.col("_i") + F.col("_start")).alias("idx"), "n")


def _blocks(nodes: DataFrame, deep: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {ARITY**deep}"))


def climb(nodes: DataFrame, deep: int = LEVELS) -> list[DataFrame]:
    """Stored tables (key, idx, n, digest): the given nodes, the roots of their blocks, of the blocks of these, and so on until every
    key has one node."""

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        n = int(rows.n.iloc[0])
        top, _ = traverse(rows.digest.tolist(), height(n, deep))
        return pd.DataFrame({"key": rows.key.iloc[:1], "idx": rows.block.iloc[:1], "n": [-(-n // ARITY**deep)], "digest": [top]})

    levels = [nodes]
    while not (open_ := levels[-1].filter("n > 1")).isEmpty():
        levels.append(stored(_blocks(open_.select("key", "idx", "n", "digest"), deep).groupBy("key", "block").applyInPandas(root, "key string, idx long, n long, digest string")))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(key, digest): the one node that each key ends in."""
    ends = [d.filter("n = 1").select("key", "digest") for d in levels]
    out = ends[0]
    for d in ends[1:]:
        out = out.unionByName(d)
    return out


#: A path is one text: the siblings to the left and to the right at each level, from below.
PATH = "key string, idx long, path string"


def _written(path: list[tuple[str, str]]) -> str:
    return "".join(f"{a}|{b};" for a, b in path)


def _below(nodes: DataFrame, tops: DataFrame, parents: DataFrame | None, finish, schema: str, deep: int) -> DataFrame:
    """``finish`` of the rows of each block and the siblings of each row up to the top. ``tops`` (key, path, ...) has a row for each key,
    ``parents`` (key, idx, path) one for each block of a key of several nodes."""

    def meet(_, rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        _, paths = traverse(rows.digest.tolist(), height(int(rows.n.iloc[0]), deep)) if len(rows) else ("", [])
        return finish(rows, [_written(p) + up.path.iloc[0] for p in paths], up)

    alone = nodes.filter("n = 1").select("key").join(tops, "key").withColumn("idx", F.lit(0).cast("long"))
    above = alone if parents is None else parents.join(tops.drop("path"), "key").unionByName(alone.select(*parents.columns, *[c for c in tops.columns if c not in ("key", "path")]))
    above = above.select(F.col("key").alias("up_key"), F.col("idx").alias("up_block"), *[c for c in above.columns if c not in ("key", "idx")])
    return _blocks(nodes, deep).groupBy("key", "block").cogroup(above.groupBy("up_key", "up_block")).applyInPandas(meet, schema)


def descend(levels: list[DataFrame], tops: DataFrame, deep: int = LEVELS) -> DataFrame | None:
    """(key, idx, path) of the roots of the lowest blocks."""

    def paths(rows: pd.DataFrame, found: list[str], _) -> pd.DataFrame:
        return pd.DataFrame({"key": rows.key, "idx": rows.idx, "path": found})

    parents = None
    for nodes in levels[:0:-1]:
        parents = stored(_below(nodes, tops.select("key", "path"), parents, paths, PATH, deep))
    return parents


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, deep: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``tampered`` is the leaf from which the root is folded again with the original siblings; without it, the row's own. Leaves of a
    source are in order of doc_id, a null id first; rows that repeat an id go by their digest, so that the root does not depend on
    where they were read. A null source is one of its own, before the empty one. An empty table gives no rows. Other columns are
    ignored, whatever their names."""
    own = leaf([docs[c] for c in fields])
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = F.when(docs["source"].isNull(), "").otherwise(F.concat(F.lit(":"), docs["source"].cast("string")))
    rows = stored(docs.select(source.alias("key"), docs["doc_id"].alias("id"), own.alias("digest"), (own if tampered is None else tampered).alias("other")))
    leaves = numbered(rows, ["id", "digest"])
    trees = climb(leaves, deep)
    subroots = stored(roots(trees).select(F.lit("").alias("key"), F.col("key").alias("source"), "digest"))
    whole = stored(numbered(subroots, ["source"]))
    upper = climb(whole, deep)
    # The root has no siblings; its path is empty.
    root = stored(roots(upper).select("key", F.lit("").alias("path"), F.col("digest").alias("root")))

    def of_source(rows: pd.DataFrame, found: list[str], up: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": rows.source, "path": found, "subroot": rows.digest, "root": up.root.iloc[0] if len(rows) else None})

    tops = stored(_below(whole, root, descend(upper, root, deep), of_source, "key string, path string, subroot string, root string", deep))

    def of_leaf(rows: pd.DataFrame, found: list[str], up: pd.DataFrame) -> pd.DataFrame:
        proof, folded = [], []
        for path, cur in zip(found, rows.other, strict=True):
            proof.append(digest(path.replace("|", "").replace(";", "")))
            for step in path.split(";")[:-1]:
                left, right = step.split("|")
                cur = digest(left + cur + right)
            folded.append(cur)
        top = up.root.iloc[0] if len(rows) else None
        return pd.DataFrame({"doc_id": rows.id, "leaf": rows.digest, "subroot": up.subroot.iloc[0] if len(rows) else None, "root": top, "proof_sha256": proof, "folded_root": folded, "verified": [f == top for f in folded]})

    out = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _below(leaves, tops, descend(trees, tops, deep), of_leaf, out, deep)


def without_newlines(docs: DataFrame) -> Column:
    """The leaf of a row whose text lost its line ends, where 2 divides the checksum of its id; the row's own elsewhere, and where the id is
    null."""
    own = leaf([docs[c] for c in FIELDS])
    cut = leaf([F.replace(docs[c], F.lit("\n"), F.lit("")) if c == "text" else docs[c] for c in FIELDS])
    return F.when(docs["doc_id"].isNotNull() & (fold(docs["doc_id"], 2) == 0) & docs["text"].contains("\n"), cut).otherwise(own)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: leaf, proof and root of every document, and whether its tampered row is found out."""
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, without_newlines(docs))


def _sql_leaf(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" if c != "text" else text for c in FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE CAST(strlen({v}) AS VARCHAR) || ':' || {v} END" for v in values) + ")"


def _sql_siblings(name: str, tree: str, key: str) -> str:
    side = lambda op: f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i {op} a.i), '')"
    return f"{name} AS (SELECT {key}a.lv, a.i, {side('<')} AS l, {side('>')} AS r FROM {tree} a JOIN {tree} b ON {'a.k = b.k AND ' if key else ''}a.lv = b.lv AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL)"


SQL = f"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(':' || source, '') AS k, {_sql_leaf("text")} AS leaf, {_sql_leaf("replace(text, chr(10), '')")} AS cut,
  list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)) + z)) & 1 AS low FROM documents),
e AS (SELECT *, CASE WHEN low = 1 THEN cut ELSE leaf END AS other, row_number() OVER (PARTITION BY k ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
t(lv, k, i, n, h) AS (SELECT 0, k, i, n, leaf FROM e UNION ALL SELECT lv + 1, k, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lv, k, i // 3, (n + 2) // 3),
s AS (SELECT k, lv AS top, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, i, n, h) AS (SELECT 0, i, n, h FROM s UNION ALL SELECT lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 3, (n + 2) // 3),
{_sql_siblings("x", "t", "a.k, ")},
{_sql_siblings("y", "u", "")},
f(k, i, lv, j, cur, proof) AS (SELECT k, i, 0, i, other, '' FROM e UNION ALL SELECT f.k, f.i, f.lv + 1, j // 3, sha256(l || cur || r), proof || l || r FROM f JOIN x ON x.k = f.k AND x.lv = f.lv AND x.i = f.j),
g(k, i, lv, j, cur, proof) AS (SELECT f.k, f.i, 0, s.i, cur, proof FROM f JOIN s ON s.k = f.k AND s.top = f.lv UNION ALL SELECT g.k, g.i, g.lv + 1, j // 3, sha256(l || cur || r), proof || l || r FROM g JOIN y ON y.lv = g.lv AND y.i = g.j)
SELECT doc_id, leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u.h AS verified
FROM e JOIN s ON s.k = e.k JOIN g ON g.k = e.k AND g.i = e.i JOIN u ON u.n = 1 AND u.lv = g.lv
"""
