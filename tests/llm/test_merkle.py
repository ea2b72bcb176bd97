"""Operator 12 against a plain version level by level, and its SQL on DuckDB."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d.doc_id, d.source, d.lang, d.n_chars, text)))


def tree(nodes):
    """Levels of a tree, from its nodes to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        at = i // 3 * 3
        out.append((nodes[at:i], nodes[i + 1 : at + 3]))
        i //= 3
    return out


def plain(docs):
    by = defaultdict(list)
    for d in docs:
        by[d.source].append((d.doc_id is not None, d.doc_id, leaf(d, d.text), d))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, doc_id, own, d) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(top, k)
            cur = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and d.text is not None:
                cur = leaf(d, d.text.replace("\n", ""))
            for a, b in steps:
                cur = h(*a, cur, *b)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], h(*[x for a, b in steps for x in a + b]), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted(map(tuple, merkle.manifest(docs, merkle.without_newlines(docs), **options).collect()), key=str)


def test_manifest(spark, small, edges, none):
    for docs in (small, edges, none):
        assert found(docs) == plain(docs.collect())


@pytest.mark.parametrize("n", [1, 3, 10, 28])
def test_blocks(spark, n):
    """Blocks of nine nodes: several traversals, last blocks of few nodes and of one, a large source, one of a row, a null source."""
    rows = [(i, f"text\n{i}", "en", None if i % 11 == 5 else "" if i % 11 == 7 else "hot" if i % 3 else f"s{i % (2 * n)}", i) for i in range(n * 9)]
    docs = spark.createDataFrame(rows[::-1] + rows[:2], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs, deep=2) == plain(docs.collect())


def test_untampered(spark, small):
    rows = merkle.manifest(small).collect()
    assert len(rows) == small.count() and all(r.verified and r.folded_root == r.root for r in rows)
    changed = merkle.manifest(small.withColumn("lang", F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang")))).first()
    assert changed.root != rows[0].root


def test_sql(spark, small):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({merkle.SQL})").fetchall()
    got = merkle.query(spark, "/root/testdata/sf0.001").select(names)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert 0 < sum(w[-1] for w in want) < len(want)
