"""Operator 11 against a plain version, and its SQL on DuckDB."""

import re
from collections import defaultdict
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from lumenflow.llm import filter_audit

SCHEMA = "doc_id long, quality int, toxic int, part string, id long, good int"


def plain(docs, labels):
    first, good, toxic = {}, set(), set()
    for d in docs:
        if d.doc_id is not None:
            first[d.text or ""] = min(first.get(d.text or "", d.doc_id), d.doc_id)
    for r in labels:
        good |= {r.doc_id} if r.quality == 1 else set()
        toxic |= {r.doc_id} if r.toxic == 1 else set()
    parts = defaultdict(list)
    for d in docs:
        t = d.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d.doc_id is not None and d.doc_id > first[t]}
        parts[d.lang or ""].append((fails, d.doc_id is not None and d.doc_id in good, d.doc_id is not None and d.doc_id in toxic))
    out = []
    for part, rows in parts.items():
        total = defaultdict(int)
        mine = []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[0][x]]
                left = [r for r in left if not r[0][x]]
                total[x] += len(gone)
                all_fail = [r for r in rows if r[0][x]]
                mine.append((part, order, step, len(left), len(gone), len(all_fail) - len(gone), sum(sum(r[0].values()) == 1 for r in all_fail), sum(r[1] for r in gone), sum(r[2] for r in gone), x))
        out += [(*r[:-1], total[r[-1]]) for r in mine]
    return sorted(out)


def shown(df):
    return sorted(map(tuple, df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))


def test_audit(spark, small, edges, none):
    labels = spark.createDataFrame([(i, i % 2, None if i % 5 == 0 else i % 3 // 2, "x", 3, 1) for i in range(0, 200, 2)] + [(4, 1, 1, "y", 3, 1), (4, None, 0, "y", 3, 1), (None, 1, 1, "z", 1, 1)], SCHEMA)
    for docs in (small, edges, none):
        got = filter_audit.audit(filter_audit.counts(filter_audit.flagged(docs), labels))
        assert shown(got) == plain(docs.collect(), labels.collect())
    assert filter_audit.audit(filter_audit.counts(filter_audit.flagged(edges), labels.limit(0))).count() == 600 * 2


def test_colliding_blocks(spark, table):
    """Hashes that say nothing: whole texts tell equal lengths apart."""
    texts = ["abc", "abd", "abc", "xyz", "xyz", "", "", "q", "a" * 600, "a" * 599 + "b", "a" * 600, "b" * 40000, "b" * 39999 + "c", "b" * 40000]
    docs = table(texts)
    for identity in (F.xxhash64, lambda c: F.xxhash64(c).bitwiseAND(0)):
        rows = {r.id: r.mask for r in filter_audit.flagged(docs, identity=identity).collect()}
        assert {i for i, m in rows.items() if m & 16} == {2, 4, 6, 10, 13}


def test_refinement(spark, table):
    """Classes that differ in a late block only are told apart by it; the alone are dropped."""
    texts = ["a" * 5000, "a" * 4999 + "b", "a" * 4999 + "b", "a" * 5001]
    rows = table(texts).select(*filter_audit.block_hashes(F.col("text")))
    assert filter_audit.refined(rows).count() == 1


def test_sql(spark, small):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({filter_audit.SQL})").fetchall()
    got = filter_audit.query(spark, d)
    assert shown(got) == sorted(want)
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
