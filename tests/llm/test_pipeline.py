"""The corpus pipeline against plain versions of its stages, and its registry."""

import hashlib
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lumenflow.llm import bpe, language_id, mixing, registry
from lumenflow.llm.common import BATCH_ROWS
from tests.llm.test_dedup import plain_components, plain_groups

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "byte_bpe" or docs.columns == columns
        steps[name] = docs.collect()
    first = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    assert Counter(steps["language"]) == Counter(first)
    kept = {r[0] for r in plain_groups(steps["language"]) if r[3]}
    assert sorted(r.doc_id for r in steps["exact_dedup"]) == sorted(kept)
    stay = {i for i, _, c in plain_components(steps["exact_dedup"]) if i == c}
    assert sorted(r.doc_id for r in steps["near_dedup"]) == sorted(stay)
    assert Counter(steps["mixing"]) == Counter(steps["near_dedup"])
    c = bpe.codec()
    want = {(r.doc_id, hashlib.sha256(c.encode(r.text)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in steps["mixing"]}
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in steps["byte_bpe"]} == want


def test_edges(spark, edges, none):
    for docs in (edges, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema if name != "byte_bpe" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def test_texts_come_in_small_batches(spark, table, monkeypatch, tmp_path):
    """Whoever writes what a stage returns, its Python tasks hold few texts at a time."""
    most = BATCH_ROWS
    real = language_id.utf8

    def utf8(column):
        if len(column) > most:
            raise ValueError(f"{len(column)} texts at once")
        return real(column)

    class Watched:
        def __init__(self):
            plain = bpe.codec()  # in a worker, which has the module as it is
            self.plain, self.decode, self.forget = plain, plain.decode, plain.forget

        def encode(self, text):
            if (n := sys._getframe(1).f_locals["batch"].num_rows) > most:
                raise ValueError(f"{n} texts at once")
            return self.plain.encode(text)

    docs = table([f"the house by the sea {k}" for k in range(2500)]).coalesce(1)
    model = language_id.fit(docs)  # of a bounded number of texts
    monkeypatch.setattr(language_id, "fit", lambda docs: model)
    monkeypatch.setattr(language_id, "utf8", utf8)
    monkeypatch.setattr(bpe, "codec", lambda path=None: Watched())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    for name, stage in corpus_pipeline.STAGES:
        if name in ("language", "byte_bpe"):
            stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
            assert spark.read.parquet(str(tmp_path / name)).count() == 2500


def test_names():
    names = registry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(names) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]


@pytest.mark.parametrize("name", ["op9_mixing", "op10_exact_dedup"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_mix_takes_effect(spark, table, tmp_path):
    """The last stage tells the place in the mix; at any place each source has its share, less than two blocks off."""
    docs, orders = table([f"text {i}" for i in range(700)]), []
    source = {r.doc_id: r.source for r in docs.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for k, weights in enumerate(({"s0": 0.7, "s1": 0.2, "s2": 0.1}, {"s0": 0.1, "s1": 0.2, "s2": 0.7})):
            path = str(tmp_path / f"{k}")
            mixing.mixed(docs, slots_per_run=4, weights=weights, block_rows=4, units=50).write.parquet(path)
            assert len(list((tmp_path / f"{k}").glob("part-*"))) > 1
            rows = sorted(corpus_pipeline.tokens(spark, spark.read.parquet(path), DIR).collect(), key=lambda r: r.place)
            assert [r.place for r in rows] == list(range(700))
            orders.append([source[r.doc_id] for r in rows])
            seen, total = Counter(), Counter(orders[-1])
            for n, s in enumerate(orders[-1], 1):
                seen[s] += 1
                assert all(abs(seen[x] - n * w) < 2 * 4 for x, w in weights.items())
                if seen[s] > total[s] - 4:
                    break
            assert n > 250
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert orders[0] != orders[1]


def test_run(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert rows and sorted(r.place for r in rows) == list(range(len(rows)))
    kept = spark.read.parquet(f"{DIR}/documents.parquet").filter(F.col("doc_id").isin([r.doc_id for r in rows]))
    plan = sorted(mixing.schedule(kept).collect(), key=lambda r: (r.slot, r.block_pos))
    assert [r.row.doc_id for r in plan] == [r.doc_id for r in sorted(rows, key=lambda r: r.place)]


def test_unlabelled_corpus(spark, table):
    """Where no language is known, the language stage keeps every document with letters."""
    docs = table(["a clean text", "123 456", None, "another one"]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, DIR).collect()) == [0, 3]
