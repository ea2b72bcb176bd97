"""Media queries over whole tables, beyond the rows that their SQL covers."""

import duckdb
import pytest

from pyspark.sql import functions as F

from lumenflow import plans
from lumenflow.operators import rate
from lumenflow.plans import blocks
from lumenflow.streaming import frames as live

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, table, cut", [("h264_parameter_sets", "part", " WHERE p_partkey <= 300"), ("h264_slice_headers", "part", " WHERE p_partkey <= 300"), ("px_region", "embeddings", " WHERE id < 50")])
def test_every_id(spark, name, table, cut):
    """The SQL of a query holds for all ids when the id filter is left out of it."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    found = con.execute(plans.oracle_sql()[name].replace(cut, ""))
    names = [c[0] for c in found.description]
    want = sorted(str(tuple(x)) for x in found.fetchall())
    df = plans.queries()[name](spark, DIR)
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == want


def test_long_stream(spark):
    """One long stream is a fold of constant memory: no array of frames, and the level goes from batch to batch."""
    n, per_frame, size = 25000, 20000.0, 1200000.0
    frames = spark.range(n).select(F.lit(7).cast("long").alias("stream"), F.col("id").alias("n"), (1000.0 + F.col("id") * 7919 % 90000).alias("complexity"))
    df = rate.control(frames, 600)
    assert "collect_list" not in df._jdf.queryExecution().toString()
    rows, fullness = sorted(df.collect(), key=lambda r: r.n), size / 2
    assert len(rows) == n
    for r in rows:
        bits = live.base_bits(1000.0 + r.n * 7919 % 90000, r.qp)
        fullness = max(0.0, min(size, fullness + bits - per_frame))
        assert (r.bits, r.fullness) == (bits, fullness)


def test_ranges_of_blocks(spark, monkeypatch):
    """Ranges of a few ids give the same differences as one window over each component."""
    monkeypatch.setattr(blocks, "RANGE", 12)
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    names = ["component", "id", "segment", "whole", "diff", "again"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({blocks.DPCM})").fetchall()
    got = plans.queries()["blk_dc_dpcm"](spark, "/root/testdata/sf0.001").select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_wrong_inverse_scan_shows(spark, monkeypatch):
    """``same`` holds the inverse scan against the coefficients themselves."""
    assert all(r.same for r in plans.queries()["blk_zigzag"](spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(blocks.X, "unzigzag", lambda z: F.reverse(z))
    assert not all(r.same for r in plans.queries()["blk_zigzag"](spark, "/root/testdata/sf0.001").collect())
