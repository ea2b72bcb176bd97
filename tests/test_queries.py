"""Every media query against its SQL on DuckDB, on the smallest tables."""

import duckdb
import pytest

from lumenflow import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", plans.oracle_sql())
def test_query(spark, db, name):
    df = plans.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    found = db.execute(plans.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_diamond(spark):
    """Never better than the full search, often the same, with fewer places looked at."""
    q = plans.queries()
    full = {r.id: r for r in q["motion_full_search"](spark, DIR).collect()}
    found = q["motion_diamond"](spark, DIR).collect()
    assert len(found) == len(full) and all(r.sad >= full[r.id].sad and r.points <= 25 for r in found)
    assert sum(r.sad == full[r.id].sad for r in found) > len(full) / 2
