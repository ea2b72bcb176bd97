"""CAVLC: tables are prefix codes, a known block, the inverse of random blocks, and damaged texts."""

import random

import pytest

from lumenflow.operators import cavlc

KNOWN = [0, 3, 0, 1, -1, -1, 0, 1] + [0] * 8


def test_prefix_codes():
    """No word begins another, in any table; with the word that no table uses, every code is nearly full."""
    tables = [[w for row in cavlc.token_words(c) for w in row] for c in (-1, 0, 2, 4, 8)]
    assert [len(t) for t in tables] == [14, 62, 62, 62, 62]
    for table in (cavlc.ZEROS, cavlc.CHROMA_ZEROS, cavlc.RUNS):
        tables += cavlc.words(table)
    for t in tables:
        assert len(set(t)) == len(t) and not any(a != b and b.startswith(a) for a in t for b in t)
    assert [len(r) for r in cavlc.words(cavlc.ZEROS)] == list(range(16, 1, -1))
    assert all(sum(2.0 ** -len(w) for w in r) > 0.99 for r in cavlc.words(cavlc.ZEROS)[1:])


def test_known(spark):
    row = cavlc.encode(spark.createDataFrame([(1, 0, KNOWN)], "id long, nc int, z array<int>")).first()
    assert row.text == "000010001110010111101101" and (row.total, row.ones, row.zeros) == (5, 3, 3)
    found = cavlc.decode(spark.createDataFrame([(1, 0, row.text + "0110")], "id long, nc int, text string")).first()
    assert found.z == KNOWN and found.used == 24 and found.error is None


def test_fixed_tokens():
    assert cavlc.token_words(8)[2][0] == "000100" and cavlc.token_words(9)[0] == ["000011"]


@pytest.mark.parametrize("chroma", [False, True])
def test_inverse(spark, chroma):
    r = random.Random(3)
    many = 4 if chroma else 16
    rows = [(0, 0, [0] * many), (1, 3, [1] * many), (2, 5, [-70000] * many), (3, 20, [2063, -2064] * (many // 2))]
    for i in range(4, 600):
        size, dense = r.choice([1, 2, 8, 40, 3000, 50000]), r.random()
        rows.append((i, r.randrange(17), [r.randint(-size, size) if r.random() < dense else 0 for _ in range(many)]))
    df = spark.createDataFrame(rows, "id long, nc int, z array<int>")
    found = {x.id: x for x in cavlc.decode(cavlc.encode(df, chroma=chroma), chroma=chroma).collect()}
    lengths = {x.id: len(x.text) for x in cavlc.encode(df, chroma=chroma).collect()}
    assert all(found[i].z == z and found[i].used == lengths[i] and found[i].error is None for i, _, z in rows)


def test_damaged(spark):
    texts = [(1, 0, None), (2, None, "1"), (3, 0, ""), (4, 0, "0000100011100101"), (5, 0, "0" * 40), (6, 0, "1")]
    found = {x.id: x for x in cavlc.decode(spark.createDataFrame(texts, "id long, nc int, text string")).collect()}
    assert all(found[i].z is None and found[i].error for i in (1, 2, 3, 4, 5)) and found[6].z == [0] * 16
    assert cavlc.encode(spark.createDataFrame([(1, 0, None)], "id long, nc int, z array<int>")).first().text is None
    assert cavlc.encode(spark.createDataFrame([], "id long, nc int, z array<int>")).count() == 0


def test_guard(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, KNOWN), (4, KNOWN), (7, KNOWN), (8, KNOWN), (0, [1] * 4 + [0] * 12)], "nc int, z array<int>")
    assert [r[0] for r in df.select(cavlc.encodable("z", F.col("nc"))).collect()] == [True, False, False, True, False]


def test_pattern(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 3, 1), (2, 0, 0)], "mb int, part int, n int")
    assert dict(cavlc.coded_pattern(df, ["mb"], "part", "n").collect()) == {1: 10, 2: 0}


def test_chroma_text_covers_all_levels(spark):
    """Sixteen fours and the chroma DC of every block: no level is left out."""
    from lumenflow.plans import blocks, entropy

    d = "/root/testdata/sf0.001"
    texts = entropy.chroma_text(spark, d).collect()
    levels = {r.id: r.intra for r in blocks.levels4(spark, d).select("id", "intra").collect()}
    assert len(texts) == 17 * len(levels) // 4 and {t.k for t in texts} == set(range(17))
    assert sum(t.total for t in texts if t.k < 16) == sum(v != 0 for z in levels.values() for v in z)
    assert sum(t.total for t in texts if t.k == 16) == sum(z[0] != 0 for z in levels.values())
