"""Measurement files, and the predictors and planes that no driver table exercises."""

import numpy as np
from pyspark.sql import functions as F

from lumenflow.operators import prediction as P
from lumenflow.operators import transforms as X
from lumenflow.sources import reports as R


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    k = write(tmp_path, "k.csv", "pts_time\n2.0,\n0.5\n")
    assert [r.pts_time for r in R.keyframes(spark, k).collect()] == [0.5, 2.0]
    f = write(tmp_path, "f.csv", "size,type\n120,I,\n30,P\nN/A\n")
    assert sorted(map(tuple, R.frame_sizes(spark, f).collect())) == [(30, "P"), (120, "I")]
    p = write(tmp_path, "p.csv", "100,K__\n20,___\n")
    assert sorted(map(tuple, R.packets(spark, p).collect())) == [(20, "P"), (100, "I")]


def test_text_tables(spark, tmp_path):
    t = write(tmp_path, "t.txt", "# frame psnr\n0 31.5\n1  inf\n\n")
    assert [tuple(r) for r in R.table(spark, t, "frame int, psnr double").orderBy("frame").collect()] == [(0, 31.5), (1, float("inf"))]
    d = write(tmp_path, "d.txt", "# dump\n0 SPS 7 3 4 0 10 9 0\n1 IDR slice (I) 5 3 3 14 99 98 1\n# total 2\n")
    assert [(r.idx, r.name, r.type_id, r.ep3b) for r in R.nal_dump(spark, d).orderBy("idx").collect()] == [(0, "SPS", 7, 0), (1, "IDR slice (I)", 5, 1)]
    b = write(tmp_path, "b.txt", "frames: 3\nper-frame bytes: 10 20 30\n")
    assert [r.value for r in R.numbers_behind(spark, b, "per-frame bytes").orderBy("at").collect()] == [10, 20, 30]
    assert {r.key: r.value for r in R.key_values(spark, write(tmp_path, "s.txt", "width: 64\nfps 25\n# no\n")).collect()} == {"width": "64", "fps": "25"}


def test_json_and_lines(spark, tmp_path):
    j = write(tmp_path, "j.json", '{"a": 1,\n "b": [1, 2]}')
    row = R.json_document(spark, j, "a int, b array<int>")
    assert tuple(row.first()) == (1, [1, 2])
    assert {tuple(r) for r in R.unpivoted(row.select("a", F.size("b").alias("n"))).collect()} == {("a", "1"), ("n", "2")}
    assert spark.range(1).select(R.basename(F.lit("x/y/z.tar.gz"))).first()[0] == "z.tar" and spark.range(1).select(R.basename(F.lit("plain"))).first()[0] == "plain"


def test_large_predictors(spark):
    """A linear ramp around a block is continued by the plane mode."""
    for made, size in ((P.intra16, 16), (P.chroma8, 8)):
        modes = made([F.lit(40 + 3 * (x + 1)) for x in range(size)], [F.lit(40 + 2 * (y + 1)) for y in range(size)], F.lit(40))
        row = spark.range(1).select(*[F.array(*modes[m]) for m in range(4)]).first()
        got = [np.array(r).reshape(size, size) for r in row]
        want = np.array([[40 + 3 * (x + 1) + 2 * (y + 1) for x in range(size)] for y in range(size)])
        assert np.abs(got[3] - want).max() <= 1
        assert any(len(np.unique(g, axis=0)) == 1 for g in got[:3]) and any(len(np.unique(g, axis=1).T) == 1 for g in got[:3])


def test_i420(spark):
    px = spark.range(9).selectExpr("'p' as path", "int(id div 3) as y", "int(id % 3) as x", "200 as r", "100 as g", "50 as b")
    content = bytes(P.i420(px).first().content)
    assert content == bytes([(77 * 200 + 150 * 100 + 29 * 50) >> 8] * 9 + [((-43 * 200 - 84 * 100 + 127 * 50) >> 8) + 128] * 4 + [((127 * 200 - 106 * 100 - 21 * 50) >> 8) + 128] * 4)


def test_small_cosine(spark):
    """The 4x4 cosine basis is orthonormal."""
    b = np.array(X._cosines(4))
    assert np.allclose(b @ b.T, np.eye(4))
