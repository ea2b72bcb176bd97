"""Pictures through the JPEG encoder and decoder, and bad files."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenflow.operators import jpeg
from lumenflow.sources import containers, sinks


def picture(width, height):
    """A gradient with a red rectangle."""
    y, x = np.mgrid[:height, :width]
    p = np.stack([x * 255 // max(1, width - 1), y * 255 // max(1, height - 1), (x + y) * 255 // max(1, width + height - 2)], 2).astype(np.uint8)
    p[height // 4 : height // 2, width // 4 : width // 2] = (220, 30, 40)
    return p.tobytes()


@pytest.fixture(scope="module")
def pictures(spark):
    rows = [(f"{w}x{h}", w, h, picture(w, h)) for w, h in ((64, 64), (75, 50), (40, 41), (1, 1))]
    return spark.createDataFrame(rows, "path string, width int, height int, data binary")


@pytest.mark.parametrize("quality, sub, least", [(90, 2, 30), (85, 1, 30), (75, 2, 27)])
def test_round_trip(spark, pictures, quality, sub, least):
    files = jpeg.encode(pictures, quality, sub)
    back = jpeg.decode(files)
    rows = {r.path: r for r in back.collect()}
    assert len(rows) == 4 and all(r.error is None for r in rows.values())
    assert all((r.width, r.height) == tuple(map(int, r.path.split("x"))) and len(r.data) == 3 * r.width * r.height for r in rows.values())
    assert min(r.psnr for r in jpeg.psnr(pictures, back).collect() if r.path != "1x1") > least


def test_quality_orders_sizes(pictures):
    one = pictures.filter("path = '64x64'")
    sizes = [len(jpeg.encode(one, q).first().content) for q in (30, 60, 95)]
    assert sizes == sorted(sizes)


def test_bad_files(spark, pictures):
    good = bytes(jpeg.encode(pictures.filter("path = '64x64'"), 80).first().content)
    rows = [("cut", good[: len(good) * 2 // 3]), ("empty", b""), ("text", b"hello"), ("headless", good[: good.index(b"\xff\xc0")]), ("good", good)]
    got = {r.path: r for r in jpeg.decode(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["good"].error is None and got["good"].data is not None
    assert all(got[p].error for p in ("empty", "text", "headless")) and (got["cut"].error or got["cut"].data is None)


def test_motion_jpeg(spark, pictures):
    """Frames in a container, out again, and decoded."""
    frames = jpeg.encode(pictures.filter("path = '64x64'"), 80).select(F.lit("film").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame_no"), F.col("content").alias("jpeg"))
    film = sinks.avi(frames, 64, 64, 10)
    out = containers.avi_chunks(film).select(F.concat_ws("/", "path", "frame_no").alias("path"), F.col("jpeg").alias("content"))
    back = jpeg.decode(out).collect()
    assert len(back) == 3 and all(r.error is None for r in back) and len({bytes(r.data) for r in back}) == 1


def test_counters(spark, pictures):
    """Counts of a decode come with the decode itself."""
    from pyspark.sql import Observation

    files = jpeg.encode(pictures, 80, (2, 1))
    whole = max((bytes(r.content) for r in files.collect()), key=len)
    bad = spark.createDataFrame([("x", b"no picture"), ("y", whole[: whole.rindex(b"\xff\xda") + 20] + b"\xff\xd9")], "path string, content binary")
    seen = Observation("decode")
    rows = jpeg.decode(files.unionByName(bad), seen).collect()
    n = files.count()
    assert len(rows) == n + 2 and seen.get["files"] == n + 2 and seen.get["decoded"] == n and seen.get["skipped"] == 1 and seen.get["failed"] == 1
    assert seen.get["samples"] == sum(len(r.data) for r in rows if r.error is None and r.data is not None)


def test_packed_bits(spark):
    """Pieces of any lengths from four bits on give the same bytes as the whole text."""
    import random

    r = random.Random(4)
    pieces = [(p, k, "".join(r.choice("0111") for _ in range(r.choice([4, 4, 5, 6, 7, 8, 9, 15, 16, 40])))) for p in ("a", "b") for k in range(120)] + [("c", 0, "1111")]
    rows = spark.createDataFrame(pieces, "path string, pos long, bits string")
    got = {}
    for x in sorted(jpeg.packed(rows).collect(), key=lambda x: (x.path, x.pos)):
        got[x.path] = got.get(x.path, b"") + bytes(x.bytes)
    for p in "abc":
        text = "".join(b for q, _, b in sorted(pieces) if q == p)
        text += "1" * (-len(text) % 8)
        want = b"".join(bytes([v]) + b"\0" * (v == 255) for v in (int(text[i : i + 8], 2) for i in range(0, len(text), 8)))
        assert got[p] == want


def test_tables_are_read_in_short_batches(spark, monkeypatch):
    """What a task holds of a long batch is bounded: rows come out in short batches, and none is lost."""
    heads = spark.range(1000).coalesce(1).selectExpr("cast(id as string) AS path", "array(unhex(concat('00', repeat('07', 64))), unhex(concat('01', repeat('0a', 64)))) AS quant")
    held = []
    monkeypatch.setattr(type(heads), "mapInArrow", lambda df, run, schema: held.append((df, run)))
    jpeg.quant_tables(heads)
    df, run = held[0]
    out = list(run(iter([pa.RecordBatch.from_pandas(df.toPandas())])))
    assert sum(b.num_rows for b in out) == 2000 * 64 and max(b.num_rows for b in out) <= 64 * 64
