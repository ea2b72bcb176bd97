"""Known answers for scalar functions, byte streams, transforms, containers and streaming."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumenflow.functions import binary as B
from lumenflow.functions import dims
from lumenflow.functions import scalar as S
from lumenflow.operators import prediction as P
from lumenflow.operators import rate
from lumenflow.operators import transforms as X
from lumenflow.sources import containers, sinks
from lumenflow.streaming import frames as live


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_exp_golomb(spark):
    codes = ["1", "010", "011", "00100", "0001001"]
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select(S.ue_value(F.col("c")), S.ue_text(S.ue_value(F.col("c")))).collect()
    assert [r[0] for r in rows] == [0, 1, 2, 3, 8] and [r[1] for r in rows] == codes
    assert one(spark, *[S.from_se(F.lit(k)) for k in range(5)]) == (0, 1, -1, 2, -2)
    assert one(spark, S.ue_value(F.lit("0001"))) == (None,)


def test_magnitudes(spark):
    assert one(spark, S.from_magnitude(F.lit(2), F.lit(3)), S.from_magnitude(F.lit(5), F.lit(3)), S.from_magnitude(F.lit(0), F.lit(0))) == (-5, 5, 0)
    rows = spark.range(-300, 300).select("id", S.from_magnitude(S.magnitude_bits(F.col("id")), S.category(F.col("id")))).collect()
    assert all(a == b for a, b in rows)


def test_steps_and_tables(spark):
    row = [r[0] for r in dims.steps(spark).filter("table = 'luma' and u = 0").orderBy("v").select(S.scaled_step(F.col("step"), 72)).collect()]
    assert row == [9, 6, 6, 9, 13, 22, 29, 34]
    assert dims.huffman_codes("dc_luma")[:2] == [(0, 2, 0), (1, 3, 2)]
    assert [len(dims.HUFFMAN[t][1]) for t in dims.HUFFMAN] == [12, 12, 162, 162] and all(sum(a) == len(b) and len(set(b)) == len(b) for a, b in dims.HUFFMAN.values())
    assert dims.zigzag()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and dims.zigzag(4) == [0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15]
    assert sorted(dims.CBP_INTRA) == sorted(dims.CBP_INTER) == list(range(48))
    assert len(dims.ALPHA) == len(dims.BETA) == 52 and all(len(t) == 52 for t in P.TC0)


def test_rate_model(spark):
    assert one(spark, *[S.bits_at_qp(F.lit(10000.0), F.lit(q)) for q in (28, 34, 22)]) == (10000, 5000, 20000)
    frames = rate.series(spark, 300).withColumn("stream", F.lit(1).cast("long"))
    rows = rate.control(frames, 2000).collect()
    assert len(rows) == 300 and abs(sum(r.bits for r in rows) * 30 / 300 / 1000 - 2000) < 400


def test_bytes(spark):
    data = bytes([0, 0, 0, 0, 0, 1, 0, 0, 3, 255, 255, 0, 7, 0, 0])
    e, back, n, stuffed = one(spark, B.escape(F.lit(data)), B.unescape(B.escape(F.lit(data))), B.escaped_bytes(B.escape(F.lit(data))), B.stuff(F.lit(data)))
    assert bytes(e) == bytes([0, 0, 3, 0, 0, 3, 0, 1, 0, 0, 3, 3, 255, 255, 0, 7, 0, 0]) and bytes(back) == data and n == 3
    assert bytes(stuffed).count(b"\xff\x00") == 2 and bytes(one(spark, B.unstuff(B.stuff(F.lit(data))))[0]) == data
    assert bytes(one(spark, B.bits_to_bytes(F.lit("1011")))[0]) == b"\xbf" and bytes(one(spark, B.bits_to_bytes(F.lit("")))[0]) == b""


def test_flat_block(spark):
    rows = spark.range(1).select("id", F.array_repeat(F.lit(100.0 - 128), 64).alias("a"))
    coef = X.dct(rows, "a", ["id"])
    found = coef.first().a
    assert found[0] == pytest.approx(-224) and max(map(abs, found[1:])) < 1e-9
    assert X.idct(coef, "a", ["id"]).first().a == pytest.approx([-28.0] * 64)


def test_run_lengths(spark):
    zz = [5] + [0] * 20 + [7] + [0] * 42
    rows = spark.createDataFrame([(1, zz), (2, [0] * 64), (3, [0] * 63 + [1])], "id int, z array<int>")
    found = X.run_symbols(rows, "z", ["id"])
    out = {r.id: [(e.run, e.value) for e in r.symbols] for r in found.collect()}
    assert out[1] == [(15, 0), (4, 7), (0, 0)] and out[2] == [(0, 0)] and out[3] == [(15, 0)] * 3 + [(14, 1)]
    back = {r.id: [(e.pos, e.value) for e in r.v] for r in found.select("id", X.run_values("symbols").alias("v")).collect()}
    assert back == {1: [(21, 7)], 2: [], 3: [(63, 1)]}


def test_scan_is_not_in_a_lambda(spark):
    """What computes an array is not moved into the scan, to be computed again for each of its places."""
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sqrt(i + F.col("id"))).alias("a")).select(X.zigzag("a").alias("z"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1


def test_containers(spark):
    frames = spark.createDataFrame([("a", k, bytes([k + 1]) * n) for k, n in enumerate((6, 5, 7))], "path string, frame_no int, jpeg binary")
    content = bytes(sinks.avi(frames, 192, 144, 10).first().content)
    assert int.from_bytes(content[4:8], "little") == len(content) - 8 and content.count(b"00dc") == 6
    at = content.index(b"idx1")
    assert int.from_bytes(content[at + 4 : at + 8], "little") == 48
    files = spark.createDataFrame([("a", content), ("cut", content[: content.index(b"idx1") - 4]), ("bad", b"xx")], "path string, content binary")
    got = {(r.path, r.frame_no): bytes(r.jpeg) for r in containers.avi_chunks(files).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {0: b"\x01" * 6, 1: b"\x02" * 5, 2: b"\x03" * 7}
    assert sum(k[0] == "cut" for k in got) == 2 and not any(k[0] == "bad" for k in got)
    index = [r.index_offset for r in sinks.avi_index(frames).orderBy("frame_no").collect()]
    assert index == [4, 18, 32]


def test_annexb_edges(spark):
    stream = b"\x09" + b"\0\0\1\x67\x42\0\0\x03\0\0\1" + b"\0\0\0\1\x68\xce"
    rows = containers.annexb(spark.createDataFrame([("s", stream), ("none", b"abc")], "path string, content binary")).orderBy("idx").collect()
    assert [(r.type_id, r.offset, r.sc_len, bytes(r.rbsp), r.ep3b) for r in rows] == [(7, 4, 3, b"\x42\0\0", 1), (8, 16, 4, b"\xce", 0)]


def test_jpeg_markers(spark):
    head = sinks.jpeg_head({"luma": list(dims.LUMA_STEPS), "chroma": list(dims.CHROMA_STEPS)})
    whole = spark.range(1).select(F.lit("a").alias("path"), F.concat(F.lit(head), sinks.jpeg_frame(F.lit(16), F.lit(8)), F.lit(b"\x12\xff\x00\x34\xff\xd9")).alias("content"))
    bad = spark.createDataFrame([("short", b"\xff\xd8\xff\xdb\0\1"), ("not", b"GIF")], "path string, content binary")
    rows = containers.jpeg_markers(whole.unionByName(bad)).orderBy("path", "k").collect()
    assert [r.name for r in rows if r.path == "a"] == ["SOI", "APP0", "DQT", "DQT", "SOF0", "DHT", "DHT", "DHT", "DHT", "SOS", "scan"]
    assert bytes(rows[[r.name for r in rows].index("scan")].body) == b"\x12\xff\x00\x34"
    assert [r.error for r in rows if r.path == "short"] == [None, "bad length"] and [r.error for r in rows if r.path == "not"] == ["no SOI"]


def test_ppm(spark):
    data = bytes(range(18))
    files = spark.createDataFrame([("a", b"P6 # c\n3 2\n255\n" + data), ("b", b"P6 3 2 255\n" + data[:5]), ("c", b"P5 1 1 255\n0")], "path string, content binary")
    rows = {r.path: r for r in containers.ppm(files).collect()}
    assert bytes(rows["a"].data) == data and rows["b"].error == "truncated" and rows["c"].error == "bad header"
    px = containers.ppm_pixels(containers.ppm(files)).orderBy("y", "x").collect()
    assert [(r.r, r.g, r.b) for r in px] == [tuple(data[i : i + 3]) for i in range(0, 18, 3)]
    again = containers.ppm(sinks.ppm(containers.ppm(files).filter("error is null")))
    assert bytes(again.first().data) == data


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.bin", b"12"), ("b.bin", b"")], "path string, content binary")
    assert {r.path: r.size for r in sinks.write_files(rows, str(tmp_path)).collect()} == {"x/a.bin": 2, "b.bin": 0}
    found = containers.files(spark, str(tmp_path / "x"), "*.bin").collect()
    assert [bytes(r.content) for r in found] == [b"12"]


def test_psnr(spark):
    assert one(spark, S.psnr(F.lit(0.0)), S.psnr(F.lit(65025.0))) == (math.inf, 0.0)


def test_streaming_rate(spark, tmp_path):
    rows = [Row(stream=s, n=n, complexity=float(3000 * (s + 1) + 700 * (n * n % 11))) for s in range(3) for n in range(40)]
    table = spark.createDataFrame(rows, "stream long, n long, complexity double")
    for part in range(4):
        table.filter(F.expr(f"n div 10 = {part}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.rate_control(stream, 300).writeStream.format("memory").queryName("rated").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.stream, r.n): (r.qp, r.bits) for r in spark.table("rated").collect()}
    want = {(r.stream, r.n): (r.qp, r.bits) for r in rate.control(table, 300).collect()}
    assert got == want and len(got) == 120


def test_intra_flat(spark):
    made = P.intra4([F.lit(50)] * 8, [F.lit(50)] * 4, F.lit(50))
    assert set(one(spark, *[F.array(*p) for p in made.values()])[0]) == {50} and len(made) == 9


def test_exif(spark):
    """Long and short texts in both byte orders, and bodies that are cut."""
    from lumenflow.functions import exif

    rows = spark.createDataFrame([("a", "Canon", "x", True), ("b", "Canon", "x", False), ("c", None, "", False)], "path string, make string, model string, big boolean")
    bodies = rows.select("path", exif.written({0x0110: F.col("model"), 0x010F: F.col("make")}, F.col("big")).alias("body"))
    assert sorted((r.path, r.name, r.value) for r in exif.read(bodies).collect()) == [("a", "Make", "Canon"), ("a", "Model", "x"), ("b", "Make", "Canon"), ("b", "Model", "x"), ("c", "Model", "")]
    whole = {r.path: bytes(r.body) for r in bodies.collect()}
    assert whole["a"][6:14] == b"MM\0*\0\0\0\x08" and whole["b"][6:14] == b"II*\0\x08\0\0\0"
    cut = spark.createDataFrame([("d", whole["a"][:-3]), ("e", whole["b"][:20]), ("f", b"JFIF"), ("g", None)], "path string, body binary")
    assert {(r.path, r.error) for r in exif.read(cut).collect() if r.error} == {("d", "value beyond the body"), ("e", "truncated directory"), ("f", "no EXIF"), ("g", "no EXIF")}


def test_sessions(spark, tmp_path):
    """Runs of frames end at a pause that is longer than the gap, in a table and in a stream alike."""
    rows = [(s, minute) for s, minutes in ((1, (0, 3, 7, 20, 24)), (2, (5, 11, 30))) for minute in minutes]
    table = spark.createDataFrame(rows, "stream long, m long").select("stream", F.timestamp_seconds(F.col("m") * 60).alias("ts"))
    want = {(1, 0, 12, 3), (1, 20, 29, 2), (2, 5, 10, 1), (2, 11, 16, 1), (2, 30, 35, 1)}
    shown = lambda df: {(r.stream, r.start // 60, r.end // 60, r.n) for r in df.select("stream", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n").collect()}
    assert shown(live.sessions(table)) == want
    table.unionByName(spark.createDataFrame([(9, 600)], "stream long, m long").select("stream", F.timestamp_seconds(F.col("m") * 60).alias("ts"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.sessions(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert shown(spark.table("runs")) == want  # the last one closes when time has gone on


@pytest.mark.parametrize("name", ["h264_forward", "h264_roundtrip", "h264_dc_hadamard", "motion_half_sample", "motion_chroma_eighth", "px_box_downsample", "blk_huffman_text"])
def test_blocks_without_shuffle(spark, name):
    """What happens within a block needs no exchange and no Python."""
    from lumenflow import plans

    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_bits_are_named_once(spark):
    """Packing evaluates what makes the bits once, whatever their length, and gives what plain packing gives."""
    bits = F.concat(F.lit("1"), F.bin(F.col("id")))
    plan = spark.range(1).select(B.bits_to_bytes(bits).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bin(id") == 1 and "lambda" not in plan
    rows = spark.range(70000).select("id", B.bits_to_bytes(F.bin("id"), "0").alias("a"), B.bits_to_bytes(F.bin("id")).alias("b"), B.bits_to_bytes(F.repeat(F.bin("id"), 7)).alias("c"))
    for r in rows.filter("id % 97 = 0 or id < 300").collect():
        for got, t, pad in ((r.a, f"{r.id:b}", "0"), (r.b, f"{r.id:b}", "1"), (r.c, 7 * f"{r.id:b}", "1")):
            t += pad * (-len(t) % 8)
            assert bytes(got) == int(t, 2).to_bytes(len(t) // 8, "big")
