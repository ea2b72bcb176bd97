"""Byte ranges of any size give the same units and frames as whole files."""

import random

import pytest

from lumenflow.sources import containers, ranges, sinks


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, d = random.Random(3), tmp_path_factory.mktemp("media")
    ranges.register(spark)
    for name in "ab":
        out = b"\x09junk" if name == "a" else b""
        for _ in range(60):
            out += r.choice([b"\0\0\1", b"\0\0\0\1", b"\0\0\0\0\1"]) + bytes(r.choice([0, 0, 1, 2, 3, 7, 200]) for _ in range(r.choice([0, 1, 2, 30, 300]))).replace(b"\0\0\1", b"\0\0\3\1").replace(b"\0\0\0", b"\0\0\3\0")
        (d / "h264").mkdir(exist_ok=True)
        (d / "h264" / f"{name}.264").write_bytes(out)
    frames = spark.createDataFrame([(p, k, bytes([k % 251]) * (k * 37 % 91)) for p in ("m.avi", "n.avi") for k in range(50)], "path string, frame_no int, jpeg binary")
    (d / "avi").mkdir()
    for row in sinks.avi(frames, 192, 144, 10).collect():
        (d / "avi" / row.path).write_bytes(bytes(row.content))
    (d / "avi" / "bad.avi").write_bytes(b"RIFX")
    return d


@pytest.mark.parametrize("step", [7, 100, 1 << 20])
def test_annexb(spark, folder, step):
    whole = containers.annexb(containers.files(spark, str(folder / "h264"), "*.264")).collect()
    got = spark.read.format("annexb").option("range", step).load(str(folder / "h264")).collect()
    want = {(r.path.rsplit("/", 1)[1], r.offset, r.sc_len, r.size, r.ref_idc, r.type_id) for r in whole}
    assert {(r.path.rsplit("/", 1)[1], r.offset, r.sc_len, r.size, r.ref_idc, r.type_id) for r in got} == want and len(got) == len(want) > 60


def test_long_unit(spark, tmp_path):
    """A unit that is longer than a read and many ranges is found once."""
    (tmp_path / "x.264").write_bytes(b"\0\0\1\x67" + b"\x42" * (3 << 20) + b"\0\0\0\1\x68\xce")
    rows = spark.read.format("annexb").option("range", 500_000).load(str(tmp_path)).select("offset", "sc_len", "size").collect()
    assert sorted(map(tuple, rows)) == [(3, 3, 1 + (3 << 20)), (3 + 1 + (3 << 20) + 4, 4, 2)]


@pytest.mark.parametrize("step", [1, 7, 4096])
def test_avi(spark, folder, step):
    whole = containers.avi_chunks(containers.files(spark, str(folder / "avi"), "*.avi")).collect()
    got = spark.read.format("avi").option("entries", step).load(str(folder / "avi")).collect()
    assert {(r.path.rsplit("/", 1)[1], r.frame_no, r.offset, r.size, bytes(r.jpeg)) for r in got} == {(r.path.rsplit("/", 1)[1], r.frame_no, r.offset, r.size, bytes(r.jpeg)) for r in whole} and len(got) == 100 and all(r.key for r in got)


def test_truncated_riff(spark, folder):
    content = (folder / "avi" / "m.avi").read_bytes()
    rows = containers.riff(spark.createDataFrame([("cut", content[:400]), ("none", b"")], "path string, content binary")).collect()
    assert [r.name for r in rows][:7] == ["AVI ", "hdrl", "avih", "strl", "strh", "strf", "movi"] and rows[-1].error == "truncated" and rows[2].fields["width"] == "192"
