"""Rows out of container files: NAL units of Annex B streams, chunks of AVI files, markers of JPEG files, pictures of PPM files.

Files come from ``spark.read.format("binaryFile")`` as (path, content); every function takes any such DataFrame. Bad input gives
error columns, not failures."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.functions import binary as B
from lumenflow.functions import dims


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of files, read by Spark from any store."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def annexb(streams: DataFrame) -> DataFrame:
    """(path, idx, sc_len, offset, size, ref_idc, type_id, name, rbsp, ep3b) of every NAL unit; empty units are left out.

    A start code has three bytes, or four where a zero precedes it. What comes before the first one is skipped."""
    code = r"\x00?\x00\x00\x01"
    s = B.text(F.col("content"))
    parts = streams.select("path", F.regexp_extract_all(s, F.lit(code), F.lit(0)).alias("codes"), F.split(s, code).alias("nals"))
    rows = parts.select("path", F.length(F.col("nals")[0]).alias("lead"), F.posexplode(F.arrays_zip("codes", F.slice("nals", 2, 1 << 30).alias("nals"))).alias("k", "p"))
    rows = rows.select("path", "lead", "k", F.length("p.codes").alias("sc_len"), F.col("p.nals").alias("nal"))
    before = Window.partitionBy("path").orderBy("k")
    rows = rows.withColumn("offset", F.col("lead") + F.sum(F.col("sc_len") + F.length("nal")).over(before) - F.length("nal"))
    rows = rows.filter(F.length("nal") > 0).withColumn("idx", F.row_number().over(before) - 1)
    first, body = F.ascii(F.substring("nal", 1, 1)).bitwiseAND(255), B.raw(F.expr("substring(nal, 2)"))
    out = rows.select("path", "idx", "sc_len", "offset", F.length("nal").alias("size"), F.call_function("shiftright", first, F.lit(5)).bitwiseAND(3).alias("ref_idc"), first.bitwiseAND(31).alias("type_id"), B.unescape(body).alias("rbsp"), B.escaped_bytes(body).alias("ep3b"))
    named = dims.names(streams.sparkSession, dims.NAL_TYPES).select(F.col("code").alias("type_id"), "name")
    return out.join(F.broadcast(named), "type_id", "left").withColumn("name", F.coalesce("name", F.format_string("TYPE%d", "type_id")))


#: Rows whose Python objects a task holds at a time.
ROWS = 64


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut into short ones, which share their memory."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _walk(files_: DataFrame, step: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(path, ...) rows that a small generator finds in each file's bytes."""
    types = [f.split()[1] for f in schema.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, *r) for r in step(content or b"")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(zip(*rows, strict=True), ["string", *types], strict=True)], ["path", *[f.split()[0] for f in schema.split(", ")]])

    return files_.select("path", "content").mapInArrow(run, f"path string, {schema}")


def avi_chunks(files_: DataFrame) -> DataFrame:
    """(path, frame_no, offset, size, jpeg) of the video chunks of AVI files; a truncated last chunk ends the list."""

    def step(b: bytes) -> Iterator[tuple]:
        at, n = b.find(b"movi") + 4, 0
        while at >= 12 and at + 8 <= len(b) and b[at : at + 4] != b"idx1":
            (size,) = struct.unpack_from("<I", b, at + 4)
            if b[at : at + 4] in (b"00dc", b"00db"):
                if at + 8 + size > len(b):
                    return
                yield n, at + 8, size, b[at + 8 : at + 8 + size]
                n += 1
            at += 8 + size + size % 2

    return _walk(files_, step, "frame_no int, offset long, size long, jpeg binary")


#: Fields of the heads of an AVI file, each four bytes long unless it says so.
HEADS = {
    b"avih": ("micros", "rate", "padding", "flags", "frames", "first", "streams", "buffer", "width", "height"),
    b"strh": ("type:t", "handler:t", "flags", "priority:h", "language:h", "first", "scale", "rate", "start", "length", "buffer", "quality", "sample"),
    b"strf": ("head", "width", "height", "planes:h", "bits:h", "compression:t", "image"),
}


def riff(files_: DataFrame) -> DataFrame:
    """(path, k, parent, name, offset, length, fields, error): the parts of AVI files in order, lists by their type. ``parent`` is the list
    that a part is in, ``offset`` where its head begins, ``length`` what the head states; ``fields`` are those of avih, strh and strf. A part
    that ends beyond its file has the error ``truncated``, and ends the list."""

    def fields(name: bytes, body: bytes) -> dict[str, str]:
        out, at = {}, 0
        for f in HEADS.get(name, ()):
            f, _, kind = f.partition(":")
            size = 2 if kind == "h" else 4
            raw = body[at : at + size]
            if len(raw) == size:
                out[f] = raw.decode("latin-1") if kind == "t" else str(int.from_bytes(raw, "little"))
            at += size
        return out

    def step(b: bytes) -> Iterator[tuple]:
        k, ends = 0, [(len(b), None)]
        at = 0
        while at + 8 <= len(b):
            while len(ends) > 1 and at >= ends[-1][0]:
                ends.pop()
            name, (size,) = b[at : at + 4], struct.unpack_from("<I", b, at + 4)
            nested = name in (b"RIFF", b"LIST")
            shown = (b[at + 8 : at + 12] if nested else name).decode("latin-1")
            short = at + 8 + size > len(b)
            yield k, ends[-1][1], shown, at, size, list(fields(name, b[at + 8 : at + 8 + size]).items()), "truncated" if short else None
            k += 1
            if short and not nested:
                return
            if nested:
                ends.append((at + 8 + size, shown))
                at += 12
            else:
                at += 8 + size + size % 2

    return _walk(files_, step, "k int, parent string, name string, offset long, length long, fields map<string,string>, error string")


def jpeg_markers(files_: DataFrame) -> DataFrame:
    """(path, k, offset, code, length, body, error, name) of the markers of JPEG files up to the scan; its body is the coded data."""

    def step(b: bytes) -> Iterator[tuple]:
        at, k = 0, 0
        if b[:2] != b"\xff\xd8":
            yield 0, 0, None, None, None, "no SOI"
            return
        while at + 1 < len(b):
            if b[at] != 0xFF:
                yield k, at, None, None, None, "no marker"
                return
            while at + 2 < len(b) and b[at + 1] == 0xFF:  # fill bytes
                at += 1
            code = b[at + 1]
            if code in (0xD8, 0xD9, 0x01) or 0xD0 <= code <= 0xD7:
                yield k, at, code, 0, b"", None
                at, k = at + 2, k + 1
                continue
            size = int.from_bytes(b[at + 2 : at + 4], "big")
            if size < 2 or at + 2 + size > len(b):
                yield k, at, code, size, None, "bad length"
                return
            yield k, at, code, size, b[at + 4 : at + 2 + size], None
            at, k = at + 2 + size, k + 1
            if code == 0xDA:
                end = at
                while end + 1 < len(b) and (b[end] != 0xFF or b[end + 1] == 0 or 0xD0 <= b[end + 1] <= 0xD7):
                    end += 1
                yield k, at, -1, end - at, b[at:end], None
                return

    out = _walk(files_, step, "k int, offset long, code int, length int, body binary, error string")
    named = dims.names(files_.sparkSession, dims.MARKERS)
    return out.join(F.broadcast(named), "code", "left").withColumn("name", F.when(F.col("code") == -1, "scan").otherwise(F.coalesce("name", F.format_string("0x%02X", "code"))))


def ppm(files_: DataFrame) -> DataFrame:
    """(path, width, height, data, error) of binary PPM pictures with 8 bits a sample; comments in the header are skipped."""
    s = B.text(F.col("content"))
    gap = r"(?:\s|#[^\n]*\n)+"
    head = rf"^P6{gap}(\d+){gap}(\d+){gap}255\s"
    part = lambda i: F.regexp_extract(s, head, i)
    start = F.length(part(0))
    rows = files_.select("path", "content", start.alias("start"), part(1).try_cast("int").alias("width"), part(2).try_cast("int").alias("height"))
    size = F.col("width") * F.col("height") * 3
    good = (F.col("start") > 0) & (F.octet_length("content") - F.col("start") >= size)
    return rows.select("path", "width", "height", F.when(good, F.call_function("substring", F.col("content"), F.col("start") + 1, size)).alias("data"), F.when(~good, F.when(F.col("start") > 0, "truncated").otherwise("bad header")).alias("error"))


def ppm_pixels(pictures: DataFrame) -> DataFrame:
    """(path, y, x, r, g, b) of pictures from :func:`ppm`."""
    rows = pictures.filter("error is null").select("path", "width", "data", F.posexplode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i", "_"))
    sample = lambda k: F.conv(F.hex(F.call_function("substring", F.col("data"), 3 * F.col("i") + k + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select("path", F.expr("i div width").alias("y"), F.expr("i % width").alias("x"), sample(0).alias("r"), sample(1).alias("g"), sample(2).alias("b"))


def yuv420(files_: DataFrame, width: int, height: int) -> DataFrame:
    """(path, y, cb, cr): the planes of the first frame of raw files."""
    n, c = width * height, ((width + 1) // 2) * ((height + 1) // 2)
    return files_.select("path", *[F.call_function("substring", F.col("content"), F.lit(at + 1), F.lit(size)).alias(name) for name, at, size in (("y", 0, n), ("cb", n, c), ("cr", n + c, c))])
