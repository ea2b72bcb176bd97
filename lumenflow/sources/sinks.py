"""Containers out of rows: Annex B streams, AVI files, JPEG segments, PPM pictures, and files of bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.functions import binary as B
from lumenflow.functions import dims

START = bytes([0, 0, 0, 1])


def _joined(parts: Column) -> Column:
    """Bytes of an array of (order, bytes) in order."""
    return F.unhex(F.array_join(F.transform(F.array_sort(parts), lambda p: F.hex(p["b"])), ""))


def annexb(nals: DataFrame) -> DataFrame:
    """(path, content) of NAL units (path, idx, ref_idc, type_id, rbsp), escaped, with four-byte start codes. A stream is one row."""
    nal = F.concat(F.lit(START), B.byte(B.nal_header(F.col("ref_idc"), F.col("type_id"))), B.escape(F.col("rbsp")))
    return nals.groupBy("path").agg(_joined(F.collect_list(F.struct("idx", nal.alias("b")))).alias("content"))


def avi_index(frames: DataFrame) -> DataFrame:
    """Frames (path, frame_no, jpeg) with ``index_offset``, where the index places each chunk; odd chunks are padded."""
    w = Window.partitionBy("path").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    n = F.octet_length("jpeg")
    return frames.withColumn("index_offset", 4 + F.coalesce(F.sum(8 + n + n % 2).over(w), F.lit(0)))


def avi(frames: DataFrame, width: int, height: int, fps: int) -> DataFrame:
    """(path, content): Motion-JPEG files of frames (path, frame_no, jpeg), every frame a key frame. A file is one row."""
    n = F.octet_length("jpeg")
    chunk = F.concat(F.lit(b"00dc"), B.le32(n), F.col("jpeg"), F.when(n % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b"")))
    entry = F.concat(F.lit(b"00dc"), B.le32(F.lit(16)), B.le32(F.col("index_offset")), B.le32(n))
    each = avi_index(frames).select("path", "frame_no", chunk.alias("chunk"), entry.alias("entry"), n.alias("n"))
    whole = each.groupBy("path").agg(_joined(F.collect_list(F.struct("frame_no", F.col("chunk").alias("b")))).alias("movi"), _joined(F.collect_list(F.struct("frame_no", F.col("entry").alias("b")))).alias("idx"), F.max("n").alias("most"), F.count(F.lit(1)).alias("n"))
    u = lambda *v: F.concat(*[B.le32(F.lit(x) if isinstance(x, int) else x) for x in v])
    part = lambda tag, size, *body: F.concat(F.lit(tag), B.le32(F.lit(size) if isinstance(size, int) else size), *body)
    avih = part(b"avih", 56, u(1_000_000 // fps, 0, 0, 16, F.col("n"), 0, 1, F.col("most"), width, height, 0, 0, 0, 0))
    strh = part(b"strh", 56, F.lit(b"vidsMJPG"), u(0, 0, 0, 1, fps, 0, F.col("n"), F.col("most")), u(0xFFFFFFFF, 0), u(0, width + 65536 * height))
    strf = part(b"strf", 40, u(40, width, height, 1 + 65536 * 24), F.lit(b"MJPG"), u(width * height * 3, 0, 0, 0, 0))
    hdrl = part(b"LIST", 192, F.lit(b"hdrl"), avih, part(b"LIST", 116, F.lit(b"strl"), strh, strf))
    m, i = F.octet_length("movi"), F.octet_length("idx")
    movi, idx = part(b"LIST", 4 + m, F.lit(b"movi"), F.col("movi")), part(b"idx1", i, F.col("idx"))
    return whole.select("path", part(b"RIFF", 4 + 200 + 12 + m + 8 + i, F.lit(b"AVI "), hdrl, movi, idx).alias("content"))


def _segment(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def jpeg_head(steps: dict[str, list[int]]) -> bytes:
    """SOI, APP0 and the quantisation tables (row by row) of a JPEG file."""
    tables = b"".join(_segment(0xDB, bytes([k]) + bytes(steps[t][i] for i in dims.zigzag())) for k, t in enumerate(("luma", "chroma")))
    return b"\xff\xd8" + _segment(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0])) + tables


def jpeg_tables() -> bytes:
    """The four standard Huffman tables as segments."""
    return b"".join(_segment(0xC4, bytes([c << 4 | k]) + bytes(dims.HUFFMAN[t][0]) + dims.HUFFMAN[t][1]) for c, k, t in ((0, 0, "dc_luma"), (1, 0, "ac_luma"), (0, 1, "dc_chroma"), (1, 1, "ac_chroma")))


def jpeg_frame(width: Column, height: Column, sub: tuple[int, int] = (1, 1)) -> Column:
    """Frame header of three components, chroma with one sample for so many of luma across and down, the Huffman tables, and the scan
    header."""
    parts = b"".join(bytes([i, sub[0] << 4 | sub[1] if i == 1 else 0x11, 0 if i == 1 else 1]) for i in (1, 2, 3))
    scan = _segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))
    return F.concat(F.lit(bytes([0xFF, 0xC0, 0, 17, 8])), B.be16(height), B.be16(width), F.lit(bytes([3]) + parts + jpeg_tables() + scan))


def ppm(pictures: DataFrame) -> DataFrame:
    """(path, content) of pictures (path, width, height, data)."""
    return pictures.select("path", F.concat(F.encode(F.concat(F.lit("P6\n"), F.col("width"), F.lit(" "), F.col("height"), F.lit("\n255\n")), "ISO-8859-1"), "data").alias("content"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each row (path, content) to a file of that name below ``folder``, which every executor must share, and returns
    (path, size). A file appears under its name only when it is whole, so that a task that runs twice does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f.name, path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "size"])

    return rows.select("path", "content").mapInArrow(run, "path string, size long")
