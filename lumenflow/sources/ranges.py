"""Containers read by byte ranges: a large file spreads over the cluster, and no file becomes a row.

``spark.read.format("annexb")`` and ``spark.read.format("avi")`` after :func:`register`. Files are opened by pyarrow, on the executors
too: the path is one that all machines reach (a mounted folder, hdfs, s3).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range unless the option ``range`` says otherwise, and of one read.
RANGE, READ = 64 << 20, 1 << 20


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _listed(path: str) -> list[tuple[str, int]]:
    """The files of a folder, or the file itself, in order of their names."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(name)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    more: tuple = ()


def units(f, size: int, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length of the start code, unit) of the NAL units whose start code 00 00 01 begins in [start, end).

    Reading goes on beyond ``end`` until the last of them is whole. A zero byte before a start code belongs to it; empty units are skipped."""
    code = b"\0\0\1"
    at = max(0, start - 1)  # a zero before the first start code makes it longer
    f.seek(at)
    data, read, found = bytearray(), at, None

    def more() -> bool:
        nonlocal read
        chunk = f.read(min(READ, size - read)) if read < size else b""
        data.extend(chunk)
        read += len(chunk)
        return bool(chunk)

    look = start - at
    while True:
        k = data.find(code, look)
        if k < 0:
            look = max(look, len(data) - 2)
            if found is not None or at + look < end:
                if more():
                    continue
            k = len(data)
            if found is not None:
                yield from _unit(data, at, found, k)
            return
        if found is not None:
            yield from _unit(data, at, found, k)
        if at + k >= end:
            return
        found = k
        look = k + 3
        if k > READ:  # what is done goes
            drop = k - 1
            del data[:drop]
            at, found, look = at + drop, found - drop, look - drop


def _unit(data: bytearray, at: int, code: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    if end < len(data) and end > code + 3 and data[end - 1] == 0:  # the zero belongs to the start code that follows
        end -= 1
    body = bytes(data[code + 3 : end])
    if body:
        yield at + code + 3, 4 if code and data[code - 1] == 0 else 3, body


class AnnexB(DataSource):
    """(path, offset, sc_len, size, ref_idc, type_id, nal) of the NAL units of byte streams; ``nal`` has its header byte and its escapes."""

    @classmethod
    def name(cls) -> str:
        return "annexb"

    def schema(self) -> str:
        return "path string, offset long, sc_len int, size long, ref_idc int, type_id int, nal binary"

    def reader(self, schema) -> DataSourceReader:
        return _AnnexBReader(self.options)


class _AnnexBReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        return [Range(p, a, min(a + self.step, n), (n,)) for p, n in _listed(self.path) for a in range(0, n, self.step)]

    def read(self, part: Range) -> Iterator[tuple]:
        with _open(part.path) as f:
            for offset, code, nal in units(f, part.more[0], part.start, part.end):
                yield part.path, offset, code, len(nal), nal[0] >> 5 & 3, nal[0] & 31, nal


def top_chunks(f, size: int) -> dict[bytes, tuple[int, int]]:
    """Offset and size of the bodies of an AVI file's parts, by name or list type: only their heads are read."""
    f.seek(0)
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"AVI ":
        return {}
    at, out = 12, {}
    while at + 8 <= size:
        f.seek(at)
        b = f.read(12)
        (n,) = struct.unpack_from("<I", b, 4)
        out.setdefault(b[8:12] if b[:4] == b"LIST" else b[:4], (at + 8, min(n, size - at - 8)))
        at += 8 + n + n % 2
    return out


class Avi(DataSource):
    """(path, frame_no, offset, size, key, jpeg) of the video chunks that an AVI file's index lists; a range is a part of the index."""

    @classmethod
    def name(cls) -> str:
        return "avi"

    def schema(self) -> str:
        return "path string, frame_no long, offset long, size long, key boolean, jpeg binary"

    def reader(self, schema) -> DataSourceReader:
        return _AviReader(self.options)


class _AviReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("entries", 4096))

    def partitions(self) -> list[Range]:
        out = []
        for path, size in _listed(self.path):
            with _open(path) as f:
                parts = top_chunks(f, size)
            if b"movi" in parts and b"idx1" in parts:
                at, n = parts[b"idx1"]
                out += [Range(path, a, min(a + self.step, n // 16), (parts[b"movi"][0], at, size)) for a in range(0, n // 16, self.step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        movi, index, size = part.more
        with _open(part.path) as f:
            f.seek(index + 16 * part.start)
            entries = f.read(16 * (part.end - part.start))
            for k in range(part.end - part.start):
                name, flags, offset, n = struct.unpack_from("<4sIII", entries, 16 * k)
                at = movi + offset + 8  # offsets count from the list type
                if name in (b"00dc", b"00db") and at + n <= size:
                    f.seek(at)
                    yield part.path, part.start + k, at, n, bool(flags & 16), f.read(n)


def register(spark: SparkSession) -> None:
    """Makes the formats ``annexb`` and ``avi`` known to a session."""
    for source in (AnnexB, Avi):
        spark.dataSource.register(source)
