"""EXIF bodies (APP1) as columns: a directory of text tags whose long values lie behind it, found by their offsets, in both byte orders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.functions import binary as B

# Numbers of the tags that are named.
TAGS = {0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime"}
HEAD = b"Exif\0\0"


def _number(v: Column, size: int, big: Column) -> Column:
    """A number in two or four bytes, the highest or the lowest first."""
    parts = [B.byte(F.call_function("shiftright", v.cast("long"), F.lit(8 * k)).bitwiseAND(255)) for k in range(size)]
    return F.when(big, F.concat(*parts[::-1])).otherwise(F.concat(*parts))


def written(tags: dict[int, Column], big: Column) -> Column:
    """The body of an EXIF segment with text tags; a null text has no tag. Offsets count from the byte order mark."""
    rows = sorted(tags.items())
    there = [F.when(v.isNotNull(), 1).otherwise(0) for _, v in rows]
    count = sum(there[1:], there[0])
    raw = [F.concat(F.encode(F.coalesce(v, F.lit("")), "UTF-8"), F.lit(b"\0")) for _, v in rows]
    behind = [F.when((t == 1) & (F.octet_length(b) > 4), F.octet_length(b)).otherwise(0) for t, b in zip(there, raw, strict=True)]
    first, entries, values = 8 + 2 + 12 * count + 4, [], []
    for k, ((tag, _), t, b) in enumerate(zip(rows, there, raw, strict=True)):
        at = first + sum(behind[1:k], behind[0]) if k else first
        inline = F.rpad(b, F.lit(4), F.lit(b"\0"))
        entry = F.concat(_number(F.lit(tag), 2, big), _number(F.lit(2), 2, big), _number(F.octet_length(b), 4, big), F.when(F.octet_length(b) > 4, _number(at, 4, big)).otherwise(inline))
        entries.append(F.when(t == 1, entry).otherwise(F.lit(b"")))
        values.append(F.when(behind[k] > 0, b).otherwise(F.lit(b"")))
    mark = F.when(big, F.lit(b"MM")).otherwise(F.lit(b"II"))
    return F.concat(F.lit(HEAD), mark, _number(F.lit(42), 2, big), _number(F.lit(8), 4, big), _number(count, 2, big), *entries, _number(F.lit(0), 4, big), *values)


def read(bodies: DataFrame) -> DataFrame:
    """(path, tag, name, value, error) of the text tags of EXIF bodies (path, body). What points beyond the body, and a body that is no EXIF,
    is an error; tags of other types are listed without a value."""

    def tags(b: bytes) -> Iterator[tuple[int | None, str | None, str | None]]:
        order = {b"II": "little", b"MM": "big"}.get(b[6:8])
        if b[:6] != HEAD or order is None:
            yield None, None, "no EXIF"
            return
        b = b[6:]
        number = lambda at, n: int.from_bytes(b[at : at + n], order)
        at = number(4, 4)
        for k in range(number(at, 2) if at + 2 <= len(b) else 0):
            e = at + 2 + 12 * k
            if e + 12 > len(b):
                yield None, None, "truncated directory"
                return
            tag, kind, n = number(e, 2), number(e + 2, 2), number(e + 4, 4)
            start = number(e + 8, 4) if n > 4 else e + 8
            if kind != 2:
                yield tag, None, None
            elif start + n > len(b):
                yield tag, None, "value beyond the body"
            else:
                yield tag, b[start : start + n].rstrip(b"\0").decode("utf-8", "replace"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *t) for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in tags(b or b"")]
            if rows:
                p, tag, value, error = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(tag, pa.int32()), pa.array([TAGS.get(t) for t in tag], pa.string()), pa.array(value, pa.string()), pa.array(error, pa.string())], ["path", "tag", "name", "value", "error"])

    return bodies.select(F.col("path").cast("string").alias("path"), "body").mapInArrow(run, "path string, tag int, name string, value string, error string")
