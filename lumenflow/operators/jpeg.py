"""JPEG pictures as Spark jobs: a row for every 8x8 block, between pictures and files.

Encoding: picture -> blocks -> cosine transform and quantisation -> differences of DC, runs of AC, codes -> bits -> file. Decoding:
markers -> tables and restart segments -> coefficients -> samples -> picture. Restart segments decode on their own, so they spread
over the cluster. Numbers go through numpy in batches of blocks; what joins, orders and groups is Spark's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lumenflow.functions import binary as B
from lumenflow.functions import dims
from lumenflow.sources import containers, sinks

ZIGZAG = np.array(dims.zigzag())
BASIS = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * math.sqrt((1 if u == 0 else 2) / 8) for x in range(8)] for u in range(8)])
BLOCKS = "path string, comp int, pos long, z array<int>"


def scaled_steps(quality: int) -> dict[str, list[int]]:
    """Quantisation tables at a quality, row by row."""
    q = max(1, min(100, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return {name: [max(1, min(255, (s * scale + 50) // 100)) for s in table] for name, table in (("luma", dims.LUMA_STEPS), ("chroma", dims.CHROMA_STEPS))}


def _round(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def sampling(sub: int | tuple[int, int]) -> tuple[int, int]:
    """Luma samples for one of chroma, across and down: (1, 1) is 4:4:4, (2, 1) 4:2:2 and (2, 2) 4:2:0."""
    return (sub, sub) if isinstance(sub, int) else sub


def _planes(data: bytes, width: int, height: int, h: int, v: int) -> list[np.ndarray]:
    """Y, Cb and Cr of a picture, padded to whole coding units by its border; chroma averaged over h by v samples."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, 3).astype(float)
    m = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
    ycc = np.clip(_round(np.round(px @ m.T + [0, 128, 128], 6)), 0, 255).astype(np.int64)
    out = [np.pad(ycc[:, :, 0], ((0, -height % (8 * v)), (0, -width % (8 * h))), "edge")]
    for k in (1, 2):
        p = ycc[:, :, k]
        s, n = (np.add.reduceat(np.add.reduceat(a, np.arange(0, height, v), 0), np.arange(0, width, h), 1) for a in (p, np.ones_like(p)))
        p = (s + n // 2) // n
        out.append(np.pad(p, ((0, out[0].shape[0] // v - p.shape[0]), (0, out[0].shape[1] // h - p.shape[1])), "edge"))
    return out


def blocks(pictures: DataFrame, sub: int | tuple[int, int] = 2) -> DataFrame:
    """(path, comp, pos, z): samples of the blocks of pictures (path, width, height, data), row by row; pos orders a picture's blocks
    in the interleaved scan."""
    h, v = sampling(sub)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in containers.slices(batches):
            for path, width, height, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                planes = _planes(data, width, height, h, v)
                wide, per = planes[0].shape[1] // (8 * h), h * v + 2
                for comp, p in enumerate(planes):
                    ch, cv = (h, v) if comp == 0 else (1, 1)
                    by, bx = p.shape[0] // 8, p.shape[1] // 8
                    y, x = np.divmod(np.arange(by * bx), bx)
                    pos = (y // cv * wide + x // ch) * per + (y % v * h + x % h if comp == 0 else h * v + comp - 1)
                    z = p.reshape(by, 8, bx, 8).swapaxes(1, 2).reshape(-1, 64).astype(np.int32)
                    yield _batch([path] * len(pos), np.full(len(pos), comp), pos, z)

    return pictures.select("path", "width", "height", "data").mapInArrow(run, BLOCKS)


def _batch(path, comp: np.ndarray, pos: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * 64, pa.int32()), pa.array(z.reshape(-1).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()) if isinstance(path, list) else path, pa.array(comp.astype(np.int32)), pa.array(pos.astype(np.int64)), lists], ["path", "comp", "pos", "z"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)


def transform(rows: DataFrame, quality: int) -> DataFrame:
    """Samples to quantised coefficients in zigzag order."""
    s = scaled_steps(quality)
    steps = np.array([s["luma"], s["chroma"], s["chroma"]], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in containers.slices(batches, 1024):
            if batch.num_rows:
                comp = batch.column(1).to_numpy()
                c = BASIS @ (_matrix(batch.column(3)).reshape(-1, 8, 8) - 128.0) @ BASIS.T
                q = _round(np.round(c.reshape(-1, 64), 6) / steps[comp])
                yield _batch(batch.column(0), comp, batch.column(2).to_numpy(), q[:, ZIGZAG])

    return rows.mapInArrow(run, BLOCKS)


def _code(table: str, symbol: Column) -> Column:
    codes = {s: f"{c:0{n}b}" for s, n, c in dims.huffman_codes(table)}
    return F.get(F.array(*[F.lit(codes.get(s, "")) for s in range(max(codes) + 1)]), symbol)


def _magnitude(v: Column) -> Column:
    size = F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("long"))))
    low = F.when(v > 0, v).otherwise(v + F.call_function("shiftleft", F.lit(1), size) - 1)
    return size, F.when(v == 0, "").otherwise(F.lpad(F.bin(low.cast("long")), size, F.lit("0")))


def coded(rows: DataFrame) -> DataFrame:
    """(path, pos, bits): every block's code as text of zeros and ones; DC differs from the component's block before."""
    before = Window.partitionBy("path", "comp").orderBy("pos")
    rows = rows.withColumn("dc", F.col("z")[0] - F.coalesce(F.lag(F.col("z")[0]).over(before), F.lit(0)))
    size, low = _magnitude(F.col("dc"))
    luma = F.col("comp") == 0
    dc = rows.select("path", "comp", "pos", "z", F.concat(F.when(luma, _code("dc_luma", size)).otherwise(_code("dc_chroma", size)), low).alias("dc"))
    # Runs of AC: places of values, then for each the zeros before it.
    places = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda i: F.get(F.col("z"), i) != 0)
    each = dc.select("path", "comp", "pos", "z", "dc", places.alias("p")).select("path", "comp", "pos", "dc", "p", F.transform("p", lambda i, k: F.struct((i - F.when(k == 0, 0).otherwise(F.get(F.col("p"), k - 1)) - 1).alias("run"), F.get(F.col("z"), i).alias("v"))).alias("runs"))

    def symbol(table: str, e: Column) -> Column:
        size, low = _magnitude(e["v"])
        return F.concat(F.repeat(_code(table, F.lit(0xF0)), F.call_function("div", e["run"], F.lit(16)).cast("int")), _code(table, ((e["run"] % 16) * 16 + size).cast("int")), low)

    ac = lambda table: F.concat(F.array_join(F.transform("runs", lambda e: symbol(table, e)), ""), F.when(F.coalesce(F.element_at("p", -1), F.lit(0)) < 63, _code(table, F.lit(0))).otherwise(""))
    last = F.when(F.size("p") > 0, F.col("p")).otherwise(F.array(F.lit(0)))
    return each.withColumn("p", last).select("path", "pos", F.concat("dc", F.when(luma, ac("ac_luma")).otherwise(ac("ac_chroma"))).alias("bits"))


def packed(bits: DataFrame) -> DataFrame:
    """(path, pos, bytes) of texts of zeros and ones (path, pos, bits): the bytes that end within a text's bits, stuffed.

    Where a text begins is the sum of the lengths before it. It completes the byte that those before have begun, and leaves its last bits
    to the next one: every text packs its own bytes, and no row is longer than a block. A block has four bits at least, so that the two
    before hold what a byte can lack. The last of a picture fills its byte up with ones."""
    order = Window.partitionBy("path").orderBy("pos")
    n = F.length("bits")
    start = F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = bits.select("path", "pos", "bits", (start % 8).cast("int").alias("begun"), F.concat(F.coalesce(F.lag("bits", 2).over(order), F.lit("")), F.coalesce(F.lag("bits", 1).over(order), F.lit(""))).alias("before"), F.lead("pos").over(order).isNull().alias("last"))
    whole = rows.select("path", "pos", "last", F.concat(F.when(F.col("begun") > 0, F.right("before", F.col("begun"))).otherwise(""), "bits").alias("t"))
    own = whole.select("path", "pos", F.when(F.col("last"), F.rpad("t", (F.ceil(F.length("t") / 8) * 8).cast("int"), F.lit("1"))).otherwise(F.left("t", (F.floor(F.length("t") / 8) * 8).cast("int"))).alias("t"))
    return own.select("path", "pos", B.stuff(B.bits_to_bytes(F.col("t"))).alias("bytes"))


def encode(pictures: DataFrame, quality: int = 80, sub: int | tuple[int, int] = 2) -> DataFrame:
    """(path, content): JPEG files of pictures (path, width, height, data). The bytes of a picture's blocks meet in one row at the end."""
    each = packed(coded(transform(blocks(pictures, sub), quality)))
    whole = each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("b")))).alias("b"))
    head = sinks.jpeg_head(scaled_steps(quality))
    out = whole.join(pictures.select("path", "width", "height"), "path")
    scan = F.unhex(F.array_join(F.transform("b", lambda e: e["b"]), ""))
    return out.select("path", F.concat(F.lit(head), sinks.jpeg_frame(F.col("width"), F.col("height"), sampling(sub)), scan, F.lit(b"\xff\xd9")).alias("content"))


# Decoding


def headers(files: DataFrame) -> DataFrame:
    """(path, width, height, comps, quant, huff, restart, scan, exif, error) of JPEG files. comps are (id, h, v, quant, dc, ac); quant
    are (id, body), huff (class and id, body). Only baseline files with 8 bits a sample are decoded."""
    m = containers.jpeg_markers(files)
    body, at = F.col("body"), lambda i: F.conv(F.hex(F.call_function("substring", F.col("body"), F.lit(i + 1), F.lit(1))), 16, 10).cast("int")
    pick = lambda name, what: F.first(F.when(F.col("name") == name, what), ignorenulls=True)
    many = lambda name: F.collect_list(F.when(F.col("name") == name, F.struct("k", F.col("body").alias("b"))))
    g = m.groupBy("path").agg(
        pick("SOF0", at(3) * 256 + at(4)).alias("width"), pick("SOF0", at(1) * 256 + at(2)).alias("height"), pick("SOF0", body).alias("sof"), pick("SOS", body).alias("sos"), pick("DRI", at(0) * 256 + at(1)).alias("restart"),
        many("DQT").alias("quant"), many("DHT").alias("huff"), pick("scan", body).alias("scan"), F.max(F.col("name") == "APP1").alias("exif"), F.first("error", ignorenulls=True).alias("error"),
    )
    lacks = F.when(F.col("sof").isNull(), "no baseline frame").when(F.col("scan").isNull(), "no scan")
    bytes_ = lambda c: F.transform(F.array_sort(c), lambda e: e["b"])
    return g.select("path", "width", "height", "sof", "sos", F.coalesce("restart", F.lit(0)).alias("restart"), bytes_("quant").alias("quant"), bytes_("huff").alias("huff"), "scan", "exif", F.coalesce("error", lacks).alias("error"))


def _listed(heads: DataFrame, column: str, step, schema: str) -> DataFrame:
    """Rows that a small generator finds in the segments of a kind, by file and segment."""
    rows = heads.select("path", F.posexplode(column).alias("segment", "body"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in containers.slices(batches):
            out = [(p, k, *r) for p, k, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in step(b)]
            if out:
                p, k, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(k, pa.int32()), *[pa.array(c, pa.int32()) for c in rest]], ["path", "segment", *names])

    return rows.select(F.col("path").cast("string").alias("path"), "segment", "body").mapInArrow(run, f"path string, segment int, {schema}")


def quant_tables(heads: DataFrame) -> DataFrame:
    """(path, segment, id, bits, v, u, step): the quantisation steps of every table, in place; a segment can hold several tables of 8 or 16
    bits a step. One that is cut ends the segment."""

    def step(b: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(b):
            size = 2 if b[at] >> 4 else 1
            body = b[at + 1 : at + 1 + 64 * size]
            if len(body) < 64 * size:
                return
            for k, place in enumerate(dims.zigzag()):
                yield b[at] & 15, 8 * size, place // 8, place % 8, int.from_bytes(body[k * size : (k + 1) * size], "big")
            at += 1 + 64 * size

    return _listed(heads, "quant", step, "id int, bits int, v int, u int, step int")


def huffman_tables(heads: DataFrame) -> DataFrame:
    """(path, segment, class, id, length, codes): how many codes of each length every Huffman table has; class 0 is DC, 1 is AC."""

    def step(b: bytes) -> Iterator[tuple]:
        at = 0
        while at + 17 <= len(b):
            counts = b[at + 1 : at + 17]
            for n, c in enumerate(counts, 1):
                yield b[at] >> 4, b[at] & 15, n, c
            at += 17 + sum(counts)

    return _listed(heads, "huff", step, "class int, id int, length int, codes int")


class _Bits:
    """Bits of an unstuffed segment, highest first; ones beyond its end."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)
        self.used = 0

    def peek(self, n: int) -> int:
        rest = self.left - self.used - n
        return self.value >> rest & (1 << n) - 1 if rest >= 0 else (self.value << -rest | (1 << -rest) - 1) & (1 << n) - 1

    def take(self, n: int) -> int:
        out = self.peek(n) if n else 0
        self.used += n
        return out


def _tables(segments: list[bytes]) -> dict[int, dict[tuple[int, int], int]]:
    """Codes by (length, code) of all Huffman tables in DHT segments, by class and number."""
    out = {}
    for s in segments:
        at = 0
        while at + 17 <= len(s):
            counts, code, n = s[at + 1 : at + 17], 0, at + 17
            table = out[s[at]] = {}
            for length, c in enumerate(counts, 1):
                for _ in range(c):
                    table[length, code] = s[n]
                    code, n = code + 1, n + 1
                code *= 2
            at = n
    return out


def _symbol(bits: _Bits, table: dict) -> int:
    for n in range(1, 17):
        s = table.get((n, bits.peek(n)))
        if s is not None:
            bits.used += n
            return s
    raise ValueError("no such code")


def _coefficients(bits: _Bits, dc: dict, ac: dict, before: int) -> list[int]:
    """One block in zigzag order, by the DC of the component's block before."""
    extend = lambda v, n: v if n == 0 or v >> n - 1 else v - (1 << n) + 1
    z = [0] * 64
    n = _symbol(bits, dc)
    z[0] = before + extend(bits.take(n), n)
    k = 1
    while k < 64:
        run, n = divmod(_symbol(bits, ac), 16)
        if n == 0 and run < 15:
            break
        k += run
        if k > 63:
            raise ValueError("run beyond the block")
        z[k] = extend(bits.take(n), n)
        k += 1
    return z


def coefficients(heads: DataFrame) -> DataFrame:
    """(path, comp, pos, z, error) of every block, a restart segment a time; an unreadable segment gives one row with its error."""
    seg = heads.filter("error is null").select("path", "sof", "sos", "huff", "restart", "width", "height", F.posexplode(F.split(B.text(F.col("scan")), r"\xFF[\xD0-\xD7]")).alias("k", "s"))
    seg = seg.select("path", "sof", "sos", "huff", "restart", "width", "height", "k", B.unstuff(B.raw(F.col("s"))).alias("data")).repartition("path", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in containers.slices(batches):
            for path, sof, sos, huff, restart, width, height, k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                comps = [(sof[6 + 3 * i], sof[7 + 3 * i] >> 4, sof[7 + 3 * i] & 15) for i in range(sof[5])]
                use = {sos[1 + 2 * i]: sos[2 + 2 * i] for i in range(sos[0])}
                tables, bits, last = _tables(huff), _Bits(data), [0] * len(comps)
                h, v = (max(c[i] for c in comps) for i in (1, 2))
                total = -(-width // (8 * h)) * -(-height // (8 * v))
                units = range(k * restart, min(total, (k + 1) * restart)) if restart else range(total)
                per, rows, error = sum(c[1] * c[2] for c in comps), [], None
                try:
                    for unit in units:
                        n = 0
                        for i, (name, ch, cv) in enumerate(comps):
                            t = use.get(name, 0)
                            for _ in range(ch * cv):
                                z = _coefficients(bits, tables[t >> 4], tables[16 | t & 15], last[i])
                                last[i] = z[0]
                                rows.append((i, unit * per + n, z))
                                n += 1
                    if bits.used > bits.left + 7:
                        error = "segment too short"
                except (ValueError, KeyError) as e:
                    error = f"segment {k}: {e}"
                rows = rows or [(None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.int32())), strict=True)), pa.array([error] * len(rows), pa.string())], ["path", "comp", "pos", "z", "error"])

    return seg.mapInArrow(run, BLOCKS + ", error string")


def pictures(heads: DataFrame) -> DataFrame:
    """(path, width, height, data, error): RGB pictures; chroma grows bilinearly, a single component is grey."""
    rows = coefficients(heads)
    both = heads.select("path", "sof", "quant", "width", "height")
    each = rows.groupBy("path").agg(F.collect_list(F.when(F.col("z").isNotNull(), F.struct("pos", "comp", "z"))).alias("b"), F.first("error", ignorenulls=True).alias("bad"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in containers.slices(batches):
            out = []
            for sof, quant, width, height, b in zip(*(c.to_pylist() for c in batch.columns[1:6]), strict=True):
                out.append(_picture(sof, quant, width, height, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(out, pa.binary()), batch.column(6)], ["path", "width", "height", "data", "error"])

    whole = both.join(each, "path").select("path", "sof", "quant", "width", "height", "b", "bad")
    return whole.mapInArrow(run, "path string, width int, height int, data binary, error string")


def _grow(p: np.ndarray, height: int, width: int) -> np.ndarray:
    """A plane at another size, bilinearly and centre-aligned."""
    for axis, size in ((0, height), (1, width)):
        n = p.shape[axis]
        if n != size:
            at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
            low = np.floor(at).astype(int)
            part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
            p = np.take(p, low, axis) * (1 - part) + np.take(p, np.minimum(low + 1, n - 1), axis) * part
    return p


def _picture(sof: bytes, quant: list[bytes], width: int, height: int, b: list[dict]) -> bytes | None:
    comps = [(sof[7 + 3 * i] >> 4, sof[7 + 3 * i] & 15, sof[8 + 3 * i]) for i in range(sof[5])]
    steps = {}
    for s in quant:
        at = 0
        while at < len(s):
            n = 128 if s[at] >> 4 else 64
            steps[s[at] & 15] = np.frombuffer(s[at + 1 : at + 1 + n], ">u2" if n == 128 else np.uint8).astype(float)
            at += 1 + n
    h, v = (max(c[i] for c in comps) for i in (0, 1))
    wide, high, per = -(-width // (8 * h)), -(-height // (8 * v)), sum(c[0] * c[1] for c in comps)
    if len(b) != wide * high * per or any(c[2] not in steps for c in comps):
        return None
    b.sort(key=lambda e: e["pos"])
    z = np.array([e["z"] for e in b], float).reshape(high * wide, per, 64)
    planes, first = [], 0
    for ch, cv, table in comps:
        flat = np.zeros((high * wide * ch * cv, 64))
        flat[:, ZIGZAG] = (z[:, first : first + ch * cv] * steps[table]).reshape(-1, 64)
        s = np.clip(_round(np.round(BASIS.T @ flat.reshape(-1, 8, 8) @ BASIS, 6) + 128), 0, 255)
        planes.append(s.reshape(high, wide, cv, ch, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(high * cv * 8, wide * ch * 8))
        first += ch * cv
    y, *rest = (_grow(p, high * v * 8, wide * h * 8) for p in planes)
    cb, cr = (p - 128 for p in rest[:2]) if len(rest) >= 2 else (0, 0)
    rgb = np.stack(np.broadcast_arrays(y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), 2)
    return np.clip(_round(np.round(rgb, 6)), 0, 255).astype(np.uint8)[:height, :width].tobytes()


def decode(files: DataFrame, counters: Observation | None = None) -> DataFrame:
    """(path, width, height, data, error) of JPEG files (path, content); a file that cannot be decoded has its error instead.

    ``counters`` gets, with the decode itself and without another pass, the files, those decoded, skipped before (no frame, no scan, a
    bad marker) and failed within, and the samples of those decoded."""
    heads = headers(files)
    bad = heads.filter("error is not null").select("path", "width", "height", F.lit(None).cast("binary").alias("data"), "error", F.lit(True).alias("skipped"))
    out = pictures(heads.filter("error is null")).withColumn("skipped", F.lit(False)).unionByName(bad)
    if counters is not None:
        done = F.col("error").isNull() & F.col("data").isNotNull()
        size = F.when(done, F.octet_length("data")).otherwise(0).cast("long")
        out = out.observe(counters, F.count(F.lit(1)).alias("files"), F.count_if(done).alias("decoded"), F.count_if("skipped").alias("skipped"), F.count_if(~done & ~F.col("skipped")).alias("failed"), F.coalesce(F.sum(size), F.lit(0)).alias("samples"))
    return out.drop("skipped")


def psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, psnr) of pictures of equal names, over all samples; infinite for equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in containers.slices(batches):
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            mse = [float(np.mean((np.frombuffer(x, np.uint8).astype(float) - np.frombuffer(y, np.uint8)) ** 2)) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([10 * math.log10(65025 / m) if m else math.inf for m in mse])], ["path", "psnr"])

    return a.select("path", F.col("data").alias("x")).join(b.select("path", F.col("data").alias("y")), "path").mapInArrow(run, "path string, psnr double")
