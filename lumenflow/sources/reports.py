"""Measurement files as tables: CSV with loose ends, text tables with comments, dumps, and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Typed rows of a CSV file whose lines may end in a comma. Rows that do not fit the schema have nulls."""
    names = [f.split()[0] for f in schema.split(", ")]
    lines = spark.read.text(path).select(F.split(F.rtrim("value", F.lit(",")), ",").alias("v"))
    rows = lines.select(*[F.trim(F.get("v", F.lit(i))).try_cast(f.split()[1]).alias(f.split()[0]) for i, f in enumerate(schema.split(", "))])
    return rows.filter(F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()) if header else rows


def keyframes(spark: SparkSession, path: str) -> DataFrame:
    """Times of key frames, sorted."""
    return csv(spark, path, "pts_time double").orderBy("pts_time")


def frame_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(bytes, type) of a headerless file; lines that do not begin with a number are left out."""
    lines = spark.read.text(path).filter(F.col("value").rlike("^[0-9]+(,|$)"))
    v = F.split("value", ",")
    return lines.select(v[0].cast("long").alias("bytes"), F.get(v, F.lit(1)).alias("type"))


def packets(spark: SparkSession, path: str) -> DataFrame:
    """(size, type) of packets with flags: I for key frames, P for others."""
    v = F.split("value", ",")
    rows = spark.read.text(path).select(v[0].try_cast("long").alias("size"), F.get(v, F.lit(1)).alias("flags")).filter("size is not null")
    return rows.select("size", F.when(F.col("flags").contains("K"), "I").otherwise("P").alias("type"))


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of a text table with columns between blanks and comments behind #."""
    lines = spark.read.text(path).filter(~F.trim("value").rlike("^(#|$)"))
    v = F.split(F.trim("value"), r"\s+")
    return lines.select(*[F.get(v, F.lit(i)).try_cast(f.split()[1]).alias(f.split()[0]) for i, f in enumerate(schema.split(", "))])


def nal_dump(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, type_id, ref_idc, sc_len, offset, size, rbsp_size, ep3b) of a dump whose name column may hold blanks; the total
    line and comments are left out."""
    pattern = r"^\s*(\d+)\s+(.*?)" + r"\s+(-?\d+)" * 7 + r"\s*$"
    names = ["idx", "name", "type_id", "ref_idc", "sc_len", "offset", "size", "rbsp_size", "ep3b"]
    got = [F.regexp_extract("value", pattern, i + 1) for i in range(9)]
    return spark.read.text(path).filter(F.col("value").rlike(pattern)).select(*[g.alias(n) if n == "name" else g.cast("long").alias(n) for n, g in zip(names, got, strict=True)])


def numbers_behind(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(at, value) of the numbers behind ``label:`` in a text file."""
    lines = spark.read.text(path).filter(F.trim("value").startswith(label + ":"))
    return lines.select(F.posexplode(F.regexp_extract_all(F.expr(f"substring(trim(value), {len(label) + 2})"), F.lit(r"(-?\d+)"), F.lit(1))).alias("at", "v")).select("at", F.col("v").cast("long").alias("value"))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines ``key: value`` or ``key value``."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*([^:=\s]+)\s*[:=]?\s*(.*?)\s*$", 1).alias("key"), F.regexp_extract("value", r"^\s*([^:=\s]+)\s*[:=]?\s*(.*?)\s*$", 2).alias("value")).filter("key <> '' and key not like '#%'")


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def unpivoted(row: DataFrame) -> DataFrame:
    """Statistics of one row as (key, value) lines, ready for ``write.text`` or ``write.csv``."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in row.columns)
    return row.selectExpr(f"stack({len(row.columns)}, {pairs}) as (key, value)")


def basename(path: str | Column) -> Column:
    """A file's name without folder and ending."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
