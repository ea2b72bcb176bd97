"""Signals made of the driver's tables, which hold no images: samples, pixels, blocks and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.functions import scalar as S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, part, x, s): the lines of an order are the samples of a block, eight for each part of it."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")) - 1
    rows = lines.select(F.col("l_orderkey").alias("block"), at.alias("i"), F.round("l_quantity").cast("int").alias("s"))
    return rows.select("block", F.expr("i div 8").alias("part"), (F.col("i") % 8).alias("x"), "s")


SAMPLES = """samples AS (SELECT block, i // 8 AS part, CAST(i % 8 AS INT) AS x, s FROM (SELECT l_orderkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i,
  CAST(round(l_quantity) AS INT) AS s FROM lineitem))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, r, g, b): a pixel for each line of an order."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") * 7 % 256).cast("int").alias("g"), (F.round(F.col("l_quantity") * 5).cast("int") % 256).alias("b")
    )


PIXELS = """px AS (SELECT l_orderkey AS y, l_linenumber AS x, CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey * 7 % 256 AS INT) AS g,
  CAST(round(l_quantity * 5) AS INT) % 256 AS b FROM lineitem)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v): 8x8 blocks of samples from 0 to 255, row by row."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 64 + 128).cast("int")))).alias("v"))


BLOCKS = """blocks AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor(CAST(x AS DOUBLE) * 64 + 128))) AS INT)) AS v FROM embeddings)"""


def quarters(blocks_: DataFrame, array: str = "v") -> DataFrame:
    """(id, v): the four 4x4 blocks of each block, row by row; block n has those from 4 * n on, the upper ones first."""
    four = [F.expr("array(" + ", ".join(f"get({array}, {(4 * qy + r) * 8 + 4 * qx + c})" for r in range(4) for c in range(4)) + ")") for qy in (0, 1) for qx in (0, 1)]
    return blocks_.select("id", F.posexplode(F.array(*four)).alias("part", array)).select((4 * F.col("id") + F.col("part")).alias("id"), array)


QUARTERS = f"""{BLOCKS}, quarters AS (SELECT id * 4 + part AS id, list_transform(range(16), lambda i: v[(part // 2 * 4 + i // 4) * 8 + part % 2 * 4 + i % 4 + 1]) AS v FROM blocks, (SELECT unnest(range(4)) AS part))"""


def grid(df: DataFrame) -> DataFrame:
    """The plane of a 4x4 block of :func:`quarters` and its place there, counted in blocks: plane, gy, gx."""
    k = F.expr(f"int(id % {4 * VECTORS})")
    return df.select("*", F.expr(f"id div {4 * VECTORS}").alias("plane"), (S.shift(k, 5) * 2 + S.shift(k, 1).bitwiseAND(1)).alias("gy"), (S.shift(k, 2).bitwiseAND(7) * 2 + k.bitwiseAND(1)).alias("gx"))


GRID_OF = "id // 256 AS plane, CAST(id % 256 // 32 * 2 + id % 4 // 2 AS INT) AS gy, CAST(id % 32 // 4 * 2 + id % 2 AS INT) AS gx"


def block_rows(blocks_: DataFrame) -> DataFrame:
    """(id, y, x, s) of blocks (id, v)."""
    rows = blocks_.select("id", F.posexplode("v").alias("i", "s"))
    return rows.select("id", F.expr("i div 8").alias("y"), F.expr("i % 8").alias("x"), "s")


ROWS = "rows_ AS (SELECT id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, v[i] AS s FROM blocks, (SELECT unnest(range(1, 65)) AS i))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, n, kind, bytes, us): n is the decode order of a frame, us its time in microseconds."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("n"), F.col("event_type").alias("kind"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


FRAMES = "frames AS (SELECT user_id AS stream, event_id AS n, event_type AS kind, CAST(floor(value * 100) AS BIGINT) AS bytes, epoch_us(ts) AS us FROM events)"


#: Samples of a macroblock's side, macroblocks of a plane's side, and vectors of a plane.
TILE, GRID = 16, 4
SIDE = TILE * GRID
VECTORS = (SIDE // 8) ** 2


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plane, y, x, high, wide, v): the macroblocks of planes of 64 by 64 samples, each of 64 vectors that follow each other, eight in a
    row. Samples of vectors that are missing are 128. A plane has high by wide macroblocks; y and x count them."""
    rows = blocks(spark, sf_dir).select(F.expr(f"id div {VECTORS}").alias("plane"), F.expr(f"int(id % {VECTORS})").alias("k"), "v")
    held = rows.groupBy("plane").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))  # 64 vectors at most
    each = held.select("plane", "m", F.explode(F.sequence(F.lit(0), F.lit(GRID * GRID - 1))).alias("t")).select("plane", "m", S.shift("t", 2).alias("y"), F.col("t").bitwiseAND(3).alias("x"))
    grey = F.array_repeat(F.lit(128), 64)
    four = [F.coalesce(F.try_element_at("m", (2 * F.col("y") + j) * 8 + 2 * F.col("x") + i), grey) for j in (0, 1) for i in (0, 1)]
    return each.select("plane", "y", "x", F.lit(GRID).alias("high"), F.lit(GRID).alias("wide"), F.array(*four).alias("b")).select("plane", "y", "x", "high", "wide", F.flatten(F.array(*[F.slice(F.get("b", F.lit(2 * (r // 8) + h)), 8 * (r % 8) + 1, 8) for r in range(TILE) for h in (0, 1)])).alias("v"))


PLANES = f"""{BLOCKS}, cells AS (SELECT id // 64 AS plane, ((id % 64) // 8 * 8 + i // 8) * 64 + id % 8 * 8 + i % 8 AS k, v[i + 1] AS s FROM blocks, (SELECT unnest(range(64)) AS i)),
plane AS (SELECT g.plane, g.k, coalesce(s, 128) AS s FROM (SELECT plane, unnest(range(4096)) AS k FROM (SELECT DISTINCT plane FROM cells)) g LEFT JOIN cells c ON c.plane = g.plane AND c.k = g.k)"""
