"""Tables that are stored between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """Writes a table below spark.checkpoint.dir and reads it back: cuts lineage, and survives lost executors. Where the setting is unset, a
    folder is made on a single machine (tests); a cluster without it is refused, since its machines would not see each other's files."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/lumenflow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
