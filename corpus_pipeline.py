"""Corpus pipeline: language, exact copies, near copies, mix, token ids. Each stage takes (spark, docs, sf_dir).

Stages whose tasks read whole texts in Python store their result themselves: whoever writes it, texts come in small batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenflow.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from lumenflow.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those that no known language codes better than noise, go."""
    return stored(language_id.accepted(docs, language_id.fit(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return near_dedup.unique(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix of sources."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and the place in the mix that the order of the files gives."""
    return stored(bpe.digests(mixing.placed(docs, "doc_id", "text")))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("byte_bpe", tokens)]

#: Language identification and BPE are beyond SQL; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
