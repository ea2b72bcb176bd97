"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from lumenflow.llm import bpe, exact_dedup, filter_audit, fingerprint, language_id, lm_scoring, merkle, mixing, near_dedup, quality, token_counts, toxicity, url_filter


def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline, one after the other."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_language_id": language_id.query,
        "op2_lm_scoring": lm_scoring.query,
        "op3_quality": quality.query,
        "op4_token_counts": token_counts.query,
        "op5_near_dedup": near_dedup.query,
        "op6_byte_bpe": bpe.query,
        "op7_fingerprint": fingerprint.query,
        "op8_toxicity": toxicity.query,
        "op9_mixing": mixing.query,
        "op10_exact_dedup": exact_dedup.query,
        "op11_filter_audit": filter_audit.query,
        "op12_merkle": merkle.query,
        "op13_url_filter": url_filter.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict:
    return {"op9_mixing": mixing.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_filter_audit": filter_audit.SQL, "op12_merkle": merkle.SQL}
