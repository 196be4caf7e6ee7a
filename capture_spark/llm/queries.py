"""Registered corpus queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capture_spark.llm import alignment, infill, langid, licenses, mixing, neardup, neighbours, pages, pieces, quality, scoring, sharding, substrings


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_minhash_near_dedup": neardup.query,
    "op3_html_extraction": pages.query,
    "op4_exact_top_k": neighbours.query,
    "op5_lm_scoring": scoring.query,
    "op6_source_mixing": mixing.query,
    "op7_license_scan": licenses.query,
    "op8_substring_dedup": substrings.query,
    "op9_sharding": sharding.query,
    "op10_sentencepiece": pieces.query,
    "op11_language_id": langid.query,
    "op12_fill_in_middle": infill.query,
    "op13_token_alignment": alignment.query,
    "pipeline": pipeline,
}
ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op2_minhash_near_dedup": neardup.ORACLE,
    "op4_exact_top_k": neighbours.ORACLE,
    "op6_source_mixing": mixing.ORACLE,
    "op7_license_scan": licenses.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op12_fill_in_middle": infill.ORACLE,
}
