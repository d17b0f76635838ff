"""Registered queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from trendloom.llm import byte_bpe, decontaminate, exact_substring, language, lexical_search, mixing, near_dedup, quality_net, quality_rules, spelling, substring, toxicity, url_filter

Build = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Build]:
    return {
        "op1_minhash_near_dedup": lambda s, d: near_dedup.class_rows(table(s, d, "documents")),
        "op2_benchmark_decontamination": lambda s, d: decontaminate.digest_rows(table(s, d, "documents"), table(s, d, "benchmark")),
        "op3_quality_classifier": lambda s, d: quality_net.scored_rows(table(s, d, "documents"), table(s, d, "labels")),
        "op4_suffix_array_dedup": lambda s, d: exact_substring.digest_rows(table(s, d, "documents")),
        "op5_language_id": lambda s, d: language.predicted_rows(table(s, d, "documents")),
        "op6_toxicity": lambda s, d: toxicity.scored_rows(table(s, d, "documents"), table(s, d, "labels")),
        "op7_substring_dedup": lambda s, d: substring.digest_rows(table(s, d, "documents")),
        "op8_url_filter": lambda s, d: url_filter.filter_urls(table(s, d, "pages")),
        "op9_quality_rules": lambda s, d: quality_rules.verdict_rows(table(s, d, "documents")),
        "op10_byte_bpe": lambda s, d: byte_bpe.digest_rows(table(s, d, "documents")),
        "op11_source_mix": lambda s, d: mixing.taken_rows(table(s, d, "documents")),
        "op12_spelling_variants": lambda s, d: spelling.variant_groups(table(s, d, "documents")),
        "op13_ranked_search": lambda s, d: lexical_search.ranked_rows(table(s, d, "documents"), table(s, d, "benchmark")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": decontaminate.ORACLE, "op9_quality_rules": quality_rules.ORACLE, "op11_source_mix": mixing.ORACLE, "op12_spelling_variants": spelling.ORACLE, "op13_ranked_search": lexical_search.ORACLE}
