"""One query for each corpus operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recoflux.llm import decontamination, jaccard, language, packing, phrases, quality, sharding, suffixes, tokens, topk
from recoflux.llm.common import table


def on_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": on_documents(sharding.op1_sharding),
        "op2_decontamination": lambda spark, sf_dir: decontamination.op2_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op3_quality": lambda spark, sf_dir: quality.op3_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op4_packing": on_documents(packing.op4_packing),
        "op5_suffix_dedup": on_documents(suffixes.op5_suffix_dedup),
        "op6_language": on_documents(language.op6_language),
        "op7_token_counts": on_documents(tokens.op7_token_counts),
        "op8_substring_dedup": on_documents(phrases.op8_substring_dedup),
        "op9_topk": lambda spark, sf_dir: topk.op9_topk(table(spark, sf_dir, "embeddings")),
        "op10_jaccard": on_documents(jaccard.op10_jaccard),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontamination.SQL, "op8_substring_dedup": phrases.SQL, "op9_topk": topk.SQL, "op10_jaccard": jaccard.SQL}
