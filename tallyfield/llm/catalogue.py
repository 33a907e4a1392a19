"""Queries of this subpackage and their SQL; __spark_entry__.py adds them if it can import this."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm import byte_bpe, conversations, decontamination, line_dedup, ngram_join, pii, quality_model, quality_rules, quantile_summaries, sharding, suffix_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_quality_model": quality_model.op4_quality_model,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_sharding": sharding.op7_sharding,
        "op8_pii": pii.op8_pii,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_warc": warc.op10_warc,
        "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
        "op12_quantile_summaries": quantile_summaries.op12_quantile_summaries,
        "op13_conversation_repair": conversations.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": line_dedup.OP9_SQL, "op10_warc": warc.OP10_SQL, "op13_conversation_repair": conversations.OP13_SQL}
