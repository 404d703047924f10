"""The query of each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obsq.llm import decontaminate, gif, language_id, line_dedup, ngram_join, packing, pii, token_counts, token_output, warc
from obsq.llm.common import table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_item=1)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.op2_token_output(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op3_ngram_join(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op4_line_dedup(table(spark, sf_dir, "documents"), 10)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op5_warc(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6_pii(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op7_language_id(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op8_token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), None)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op9_packing(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.op10_gif(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_decontaminate, op2_token_output, op3_ngram_join, op4_line_dedup, op5_warc, op6_pii, op7_language_id, op8_token_counts, op9_packing, op10_gif)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": ngram_join.ORACLE, "op4_line_dedup": line_dedup.ORACLE.format(words=10), "op5_warc": warc.ORACLE}
