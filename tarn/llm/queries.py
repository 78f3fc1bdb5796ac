"""The registered queries of the operators: each applies its operator, with production
parameters, to the whole table and returns the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm.decontamination import leak_report
from tarn.llm.exact_dedup import exact_dedup
from tarn.llm.fingerprints import fingerprints
from tarn.llm.hard_negatives import hard_negatives
from tarn.llm.jaccard_join import jaccard_components
from tarn.llm.language_id import language_id
from tarn.llm.license_scan import license_scan
from tarn.llm.lm_scoring import lm_scores
from tarn.llm.sentencepiece_codec import encode
from tarn.llm.substring_dedup import repeated_passages
from tarn.llm.token_counts import token_counts
from tarn.llm.token_output import token_output
from tarn.llm.vector_codes import vector_codes


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir), modulus=4, remainder=2)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model")).drop("ids")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), size=5, num=75, den=100)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), modulus=5, remainder=1)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir), window=20).drop("spans")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), batches=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), limit=2048)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(embeddings(spark, sf_dir), every=100, wrong=7, classes=10, scale=256.0, k=5)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(embeddings(spark, sf_dir), parts=8, entries=16, rounds=6, scale=4096.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_sentencepiece, op3_ngram_jaccard, op4_token_output, op5_decontamination, op6_lm_scoring, op7_license_scan, op8_substring_dedup, op9_exact_dedup, op10_token_counts, op11_fingerprints, op12_hard_negatives, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    from tarn.llm import oracles

    return {k: v for k, v in oracles.SQL.items() if k in queries()}
