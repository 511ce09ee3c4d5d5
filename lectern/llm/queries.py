"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, chat, decontaminate, infill, language, minhash, packing, pieces, pii, resample, toxicity, url_filter, weak_quality


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_read(spark, sf_dir, "documents"))


def op6_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"))


def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_pages(_read(spark, sf_dir, "pages"))


def op9_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality(_read(spark, sf_dir, "documents"))


def op10_url_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_windows(chat.with_probe(_read(spark, sf_dir, "conversations"))))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(_read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_toxicity_grammar, op2_benchmark_decontamination, op3_token_packing, op4_minhash_near_duplicates, op5_language_kernel,
        op6_sentencepiece_scan, op7_pii_disclosure, op8_arc_to_warc, op9_weak_quality_rules, op10_url_digest_filter,
        op11_importance_resampling, op12_chat_windows, op13_fill_in_middle,
    )
    return {f.__name__: f for f in registered}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_arc_to_warc": archives.SQL, "op10_url_digest_filter": url_filter.SQL, "op11_importance_resampling": resample.SQL,
        "op12_chat_windows": chat.SQL, "op13_fill_in_middle": infill.SQL,
    }
