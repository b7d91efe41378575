"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_blocks, kneser_ney, langid, licenses, mixing, simhash, token_store, winnow


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_all(_docs(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir), loose=licenses.COMPACT).drop("matches")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_docs(spark, sf_dir))


def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(_docs(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_docs(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_docs(spark, sf_dir))


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.SQL}
