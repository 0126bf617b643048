"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .cross_polytope import link_vectors
from .decontaminate import find_leaks
from .deleted_interpolation import score_documents
from .importance import resample
from .language_profiles import identify_languages
from .line_blocks import extract_pages
from .minhash import near_duplicates
from .sentencepieces import encode_digests
from .token_lengths import length_histogram
from .url_rules import ORACLE_SQL as URL_SQL
from .url_rules import judge_urls


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op2_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op4_sentencepiece_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def op5_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_deleted_interpolation": op1_deleted_interpolation,
        "op2_rank_order_profiles": op2_rank_order_profiles,
        "op3_url_rules": op3_url_rules,
        "op4_sentencepiece_suffix_array": op4_sentencepiece_suffix_array,
        "op5_line_block_extraction": op5_line_block_extraction,
        "op6_bm25_decontamination": op6_bm25_decontamination,
        "op7_cross_polytope": op7_cross_polytope,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_token_length_histogram": op9_token_length_histogram,
        "op10_importance_resampling": op10_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": URL_SQL}
