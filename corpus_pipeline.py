"""From raw documents to token ids: language, quality, near copies, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import Staging, table
from quillstream.llm.decontaminate import without_leaks
from quillstream.llm.importance import select_documents
from quillstream.llm.language_profiles import learn_profiles, with_language
from quillstream.llm.minhash import MinMaxConfig, keep_one_of_each
from quillstream.llm.sentencepieces import encode_documents

#: A document goes if its text is further than this from every profile (1: the same ranks).
LEAST_LANGUAGE_SCORE = 0.25
#: Five-word shingles, similarity 0.8: with 30 bands of 5 a pair at 0.8 is missed with a chance of 7e-6.
NEAR = MinMaxConfig(shingle=5, percent=80, bands=30, rows=5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return with_language(docs, learn_profiles(docs), LEAST_LANGUAGE_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance: neither junk nor toxic."""
    return select_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs, NEAR)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as SentencePiece ids."""
    return encode_documents(docs).select("doc_id", "lang", "source", "tokens", F.size("tokens").cast("long").alias("n_tokens"))


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("encode", encode)]

#: Profiles, importance weights, BM25 and piece matching are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written and read again before the next."""
    staging = Staging(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staging.write(docs)
    return docs
