"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Staging

#: Lengths to a block of the two-level suffix sums.
_BLOCK = 1024

_encoders: dict[str, object] = {}


def tiktoken_encoder(path: str, pattern: str | None = None):
    """The encoding of a file of base64 tokens and ranks; a bare file name is one of the public tokenizers."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path if "/" in path else public_tokenizers.path(path), "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encoded_lengths(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", text_col: str = "text") -> DataFrame:
    """(n_tokens, n): for each batch, how many texts have each encoded length.  Whole texts; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken_encoder(tokenizer).encode_ordinary
        for batch in batches:
            found: dict[int, int] = {}
            for text in batch.column("text").to_pylist():
                n = len(encode(text)) if text else 0
                found[n] = found.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["n_tokens", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long, n long")


def length_histogram(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", text_col: str = "text") -> DataFrame:
    """One row for each encoded length that occurs.

    n_docs: texts of this length; docs_at_least, tokens_at_least: texts of this length or more, and
    their tokens; share_at_most: the part of all texts that is no longer, so the quantile q is the
    least length with share_at_most >= q; truncated_total: tokens left if every text is cut to this
    length; total_docs, total_tokens.  Defined cases: null and empty texts have length 0; repeated
    rows count each; texts of any length are encoded whole, one at a time; other columns are ignored; an empty table gives no rows.
    """
    counts = encoded_lengths(docs, tokenizer, text_col).groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))
    # Written once, as two branches below read it and encoding is what costs.
    counts = Staging(docs.sparkSession).write(counts).withColumn("block", F.floor(F.col("n_tokens") / _BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    # One row a block: the suffix sums of whole blocks run over few rows, those inside a block in parallel.
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    blocks = blocks.select(
        "block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"),
        F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    summed = counts.select("*", F.sum("n_docs").over(inside).alias("d_in"), F.sum("tokens").over(inside).alias("t_in")).join(blocks, "block")
    docs_at_least, tokens_at_least = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    return summed.select(
        "n_tokens", "n_docs", docs_at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"),
        ((F.col("total_docs") - docs_at_least + F.col("n_docs")) / F.col("total_docs")).alias("share_at_most"),
        (F.col("total_tokens") - tokens_at_least + F.col("n_tokens") * docs_at_least).alias("truncated_total"),
        "total_docs", "total_tokens",
    )


def context_report(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: texts that fit, tokens of those, and tokens left if all texts are cut to it."""
    limit = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    cut = F.least("n_tokens", "context") * F.col("n_docs")
    fits = F.col("n_tokens") <= F.col("context")
    each = histogram.select("n_tokens", "n_docs", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("context"))
    got = each.groupBy("context").agg(
        F.sum(F.when(fits, F.col("n_docs")).otherwise(0)).alias("docs_that_fit"),
        F.sum(F.when(fits, F.col("n_docs") * F.col("n_tokens")).otherwise(0)).alias("tokens_that_fit"), F.sum(cut).alias("truncated_total"),
    )
    return limit.join(got, "context", "left")
