"""The grammar check of a window of words, and the levels at which checks fire, taken from scored text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngrams import NgramModel, nearest_rank, sentence_scores
from .spelling import correct_realwords, realword_scores

#: What a real-word fix must gain to raise an alert, beyond what the corrector asks for itself.
MARGIN = 2.0


def window_text(windows: DataFrame) -> DataFrame:
    """The words of rows (key, words), each a sentence."""
    text = windows.where(F.size("words") > 0).select(F.col("key").alias("doc_id"), F.lit(0).alias("sent"), F.posexplode("words").alias("at", "word"))
    return text.select("doc_id", "sent", (F.col("at") + 1).cast("long").alias("i"), "word")


def window_scores(windows: DataFrame, model: NgramModel, vocab: DataFrame, bigrams: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(key, perplexity, n_fixes) of rows (key, words): the window as a sentence under the add-k model, and its known words that
    another would replace with a gain over the margin.  Each word is judged in the window as it is."""
    text = window_text(windows)
    scored = sentence_scores(model, text, "addk", "doc_id").select("doc_id", F.exp(-F.col("logp") / (F.col("n_words") + 1)).alias("perplexity"))
    fixes = correct_realwords(realword_scores(text, vocab, bigrams)).where((F.col("corrected") != F.col("word")) & (F.round(F.col("best_score") - F.col("own_score"), 9) > margin))
    counted = fixes.groupBy("doc_id").agg(F.count("*").alias("n_fixes"))
    return scored.join(counted, "doc_id", "left").select(F.col("doc_id").alias("key"), "perplexity", F.coalesce("n_fixes", F.lit(0)).alias("n_fixes"))


def fired(scored: DataFrame, threshold: float) -> DataFrame:
    """Adds `fired`: a finite perplexity over the threshold, or a real-word fix."""
    odd = (F.col("perplexity") > threshold) & (F.col("perplexity") < float("inf"))
    return scored.withColumn("fired", odd | (F.col("n_fixes") > 0))


def window_threshold(scored: DataFrame, share: float = 0.95) -> float:
    """The perplexity that only the rest of the windows exceed; infinite where there are none."""
    level = nearest_rank(scored, "perplexity", [share])[0]
    return float("inf") if level is None else level


def language_floors(judged: DataFrame, methods: tuple[str, ...] = ("bigram", "trigram")) -> dict[str, float]:
    """p02 and p10 of the per-word scores of each method, of rows of analysis.judge()."""
    out = {}
    for m in methods:
        for s, v in zip((0.02, 0.1), nearest_rank(judged, f"{m}_per_word", [0.02, 0.1]), strict=True):
            out[f"{m}_p{round(100 * s):02d}"] = float("-inf") if v is None else v
    return out


def grammar_floors(parsed: DataFrame, tags: DataFrame, shortest: int = 3, longest: int = 25) -> dict[str, float]:
    """pcfg_p02, pcfg_p10, pcfg_median (per word, the terminator counted), parse_rate and tag_agreement, of parses
    (id, n_words, logp; null: none) of sentences of a length that is parsed, and of tags (id, tag, pred)."""
    sample = parsed.where(F.col("n_words").between(shortest, longest)).select("id", "n_words", "logp", (F.col("logp") / (F.col("n_words") + 1)).alias("per_word"))
    levels = nearest_rank(sample, "per_word", [0.02, 0.1, 0.5])
    n, good = sample.agg(F.count("*"), F.count("logp")).first()
    right = tags.join(sample.select("id"), "id", "left_semi").agg(F.avg((F.col("tag") == F.col("pred")).cast("double"))).first()[0]
    named = zip(("pcfg_p02", "pcfg_p10", "pcfg_median"), (float("-inf") if v is None else v for v in levels), strict=True)
    return dict(named) | {"parse_rate": good / n if n else 0.0, "tag_agreement": right or 0.0, "n_sampled": float(n), "max_words": float(longest)}


def write_floors(spark: SparkSession, path: str, floors: dict[str, float]) -> dict[str, float]:
    """Stores the levels as JSON beside those already at the path, which they replace by name; all of them."""
    every = read_floors(spark, path) | floors
    spark.createDataFrame([(json.dumps(every, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return every


def read_floors(spark: SparkSession, path: str, *others: str) -> dict[str, float]:
    """The levels stored at the paths, later ones first; a path without any adds none."""
    out: dict[str, float] = {}
    for p in (path, *others):
        try:
            rows = spark.read.text(p).collect()  # one row
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = []
        for r in rows:
            out |= json.loads(r.value)
    return out
