"""What is said of a finished passage: scores, method, verdict, summary, and how it compares with the live alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import band, choose_method

FLOORS = ("bigram_p02", "bigram_p10", "trigram_p02", "trigram_p10", "pcfg_p02", "pcfg_p10")


def judge(scored: DataFrame, floors: dict[str, float], longest: int = 25) -> DataFrame:
    """Adds method and verdict to rows (n_words, pcfg_logp (null: no parse), bigram_logp, trigram_logp, coverage).

    Per-word scores count the terminator: log-probability / (n + 1)."""
    per = {m: F.col(f"{m}_logp") / (F.col("n_words") + 1) for m in ("pcfg", "bigram", "trigram")}
    f = {k: F.lit(float(v)) for k, v in floors.items()}
    method = choose_method(F.col("pcfg_logp").isNotNull(), F.col("n_words"), per["pcfg"], F.col("coverage"), f["pcfg_p02"], longest)
    rows = scored.withColumns({f"{m}_per_word": per[m] for m in per}).withColumn("method", method)
    verdict = F.lit(None).cast("string")
    for m in ("pcfg", "trigram", "bigram"):
        verdict = F.when(F.col("method") == m, band(F.col(f"{m}_per_word"), f[f"{m}_p02"], f[f"{m}_p10"])).otherwise(verdict)
    return rows.withColumn("verdict", verdict)


def summary(judged: DataFrame) -> DataFrame:
    """The nine columns of the end-of-passage table."""
    two = lambda c: F.round(c, 2).alias(c)
    return judged.select("id", "n_words", two("bigram_per_word"), two("trigram_per_word"), two("pcfg_per_word"), two("coverage"), "method", "verdict", F.col("pcfg_logp").isNotNull().alias("parsed"))


def compare_live(judged: DataFrame, live: DataFrame) -> DataFrame:
    """One row from rows (id, verdict) and (id, flagged): both, live_only, final_only, neither, and the share that agrees."""
    rows = judged.join(live, "id").select("flagged", (F.col("verdict") != "grammatical").alias("final"))
    out = rows.agg(
        F.count("*").alias("sentences"), F.count_if(F.col("flagged") & F.col("final")).alias("both_flagged"), F.count_if(F.col("flagged") & ~F.col("final")).alias("live_only"),
        F.count_if(~F.col("flagged") & F.col("final")).alias("final_only"), F.count_if(~F.col("flagged") & ~F.col("final")).alias("neither"),
    )
    return out.withColumn("agreement", F.round(F.coalesce(F.try_divide(F.col("both_flagged") + F.col("neither"), F.col("sentences")), F.lit(0.0)), 6))


def counters(judged: DataFrame) -> DataFrame:
    """(method, verdict, n)."""
    return judged.groupBy("method", "verdict").agg(F.count("*").alias("n"))


def improvement(rows: DataFrame) -> DataFrame:
    """Rows (metric, baseline, model) with the gain and the part of the baseline's errors that the model removes (null: it made none)."""
    gain = F.col("model") - F.col("baseline")
    return rows.withColumns({"gain": F.round(gain, 6), "error_reduction": F.round(F.try_divide(gain, 1 - F.col("baseline")), 6)})
