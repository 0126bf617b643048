"""Parameter grids: decoder tuning, tagger order, merge probability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edits import keyed_number
from ..operators import segmentation
from ..operators.corpus import rows_of, spans

PENALTIES = (0.0, -2.0, -4.0, -6.0, -8.0)
BEAMS = (4, 8, 16)
MERGE_SHARES = (0.0, 0.04, 0.08, 0.16)


def tune_segmentation(w: DataFrame, train: DataFrame, penalties: tuple[float, ...] = PENALTIES, beams: tuple[int, ...] = BEAMS) -> DataFrame:
    """(penalty, beam, f1, boundary_f1, n_exact): penalties at beam 8 first, then beams at the best penalty; the first best wins."""
    gold = spans(w).withColumn("key", F.concat_ws("/", "doc_id", "sent"))
    strings = w.groupBy("doc_id", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), "").alias("chars"))
    strings = strings.withColumn("key", F.concat_ws("/", "doc_id", "sent"))

    def score(penalty: float, beam: int) -> DataFrame:
        config = segmentation.DecoderConfig(beam_width=beam, unk_penalty=penalty)
        found = segmentation.word_spans(segmentation.segment(strings, train, config)).join(strings.select("key", "chars"), "chars")
        return segmentation.segmentation_scores(gold, found).select(F.lit(penalty).alias("penalty"), F.lit(beam).alias("beam"), "f1", "boundary_f1", "n_exact")

    out = [(p, 8, *score(p, 8).select("f1", "boundary_f1", "n_exact").first()) for p in penalties]
    best = max(out, key=lambda r: r[2])[0]
    out += [(best, b, *score(best, b).select("f1", "boundary_f1", "n_exact").first()) for b in beams if b != 8]
    return w.sparkSession.createDataFrame(out, "penalty double, beam int, f1 double, boundary_f1 double, n_exact long")


def merge_sweep(w: DataFrame, shares: tuple[float, ...] = MERGE_SHARES) -> DataFrame:
    """(share, n_tokens, n_merged): what each merge probability makes of the words."""
    rows = rows_of(w).select("doc_id", "sent", F.posexplode("words").alias("at", "word"))
    draws = rows.select(keyed_number(F.col("doc_id"), F.col("sent"), (F.col("at") + 1).cast("long")).alias("draw"), (F.col("at") > 0).alias("follows"))
    # Each word draws once; every share is held against the same draw, as a word's draw does not depend on it.
    joined = [F.col("follows") & (F.col("draw") < int(s * (1 << 28))) for s in shares]
    counts = draws.agg(F.count("*").alias("n"), *(F.count_if(j).alias(f"j{k}") for k, j in enumerate(joined)))
    each = F.array(*(F.struct(F.lit(s).alias("share"), (F.col("n") - F.col(f"j{k}")).alias("n_tokens"), F.col(f"j{k}").alias("n_merged")) for k, s in enumerate(shares)))
    return counts.select(F.inline(each))
