"""Small tables for reading: the top of a count, the weakest classes, examples, samples, latencies and lists of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def most_common(counts: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n rows of the largest `cnt`, equal counts in the order of the other columns named."""
    return counts.orderBy(F.desc("cnt"), *ties).limit(n)


def most_confused(cells: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent mistakes of confusion() cells."""
    return most_common(cells.where("gold <> pred"), n, "gold", "pred")


def common_tags(cells: DataFrame, n: int) -> list[str]:
    """The n most frequent gold tags of confusion() cells, by name among equals: the rows of the square table."""
    gold = cells.groupBy("gold").agg(F.sum("cnt").alias("cnt"))
    return [r.gold for r in most_common(gold, n, "gold").collect()]


def weakest(rows: DataFrame, least_gold: int = 20, n: int = 8) -> DataFrame:
    """Of confusion_rows(), the n tags of the lowest F1 that have enough gold words."""
    return rows.where(F.col("n_gold") >= least_gold).orderBy("f1", "tag").limit(n)


def examples(rows: DataFrame, group: str, order: Column, n: int = 3) -> DataFrame:
    """The first n rows of each group in the order given."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")


def draw(rows: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, by the order of a hash of the key; all of them where there are not more."""
    return rows.orderBy(F.md5(F.concat_ws("|", *key, F.lit(str(seed)))), *key).limit(n)


def unreachable(strings: DataFrame, vocab: DataFrame, longest: int = 20) -> DataFrame:
    """(chars, missing): the words given for sample strings that the vocabulary does not hold or that are too long to be tried."""
    each = strings.select("chars", F.explode(F.split("words", " ")).alias("word")).where("word <> ''")
    lost = each.join(vocab.select("word").where(F.length("word") <= longest), "word", "left_anti")
    return lost.groupBy("chars").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("missing"))


def percent(share: Column, places: int = 2) -> Column:
    """0.9561 as 95.61%."""
    return F.format_string(f"%.{places}f%%", 100 * share)


def latency(times: DataFrame, column: str = "ms") -> DataFrame:
    """One row: n, mean, p95 (nearest rank) and max of a column of times."""
    rank = W.orderBy("ms")
    n, mean, top = times.agg(F.count(column), F.avg(column), F.max(column)).first()
    counts = times.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("ms")).agg(F.count("*").alias("c"))
    upto = counts.select("ms", F.sum("c").over(rank.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    p95 = upto.where(F.col("upto") > F.lit(round(0.95 * (n - 1)) if n else 0)).agg(F.min("ms")).first()[0]
    return times.sparkSession.createDataFrame([(n, mean, p95, top)], "n long, mean_ms double, p95_ms double, max_ms double")


def highlighted(before: Column, after: Column, left: str = "[", right: str = "]") -> Column:
    """The words of `after` (arrays of the same places) with changed ones between marks."""
    marked = F.zip_with(before, after, lambda b, a: F.when(b.eqNullSafe(a), a).otherwise(F.concat(F.lit(left), F.coalesce(a, F.lit("")), F.lit(right))))
    return F.array_join(marked, " ")


def changes(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, pos from 1, old, new) of the places at which two arrays differ."""
    each = rows.select(key, F.posexplode(F.arrays_zip(F.col(before).alias("old"), F.col(after).alias("new"))).alias("at", "x"))
    return each.where(~F.col("x.old").eqNullSafe(F.col("x.new"))).select(key, (F.col("at") + 1).alias("pos"), "x.old", "x.new")


def sampled_lengths(sentences: DataFrame, n: int, shortest: int = 3, longest: int = 25, seed: int = 42) -> DataFrame:
    """n sentences (id, words) of a length that is parsed, drawn by a hash of the id."""
    return draw(sentences.where(F.size("words").between(shortest, longest)), n, "id", seed=seed)
