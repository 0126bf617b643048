"""Tags, features, heads and trees as pure functions of the words, for text that nobody has annotated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tag_of(word: Column, before: Column) -> Column:
    """The tag of a word after a word of so many letters (0: none)."""
    n, last = F.length(word), F.substring(word, -1, 1)
    return (
        F.when(n <= 2, "DET").when(last.isin(*"aeiou"), F.when(before <= 2, "NOUN").otherwise("VERB"))
        .when(last.isin(*"nrt"), F.when(before <= 3, "ADJ").otherwise("ADV")).otherwise("NOUN")
    )


def _morph(word: Column, tag: Column) -> tuple[Column, Column, Column]:
    """The gender and the number of a word, and its tag with both."""
    last = F.substring(word, -1, 1)
    gender = F.when(last.isin("a", "e", "t"), "Fem").when(last.isin("o", "n", "r"), "Masc")
    number = F.when(F.endswith(word, F.lit("s")), "Plur").otherwise("Sing")
    return gender, number, F.concat_ws("-", tag, gender, F.when(number == "Plur", "Pl").otherwise("Sg"))


def tagged(w: DataFrame) -> DataFrame:
    """words() with `tag`, `features` and `morph`: from a word's length and last letter, and the length of the word before.

    The words of word_rows() get theirs inside the row, so that no token is shuffled."""
    if "words" in w.columns:
        before = F.concat(F.array(F.lit("")), F.slice("words", F.lit(1), F.size("words") - 1))
        each = w.select("doc_id", "sent", F.posexplode(F.arrays_zip(F.col("words").alias("word"), before.alias("before"))).alias("at", "x"))
        w = each.select("doc_id", "sent", (F.col("at") + 1).cast("long").alias("i"), "x.word", F.length("x.before").alias("_before"))
        tag = tag_of(F.col("word"), F.col("_before"))
    else:
        tag = tag_of(F.col("word"), F.coalesce(F.lag(F.length("word")).over(W.partitionBy("doc_id", "sent").orderBy("i")), F.lit(0)))
    gender, number, morph = _morph(F.col("word"), F.col("tag"))
    entries = F.filter(F.array(F.struct(F.lit("Gender").alias("k"), gender.alias("v")), F.struct(F.lit("Number").alias("k"), number.alias("v"))), lambda e: e["v"].isNotNull())
    return w.withColumn("tag", tag).withColumn("features", F.map_from_entries(entries)).withColumn("morph", morph).drop("_before")


def _length_at(i: Column) -> Column:
    """The length of the word at a place of `words`, 0 outside of them."""
    return F.when(i < 0, 0).otherwise(F.coalesce(F.length(F.get("words", i)), F.lit(0)))


def tagged_rows(rows: DataFrame, morph: bool = False) -> DataFrame:
    """(doc_id, sent, words, tags) of word_rows(): tagged(), a row a sentence; with `morph`, the tags with their features."""
    tags = F.transform("words", lambda w, i: tag_of(w, _length_at(i - 1)))
    rows = rows.select("doc_id", "sent", "words", tags.alias("tags"))
    return rows.withColumn("tags", F.zip_with("words", "tags", lambda w, t: _morph(w, t)[2])) if morph else rows


def tree_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, sent, tags, heads, deprels) of word_rows(): with_heads(tagged()), a row a sentence."""
    heads = F.transform("words", lambda w, i: F.when(_length_at(i + 1) > F.length(w), i + 2).otherwise(0))
    return tagged_rows(rows).select("doc_id", "sent", "tags", heads.alias("heads"), F.transform("tags", lambda t: F.lower(t)).alias("deprels"))


def with_heads(t: DataFrame) -> DataFrame:
    """Adds head (the next word if it is longer, else the root) and deprel, which make a projective tree."""
    place = W.partitionBy("doc_id", "sent").orderBy("i")
    longer = F.coalesce(F.lead(F.length("word")).over(place) > F.length("word"), F.lit(False))
    return t.withColumn("head", F.when(longer, F.col("i") + 1).otherwise(0)).withColumn("deprel", F.lower("tag"))


def flat_trees(t: DataFrame) -> DataFrame:
    """(doc_id, sent, tree): each sentence as S over its tagged words."""
    leaf = F.format_string("(%s %s)", "tag", "word")
    items = F.transform(F.array_sort(F.collect_list(F.struct("i", leaf.alias("leaf")))), lambda x: x["leaf"])
    return t.groupBy("doc_id", "sent").agg(F.concat(F.lit("(S "), F.array_join(items, " "), F.lit(")")).alias("tree"))


def flat_tree_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, sent, tree): flat_trees() of word_rows(), made inside the row."""
    leaves = F.transform("words", lambda w, i: F.concat(F.lit("("), tag_of(w, _length_at(i - 1)), F.lit(" "), w, F.lit(")")))
    return rows.select("doc_id", "sent", F.concat(F.lit("(S "), F.array_join(leaves, " "), F.lit(")")).alias("tree"))
