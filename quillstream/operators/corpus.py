"""Documents as tokens, sentences, words, spans and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.edits import keyed_number
from ..functions.text import clean_word, ends_sentence, split_words


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos from 1, token, clean)."""
    cut = docs.select("doc_id", F.posexplode(split_words(F.col("text"))).alias("at", "token"))
    return cut.select("doc_id", (F.col("at") + 1).alias("pos"), "token", clean_word(F.col("token")).alias("clean"))


#: Bytes of a table that one task reads, about; files of up to twice this are taken as they are if there is one a core.
TASK_BYTES = 16 << 20


def _spread(docs: DataFrame) -> DataFrame:
    """A table dealt out in tasks of a bounded size, unless its files are small already: a file may be one row group, whatever
    its size, and a task cannot read less.  Only the plan's statistics and the number of files are asked."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = len(docs.inputFiles())
    if not files or files >= cores and size <= files * 2 * TASK_BYTES:
        return docs  # rows made in memory have no size that is known
    return docs.repartition(max(cores, size // TASK_BYTES))


def _sentence_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, sent from 0, first, tokens): a sentence ends after a token that closes one; `first` is its first pos.

    Sentences are cut inside the row, so that no token is shuffled to be numbered."""
    cut = _spread(docs.select("doc_id", "text")).select("doc_id", split_words(F.col("text")).alias("t")).where(F.size("t") > 0)
    ends = F.filter(F.transform("t", lambda x, k: F.when(ends_sentence(x), k + 1)), lambda x: x.isNotNull())
    cut = cut.select("doc_id", "t", F.array_union(ends, F.array(F.size("t"))).alias("ends"))
    each = F.transform("ends", lambda stop, k: F.struct((F.when(k == 0, 0).otherwise(F.get("ends", k - 1)) + 1).alias("first"), stop.alias("last")))
    cut = cut.select("doc_id", "t", each.alias("each"))
    cut = cut.select("doc_id", F.posexplode(F.transform("each", lambda x: F.struct(x["first"].alias("first"), F.slice("t", x["first"], x["last"] - x["first"] + 1).alias("tokens")))).alias("sent", "s"))
    return cut.select("doc_id", F.col("sent").cast("long").alias("sent"), "s.first", "s.tokens")


def sentences(docs: DataFrame) -> DataFrame:
    """tokens() with `sent`, from 0: a sentence ends after a token that closes one."""
    each = _sentence_rows(docs).select("doc_id", "sent", "first", F.posexplode("tokens").alias("at", "token"))
    return each.select("doc_id", (F.col("first") + F.col("at")).alias("pos"), "token", clean_word(F.col("token")).alias("clean"), "sent")


def word_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, words): the cleaned words of every sentence that has any, as an array; tokens without a letter are left out."""
    clean = F.regexp_replace(F.lower(F.array_join("tokens", " ")), "[^\\p{L} ]+", "")  # clean_word() of all tokens at once
    clean = F.filter(F.split(clean, " "), lambda x: x != "")
    return _sentence_rows(docs).select("doc_id", "sent", clean.alias("words")).where(F.size("words") > 0)


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, i from 1, word): word_rows(), a row a word."""
    each = word_rows(docs).select("doc_id", "sent", F.posexplode("words").alias("at", "word"))
    return each.select("doc_id", "sent", (F.col("at") + 1).cast("long").alias("i"), "word")


def rows_of(w: DataFrame) -> DataFrame:
    """words() put together again as word_rows(), which shuffles; word_rows() stay as they are."""
    if "words" in w.columns:
        return w
    items = F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])
    return w.groupBy("doc_id", "sent").agg(items.alias("words"))


_GAP = "\u0001"


def distinct_rows(w: DataFrame) -> DataFrame:
    """(line, n): every different sentence of word_rows(), its words joined by a sign that no word holds, with its number."""
    return w.select(F.array_join("words", _GAP).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


def line_words(line: Column) -> Column:
    """The words of a line of distinct_rows()."""
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, _GAP))


def vocabulary(w: DataFrame) -> DataFrame:
    """(word, cnt) of words(), word_rows() or distinct_rows()."""
    if "line" in w.columns:
        return w.select("n", F.explode(line_words(F.col("line"))).alias("word")).groupBy("word").agg(F.sum("n").alias("cnt"))
    if "words" in w.columns:
        w = w.select(F.explode("words").alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("cnt"))


def spans(w: DataFrame) -> DataFrame:
    """words() with half-open character ranges in the sentence written without blanks."""
    upto = W.partitionBy("doc_id", "sent").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.length("word")).over(upto)
    return w.withColumn("span_end", end).withColumn("span_start", F.col("span_end") - F.length("word"))


def ranked_by_key(df: DataFrame, groups: list[str], key: Column) -> DataFrame:
    """Adds `rank` and `n` inside each group in the order of md5(key).

    The groups are cut by the first two digits of the digest, so that a group of any size is
    ranked by 256 tasks: the rows of earlier cuts are counted, and rows are ranked inside a cut.
    """
    keyed = df.withColumn("_digest", F.md5(key.cast("string"))).withColumn("_cut", F.substring("_digest", 1, 2))
    sizes = keyed.groupBy(*groups, "_cut").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*groups).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*groups, "_cut", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(W.partitionBy(*groups)).alias("n"))
    inside = F.row_number().over(W.partitionBy(*groups, "_cut").orderBy("_digest"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    joined = keyed.withColumn("_inside", inside).alias("a").join(sizes.alias("b"), [F.col("a._cut") == F.col("b._cut"), *same])
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("b._before") + F.col("a._inside")).alias("rank"), F.col("b.n").alias("n"))


def stratified_split(docs: DataFrame, group: str = "source", fractions: tuple[float, float] = (0.8, 0.9)) -> DataFrame:
    """Adds `split`: train, dev or test, of exact sizes in each group, members drawn by a hash of the id."""
    ranked = ranked_by_key(docs, [group], F.col("doc_id"))
    train, dev = (F.floor(F.col("n") * f) for f in fractions)
    return ranked.withColumn("split", F.when(F.col("rank") <= train, "train").when(F.col("rank") <= dev, "dev").otherwise("test")).drop("rank", "n")


def joins_before(share: float, place: Column) -> Column:
    """Whether the word at a place (from 1) of a sentence is joined to the one before."""
    return (place > 1) & (keyed_number(F.col("doc_id"), F.col("sent"), place) < int(share * (1 << 28)))


def inject_merges(w: DataFrame, share: float = 0.08) -> DataFrame:
    """(doc_id, sent, k, token, merged): each word after the first is joined to the one before with the given probability.

    word_rows() are cut inside the row; words() are put together first."""
    joint = "\u0002"
    marked = F.transform("words", lambda x, i: F.concat(F.when(i == 0, "").when(joins_before(share, (i + 1).cast("long")), joint).otherwise(_GAP), x))
    tokens = rows_of(w).select("doc_id", "sent", F.posexplode(F.split(F.array_join(marked, ""), _GAP)).alias("at", "t"))
    token = F.replace("t", F.lit(joint), F.lit(""))
    return tokens.select("doc_id", "sent", (F.col("at") + 1).cast("long").alias("k"), token.alias("token"), (F.length("t") - F.length(token) + 1).cast("long").alias("merged"))


def length_at(w: DataFrame, share: float) -> DataFrame:
    """One row: the length of the word at rank min(n, floor(n * share) + 1) of all word tokens by length (the longest if share is 1).

    Lengths are counted first, so what is ordered is one row a length."""
    counts = w.groupBy(F.length("word").cast("long").alias("length")).agg(F.count("*").alias("cnt"))
    upto = counts.select("length", F.sum("cnt").over(W.orderBy("length").rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("cnt").over(W.partitionBy()).alias("n"))
    return upto.where(F.col("upto") >= F.least(F.col("n"), F.floor(F.col("n") * share) + 1)).agg(F.coalesce(F.min("length"), F.lit(0)).alias("length"))


def corpus_profile(docs: DataFrame) -> DataFrame:
    """For each split: documents, sentences, tokens, distinct words, and tokens and share unknown to train."""
    split = stratified_split(docs.select("doc_id", "source")).select("doc_id", "split")
    rows = word_rows(docs).join(split, "doc_id").persist()  # read by both counts
    # The counts of a word in the three splits side by side, so that all words are grouped once.
    each = rows.select("split", F.explode("words").alias("word")).groupBy("word", "split").agg(F.count("*").alias("cnt"))
    known = F.coalesce(F.sum(F.when(F.col("split") == "train", F.col("cnt"))), F.lit(0)) > 0
    by_word = each.groupBy("word").agg(known.alias("known"), F.collect_list(F.struct("split", "cnt")).alias("in")).select("known", F.inline("in"))
    counts = by_word.groupBy("split").agg(F.sum("cnt").alias("n_tokens"), F.count("*").alias("n_types"), F.sum(F.when(~F.col("known"), F.col("cnt")).otherwise(0)).alias("n_unknown"))
    sents = rows.groupBy("split", "doc_id").agg(F.countDistinct("sent").alias("s")).groupBy("split").agg(F.count("*").alias("n_docs"), F.sum("s").alias("n_sentences"))
    return counts.join(sents, "split").withColumn("unknown_rate", F.round(F.col("n_unknown") / F.col("n_tokens"), 6))
