"""Spelling: candidates one edit away, non-word and real-word correction, and tests of both."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.edits import corrupt, edits1, keyed_number, lookup_keys, offered_keys, one_edit_apart, symdel_keys
from ..functions.text import match_case, split_words, token_parts
from .corpus import line_words, rows_of, vocabulary
from .ngrams import among

KINDS = ("deletion", "insertion", "replacement", "transposition")


def symdel_index(vocab: DataFrame) -> DataFrame:
    """(key, word): every word under itself and its deletions."""
    return vocab.select(F.explode(symdel_keys(F.col("word"))).alias("key"), "word")


def candidates_symdel(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, cand): vocabulary words equal to a query or one edit from it, by an equi-join on shared deletions."""
    asked = queries.select(F.col("query"), F.explode(symdel_keys(F.col("query"))).alias("key")).persist()
    pairs = asked.join(among(symdel_index(vocab), asked, ["key"]), "key").select("query", F.col("word").alias("cand")).distinct()
    return pairs.where(one_edit_apart(F.col("query"), F.col("cand")))


def candidates_edits(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, cand): vocabulary words among all a-z edits of a query, by enumeration."""
    return queries.select("query", F.explode(edits1(F.col("query"))).alias("cand")).join(vocab.select(F.col("word").alias("cand")), "cand").select("query", "cand")


def candidates(queries: DataFrame, vocab: DataFrame, method: str = "B") -> DataFrame:
    """The candidates of method A (enumeration), B (shared deletions) or both, without the query itself."""
    if method not in ("A", "B", "both"):
        raise ValueError(method)
    found = {"A": candidates_edits, "B": candidates_symdel}
    parts = [found[m](queries, vocab) for m in ("A", "B") if method in (m, "both")]
    union = parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct()
    return union.where("query <> cand")


def corrupted_words(w: DataFrame) -> DataFrame:
    """(doc_id, sent, i, kind, original, corrupted): from each sentence one word, with each kind of edit that can be made."""
    at = keyed_number(F.col("doc_id"), F.col("sent"), F.lit("word")) % F.size("words") + 1
    chosen = rows_of(w).select("doc_id", "sent", at.cast("long").alias("i"), F.element_at("words", at.cast("int")).alias("original"))
    # Keys are made by the explode, so that each is computed once and not wherever an edit refers to it.
    keyed = F.array(*(F.struct(F.lit(k).alias("kind"), keyed_number(F.col("doc_id"), F.col("sent"), F.lit(k)).alias("key")) for k in KINDS))
    each = chosen.select("doc_id", "sent", "i", "original", F.inline(keyed))
    return each.select("doc_id", "sent", "i", "kind", "original", corrupt(F.col("original"), F.col("kind"), F.col("key")).alias("corrupted")).where("corrupted <> ''")


def test_words(w: DataFrame, vocab: DataFrame, nonwords: bool = True) -> DataFrame:
    """corrupted_words() that left the vocabulary (or, for real-word errors, stay in it)."""
    return corrupted_words(w).join(vocab.select(F.col("word").alias("corrupted")), "corrupted", "left_anti" if nonwords else "left_semi")


def test_counts(w: DataFrame, vocab: DataFrame) -> DataFrame:
    """(kind, original, corrupted, n): the different non-words of test_words() with their number, counted before they are joined."""
    counts = corrupted_words(w).groupBy("kind", "original", "corrupted").agg(F.count("*").alias("n"))
    return counts.join(vocab.select(F.col("word").alias("corrupted")), "corrupted", "left_anti")


def benchmark_words(vocab: DataFrame, count: int = 1000) -> DataFrame:
    """(batch, original, word): `count` corrupted words that left the vocabulary, and `count` clean ones, by a keyed draw;
    fewer where the vocabulary does not give as many.  The size of a batch is what it is for."""
    key = keyed_number(F.col("word"), F.lit("batch"))
    words = vocab.select("word").persist()  # counted once; a filter on what is made of a word would else be put before the count, on every token
    drawn = words.select("word", key.alias("key"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("key") % len(KINDS) + 1).cast("int"))
    made = drawn.select("key", F.col("word").alias("original"), corrupt(F.col("word"), kind, F.col("key")).alias("word")).where("word <> ''")
    made = made.join(words, "word", "left_anti")
    foul = made.orderBy("key", "original").limit(count).select(F.lit("corrupted").alias("batch"), "original", "word")
    clean = drawn.orderBy("key", "word").limit(count).select(F.lit("clean").alias("batch"), F.col("word").alias("original"), "word")
    return foul.union(clean)


def best_by_count(cands: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, corrected): the most frequent candidate, the first in the alphabet among equals."""
    ranked = cands.join(vocab.withColumnRenamed("word", "cand"), "cand")
    return ranked.groupBy("query").agg(F.min(F.struct((-F.col("cnt")).alias("order"), "cand"))["cand"].alias("corrected"))


def best_of_deletions(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """best_by_count() of candidates_symdel(), without its pairs: a key holds the place of its deletion, so that all words under it are
    one edit from who asks for it, and only the best of them is joined.  The work does not grow with the words that share
    a key.  Of queries that are no words of the vocabulary."""
    order = F.struct((-F.col("cnt")).alias("order"), F.col("word").alias("cand"))
    offered = vocab.select("word", "cnt", F.explode(offered_keys(F.col("word"))).alias("key")).groupBy("key").agg(F.min(order).alias("top"))
    asked = queries.select("query", F.explode(lookup_keys(F.col("query"))).alias("key"))
    return asked.join(offered, "key").groupBy("query").agg(F.min("top")["cand"].alias("corrected"))


def correct_nonwords(tests: DataFrame, vocab: DataFrame, method: str = "B") -> DataFrame:
    """tests with `corrected` (the word itself if there is no candidate) and `is_right`; each distinct word is corrected once."""
    asked = tests.select(F.col("corrupted").alias("query")).distinct().join(vocab.select(F.col("word").alias("query")), "query", "left_anti")
    best = best_of_deletions(asked, vocab) if method == "B" else best_by_count(candidates(asked, vocab, method), vocab)
    fixed = tests.join(best.withColumnRenamed("query", "corrupted"), "corrupted", "left").withColumn("corrected", F.coalesce("corrected", "corrupted"))
    return fixed.withColumn("is_right", F.col("corrected") == F.col("original"))


def bigram_counts(w: DataFrame) -> DataFrame:
    """(w1, w2, cnt) of neighbours inside a sentence, of words(), word_rows() or distinct_rows()."""
    if "line" in w.columns:
        w = w.select(line_words(F.col("line")).alias("words"), "n")
    if "words" in w.columns:
        less = F.size("words") - 1
        pair = F.arrays_zip(F.slice("words", F.lit(1), less).alias("w1"), F.slice("words", F.lit(2), less).alias("w2"))
        each = w.where(F.size("words") > 1).select(F.col("n") if "n" in w.columns else F.lit(1).cast("long").alias("n"), F.inline(pair).alias("w1", "w2"))
        return each.groupBy("w1", "w2").agg(F.sum("n").alias("cnt"))
    pairs = w.select(F.col("word").alias("w1"), F.lead("word").over(W.partitionBy("doc_id", "sent").orderBy("i")).alias("w2"))
    return pairs.where("w2 is not null").groupBy("w1", "w2").agg(F.count("*").alias("cnt"))


def pair_scores(pairs: DataFrame, vocab: DataFrame, bigrams: DataFrame, k: float = 1.0) -> DataFrame:
    """(w1, w2, logp): add-k bigram log-probability of the distinct pairs."""
    size = vocab.agg(F.count("*").alias("v"))
    pairs = pairs.select("w1", "w2").distinct().persist()
    joined = pairs.join(among(bigrams, pairs, ["w1", "w2"]), ["w1", "w2"], "left").join(vocab.select(F.col("word").alias("w1"), F.col("cnt").alias("c1")), "w1", "left")
    return joined.join(F.broadcast(size)).select(  # one row
        "w1", "w2", F.log((F.coalesce("cnt", F.lit(0)) + k) / (F.coalesce("c1", F.lit(0)) + k * F.col("v"))).alias("logp")
    )


def realword_scores(w: DataFrame, vocab: DataFrame, bigrams: DataFrame, k: float = 1.0) -> DataFrame:
    """(doc_id, sent, i, word, cand, score): every known word and its candidates with their context score, the sum of
    the bigram terms with the neighbours there are; null where there is no neighbour."""
    place = W.partitionBy("doc_id", "sent").orderBy("i")
    around = w.select("*", F.lag("word").over(place).alias("prev"), F.lead("word").over(place).alias("next")).join(vocab.select("word"), "word", "left_semi")
    pairs = candidates_symdel(around.select(F.col("word").alias("query")).distinct(), vocab).withColumnRenamed("query", "word")
    each = around.join(pairs, "word")
    asked = each.select(F.col("prev").alias("w1"), F.col("cand").alias("w2")).union(each.select("cand", "next")).dropna()
    scores = pair_scores(asked, vocab, bigrams, k).persist()  # read for both neighbours
    before = scores.select(F.col("w1").alias("prev"), F.col("w2").alias("cand"), F.col("logp").alias("before"))
    after = scores.select(F.col("w1").alias("cand"), F.col("w2").alias("next"), F.col("logp").alias("after"))
    joined = each.join(before, ["prev", "cand"], "left").join(after, ["cand", "next"], "left")
    score = F.when(F.col("prev").isNotNull() | F.col("next").isNotNull(), F.coalesce("before", F.lit(0.0)) + F.coalesce("after", F.lit(0.0)))
    return joined.select("doc_id", "sent", "i", "word", "cand", score.alias("score"))


def correct_realwords(scores: DataFrame, threshold: float = 1.1) -> DataFrame:
    """(doc_id, sent, i, word, own_score, best, best_score, corrected): the best other candidate replaces a word if it gains
    more than the threshold."""
    key = ["doc_id", "sent", "i", "word"]
    other = F.col("cand") != F.col("word")
    found = scores.groupBy(*key).agg(
        F.max(F.when(~other, F.col("score"))).alias("own_score"),
        F.min(F.when(other & F.col("score").isNotNull(), F.struct((-F.round("score", 9)).alias("order"), "cand", "score"))).alias("top"),
    )
    gain = F.round(F.col("top.score") - F.col("own_score"), 9) > threshold
    return found.select(*key, "own_score", F.col("top.cand").alias("best"), F.col("top.score").alias("best_score"), F.when(gain, F.col("top.cand")).otherwise(F.col("word")).alias("corrected"))


def create_corrector(train: DataFrame, method: str = "B", threshold: float = 1.1, k: float = 1.0) -> SpellingCorrector:
    """A corrector with the vocabulary and the neighbours of a corpus, words() or word_rows()."""
    return SpellingCorrector(vocabulary(train), bigram_counts(train), method, threshold, k)


@dataclass(frozen=True)
class SpellingCorrector:
    """Sentence correction: non-words first, then real words from left to right, each fix seen by the next."""

    vocab: DataFrame
    bigrams: DataFrame
    method: str = "B"
    threshold: float = 1.1
    k: float = 1.0

    def __post_init__(self):
        if self.method not in ("A", "B", "both"):
            raise ValueError(self.method)

    def correct(self, sentences: DataFrame) -> DataFrame:
        """(id, corrected, n_nonword, n_realword) of rows (id, text).

        Tokens that are not letters between marks stay as they are, and count as unknown neighbours.
        Candidates and pair scores are joined beforehand; only the fold over a sentence is Python."""
        cut = sentences.select("id", F.posexplode(split_words(F.col("text"))).alias("pos", "token"))
        cut = cut.withColumn("p", token_parts(F.col("token"))).withColumn("word", F.lower("p.core"))
        known = self.vocab.select("word", F.lit(True).alias("known"))
        asked = cut.where("word is not null").select(F.col("word").alias("query")).distinct()
        cands = candidates(asked, self.vocab, self.method)
        best = best_by_count(cands, self.vocab).withColumnRenamed("query", "word")
        first = cut.join(known, "word", "left").join(best, "word", "left")
        first = first.withColumn("now", F.when(F.col("known"), F.col("word")).otherwise(F.coalesce("corrected", "word")))
        again = first.select(F.col("now").alias("query")).where("query is not null").distinct().join(self.vocab.select(F.col("word").alias("query")), "query", "left_semi")
        options = candidates(again, self.vocab, self.method).groupBy("query").agg(F.sort_array(F.collect_list("cand")).alias("options")).withColumnRenamed("query", "now")
        rows = first.join(options, "now", "left").withColumn("options", F.coalesce("options", F.array().cast("array<string>")))
        gap = "\u0000"
        around = rows.select("id", "pos", F.concat(F.array(F.coalesce("now", F.lit(gap))), "options").alias("all"))
        pairs = around.alias("a").join(around.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("b.pos") == F.col("a.pos") + 1))
        pairs = pairs.select("a.id", F.explode("a.all").alias("w1"), F.col("b.all").alias("right")).select("id", "w1", F.explode("right").alias("w2")).distinct()
        scored = pairs.join(pair_scores(pairs, self.vocab, self.bigrams, self.k), ["w1", "w2"]).groupBy("id").agg(F.collect_list(F.struct("w1", "w2", "logp")).alias("pairs"))
        item = F.struct("pos", "token", F.col("p.leading").alias("leading"), F.col("p.core").alias("core"), F.col("p.trailing").alias("trailing"), "word", "now", "options")
        whole = rows.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items")).join(scored, "id", "left")
        threshold = self.threshold

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for ident, items, pairs in zip(batch["id"], batch["items"], batch["pairs"], strict=True):
                    logp = {(p["w1"], p["w2"]): p["logp"] for p in (pairs if pairs is not None else [])}
                    now = [x["now"] for x in items]
                    fixed = 0

                    def score(i: int, word: str, now=now, logp=logp) -> float | None:
                        terms = []
                        if i > 0:
                            terms.append(logp[now[i - 1] or gap, word])
                        if i + 1 < len(now):
                            terms.append(logp[word, now[i + 1] or gap])
                        return sum(terms) if terms else None

                    for i, x in enumerate(items):
                        if not len(x["options"]) or (own := score(i, now[i])) is None:
                            continue
                        top = min((-round(score(i, c), 9), c) for c in x["options"])
                        if round(-top[0] - own, 9) > threshold:
                            now[i] = top[1]
                            fixed += 1
                    out.append((ident, [n if n is not None else None for n in now], sum(x["now"] is not None and x["now"] != x["word"] for x in items), fixed))
                yield pd.DataFrame(out, columns=["id", "after", "n_nonword", "n_realword"])

        kind = sentences.schema["id"].dataType.simpleString()
        folded = whole.select("id", "items", "pairs").mapInPandas(fold, f"id {kind}, after array<string>, n_nonword long, n_realword long")
        final = rows.join(folded, "id").withColumn("new", F.try_element_at("after", (F.col("pos") + 1).cast("int")))
        text = F.when(F.col("p").isNull(), F.col("token")).otherwise(
            F.concat("p.leading", F.when(F.col("new") == F.col("word"), F.col("p.core")).otherwise(match_case(F.col("p.core"), F.col("new"))), "p.trailing")
        )
        done = final.groupBy("id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda s: s["t"]), " ").alias("corrected"),
            F.max("n_nonword").alias("n_nonword"), F.max("n_realword").alias("n_realword"),
        )
        return sentences.select("id").join(done, "id", "left").select("id", F.coalesce("corrected", F.lit("")).alias("corrected"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_nonword", "n_realword")))
