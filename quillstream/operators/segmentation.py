"""Segmentation of text written without blanks: greedy, and by a language model; and its scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ngrams import BEGIN, END, FEW, UNKNOWN, NgramModel, among, char_bigrams


@dataclass(frozen=True)
class DecoderConfig:
    """longest word tried; beam width (None: exact); penalty for each unknown word; known words only."""

    max_word_len: int = 20
    beam_width: int | None = 12
    unk_penalty: float = 0.0
    restrict_to_vocab: bool = False

    def replace(self, **changes) -> DecoderConfig:
        return replace(self, **changes)


def greedy(strings: DataFrame, vocab: DataFrame, longest: int = 20) -> DataFrame:
    """(chars, words): the longest vocabulary word at each place, else one character; the words joined by blanks.

    Substrings meet the vocabulary in a join; the walk is a fold over an array."""
    distinct = strings.select("chars").distinct()
    n = F.length("chars")
    at = distinct.where("chars <> ''").select("chars", F.explode(F.sequence(F.lit(1), n)).alias("at"))
    parts = at.select("chars", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("at") + 1))).alias("size"))
    found = parts.withColumn("word", F.substring("chars", F.col("at"), F.col("size"))).join(vocab.select("word"), "word", "left_semi")
    reach = found.groupBy("chars", "at").agg(F.max("size").alias("size"))
    longest_at = reach.groupBy("chars").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("sizes"))
    rows = distinct.join(longest_at, "chars", "left").withColumn("sizes", F.coalesce("sizes", F.create_map().cast("map<int,int>")))
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("out"))

    def step(s, i):
        size = F.coalesce(F.try_element_at(F.col("sizes"), i), F.lit(1))
        word = F.substring(F.col("chars"), i, size)
        return F.when(s["next"] == i, F.struct((i + size).alias("next"), F.concat(s["out"], F.when(i > 1, " ").otherwise(""), word).alias("out"))).otherwise(s)

    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step)
    return rows.select("chars", F.when(n > 0, walk["out"]).otherwise("").alias("words"))


class LocalModel:
    """The part of a model that some strings need, as dictionaries."""

    def __init__(self, model: NgramModel, grams: dict, totals: dict, chars: dict, char_totals: dict, alphabet: int, known: set, n_all: int, v: int):
        self.order, self.k, self.grams, self.totals, self.chars, self.char_totals = model.order, model.k, grams, totals, chars, char_totals
        self.alphabet, self.known, self.n_all, self.v = alphabet, known, n_all, v

    def probability(self, word: str, history: tuple[str, ...]) -> float:
        """Witten-Bell; the history has the nearest word last."""
        word = word if word in self.known or word == END else UNKNOWN
        history = tuple(h if h in self.known or h == BEGIN else UNKNOWN for h in history)[-(self.order - 1) :]
        p = (self.grams.get((word,), 0) + self.k) / (self.n_all + self.k * self.v)
        for n in range(1, len(history) + 1):
            context = history[-n:]
            total, types = self.totals.get(context, (0, 0))
            if total:
                p = (self.grams.get((*context, word), 0) + types * p) / (total + types)
        return p

    def spelling(self, word: str) -> float:
        marked = [BEGIN, *word, END]
        return sum(math.log((self.chars.get((a, b), 0) + 0.1) / (self.char_totals.get(a, 0) + 0.1 * self.alphabet)) for a, b in zip(marked, marked[1:], strict=False))

    def logprob(self, word: str, history: tuple[str, ...]) -> float:
        out = math.log(self.probability(word, history))
        return out if word in self.known or word == END else out + self.spelling(word)

    def sentence(self, words: list[str]) -> float:
        history, out = (BEGIN,) * (self.order - 1), 0.0
        for w in [*words, END]:
            out += self.logprob(w, history)
            history = (*history, w)[-(self.order - 1) :]
        return out


@dataclass
class _Ends:
    """The ways in which a word can end at one place: for each, the last order-1 words, the score, and whence it came."""

    tails: list[tuple[str, ...]]
    scores: list[float]
    links: list[tuple[int, int] | None]  # (place, index there)

    def best(self, width: int | None) -> list[int]:
        """The indexes of the best ways, best first, earlier ones first among equals; all of them, as they are, without a width."""
        return sorted(range(len(self.scores)), key=self.scores.__getitem__, reverse=True)[:width] if width else list(range(len(self.scores)))


def decode(chars: str, model: LocalModel, config: DecoderConfig = DecoderConfig()) -> list[str]:
    """The most probable words of a string; equal scores go to the split whose last word begins first.

    best(j, tail) = max over i < j and heads of best(i, head) + log P(chars[i:j] | head): the places are filled from left to
    right, each from the places up to a longest word before it, of which the beam keeps the best ways."""
    keep = model.order - 1
    places = [_Ends([(BEGIN,) * keep], [0.0], [None])]
    kept = [[0]]
    for j in range(1, len(chars) + 1):
        found: dict[tuple[str, ...], tuple[float, tuple[int, int]]] = {}
        for i in range(max(0, j - config.max_word_len), j):
            word = chars[i:j]
            is_known = word in model.known
            if not kept[i] or config.restrict_to_vocab and not is_known:
                continue
            cost = 0.0 if is_known else config.unk_penalty
            seen: dict[tuple[str, ...], float] = {}  # by what the model sees of the head
            for at in kept[i]:
                head = places[i].tails[at]
                if head not in seen:
                    seen[head] = model.logprob(word, head) + cost
                score, tail = places[i].scores[at] + seen[head], (*head[1:], word) if keep else ()
                if tail not in found or found[tail][0] < score:
                    found[tail] = score, (i, at)
        ends = _Ends(list(found), [x[0] for x in found.values()], [x[1] for x in found.values()])
        places.append(ends)
        kept.append(ends.best(config.beam_width))
    last = places[-1]
    if len(places) == 1:
        return []
    if not last.scores:
        return [chars]
    at = max(range(len(last.scores)), key=lambda k: last.scores[k] + model.logprob(END, last.tails[k]))
    words, j = [], len(chars)
    while (link := places[j].links[at]) is not None:
        words.append(chars[link[0] : j])
        j, at = link
    return words[::-1]


#: N-grams that one local model may hold; more strings than that allows are decoded in several passes.
MAX_NGRAMS = 2_000_000


def neighbours(strings: DataFrame, known: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """The known words that strings contain, (word), and the pairs (h1, word) that may stand side by side in a split of one of them:
    known words, <unk> for all others, and the marks of both ends."""
    n = F.length("chars")
    at = strings.where("chars <> ''").select("chars", F.explode(F.sequence(F.lit(1), n)).alias("start"))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("start") + 1))).alias("size")
    pieces = at.select("chars", "start", size).withColumn("word", F.substring("chars", F.col("start"), F.col("size")))
    needed = among(known, pieces.select("word"), ["word"]).persist()
    found = among(pieces, needed, ["word"]).persist()
    begins = found.select("chars", F.col("start").alias("place"), "word").union(at.select("chars", "start", F.lit(UNKNOWN)))
    begins = begins.union(strings.select("chars", n + 1, F.lit(END))).distinct()
    ends = found.select("chars", (F.col("start") + F.col("size")).alias("place"), F.col("word").alias("h1")).union(at.select("chars", F.col("start") + 1, F.lit(UNKNOWN)))
    ends = ends.union(strings.select("chars", F.lit(1), F.lit(BEGIN))).distinct()
    marks = strings.sparkSession.createDataFrame([(BEGIN, BEGIN), (BEGIN, UNKNOWN), (UNKNOWN, END)], "h1 string, word string")
    return needed, ends.join(begins, ["chars", "place"]).select("h1", "word").union(marks).distinct().persist()


def local_models(strings: DataFrame, train: DataFrame, order: int = 3, longest: int = 20, limit: int = MAX_NGRAMS) -> Iterator[tuple[DataFrame, LocalModel]]:
    """The distinct strings in parts, each with the model restricted to n-grams of words that may be neighbours in its strings.

    The size is counted before a part is collected; a part that would be too large is halved."""
    model = NgramModel(train, order)
    letters = char_bigrams(model.vocab).persist()
    char_totals = {r.prev: r.t for r in letters.groupBy("prev").agg(F.sum("cnt").alias("t")).collect()}  # one row a character
    chars = {(r.prev, r.ch): r.cnt for r in letters.collect()}  # at most the square of the alphabet
    alphabet = len({b for _, b in chars} - {END}) + 1
    n_all, v = model.size.first()
    cores = strings.sparkSession.sparkContext.defaultParallelism
    todo = [strings.select("chars").distinct().withColumn("h", F.xxhash64("chars")).repartition(cores, "h").persist()]
    while todo:
        part = todo.pop()
        needed, pairs = neighbours(part.select("chars"), model.known, longest)
        marks = strings.sparkSession.createDataFrame([(x,) for x in (BEGIN, END, UNKNOWN)], "word string")
        tables = []
        for k in range(1, order + 1):
            names = [*(f"h{i}" for i in range(k - 1, 0, -1)), "word"]
            if k == 1:
                tables.append((names, among(model.gram[1], needed.union(marks), ["word"]).withColumns({"total": F.lit(None), "types": F.lit(None)}).persist()))
                continue
            g = model.gram[k]
            # The context's neighbours must be pairs; its totals count all words that follow.
            if k == 2:
                g = among(g, pairs.select("h1"), ["h1"])
            for left, right in zip(names[:-2], names[1:-1], strict=True):
                g = among(g, pairs.select(F.col("h1").alias(left), F.col("word").alias(right)), [left, right])
            follows = pairs.select("h1", "word", F.lit(True).alias("asked"))
            g = g.join(F.broadcast(follows) if pairs.count() <= FEW else follows, ["h1", "word"], "left")
            after = F.collect_list(F.when(F.col("asked"), F.struct("word", "cnt")))
            tables.append((names, g.groupBy(*names[:-1]).agg(F.sum("cnt").alias("total"), F.count("*").alias("types"), after.alias("after")).persist()))
        size = sum(g.count() if len(names) == 1 else g.agg(F.coalesce(F.sum(F.size("after") + 1), F.lit(0))).first()[0] for names, g in tables)
        if size > limit and part.count() > 1:
            todo += [part.where(F.col("h") % 2 == k).withColumn("h", F.shiftright("h", 1)) for k in (0, 1, -1)]
            continue
        grams, totals = {}, {}
        for names, g in tables:
            for r in g.toLocalIterator():
                context = tuple(r[c] for c in names[:-1])
                if not context:
                    grams[r.word,] = r.cnt
                    continue
                totals[context] = (r.total, r.types)
                for x in r.after:
                    grams[*context, x.word] = x.cnt
        yield part.select("chars"), LocalModel(model, grams, totals, chars, char_totals, alphabet, {r.word for r in needed.collect()}, n_all, v)


def segment(strings: DataFrame, train: DataFrame, config: DecoderConfig = DecoderConfig(), order: int = 3) -> DataFrame:
    """(chars, words, score, single_score): the best words of each distinct string, joined by blanks; the log-probability of the split, and
    of the string as one word, whose end is seen after that word alone."""
    schema = "chars string, words string, score double, single_score double"
    out = strings.sparkSession.createDataFrame([], schema)
    for part, model in local_models(strings, train, order, config.max_word_len):
        shared = strings.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = shared.value
            for batch in batches:
                words = [decode(c, m, config) for c in batch["chars"]]
                single = [m.logprob(c, (BEGIN,) * (m.order - 1)) + m.logprob(END, (c,)) if c else 0.0 for c in batch["chars"]]
                yield pd.DataFrame({"chars": batch["chars"], "words": [" ".join(x) for x in words], "score": [m.sentence(x) if x else 0.0 for x in words], "single_score": single})

        out = out.union(part.mapInPandas(run, schema))
    return out


def word_spans(segmented: DataFrame) -> DataFrame:
    """(chars, word, span_start, span_end) of rows (chars, words)."""
    each = segmented.where("words <> ''").select("chars", F.posexplode(F.split("words", " ")).alias("i", "word"))
    end = F.sum(F.length("word")).over(W.partitionBy("chars").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return each.select("chars", "i", "word", (end - F.length("word")).alias("span_start"), end.alias("span_end"))


def segmentation_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row from spans (key, span_start, span_end) on both sides: words found, precision, recall, F1 of words and of inner boundaries, exact keys."""
    spans = ["key", "span_start", "span_end"]
    matched = gold.select(spans).join(predicted.select(spans), spans)

    def inner(df: DataFrame) -> DataFrame:
        last = F.max("span_end").over(W.partitionBy("key"))
        return df.withColumn("last", last).where("span_end < last").select("key", "span_end")

    bg, bp = inner(gold), inner(predicted)
    per = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    keys = per(gold, "g").join(per(predicted, "p"), "key", "full").join(per(matched, "m"), "key", "left")
    keys = keys.join(per(bg, "bg"), "key", "left").join(per(bp, "bp"), "key", "left").join(per(bg.join(bp, ["key", "span_end"]), "bm"), "key", "left").fillna(0)
    total = keys.agg(*(F.sum(c).alias(c) for c in ("g", "p", "m", "bg", "bp", "bm")), F.count("*").alias("n_keys"), F.count_if((F.col("g") == F.col("p")) & (F.col("g") == F.col("m"))).alias("n_exact"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = lambda m, g, p: F.round(ratio(2 * F.col(m), F.col(g) + F.col(p)), 6)
    return total.select(
        F.col("g").alias("n_gold"), F.col("p").alias("n_pred"), F.col("m").alias("n_matched"), F.round(ratio(F.col("m"), F.col("p")), 6).alias("precision"),
        F.round(ratio(F.col("m"), F.col("g")), 6).alias("recall"), f1("m", "g", "p").alias("f1"), f1("bm", "bg", "bp").alias("boundary_f1"), "n_keys", "n_exact",
    )


def overlap_errors(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(key, gold_word, span_start, span_end, found): gold words that were lost, with the predicted words that overlap them."""
    spans = ["key", "span_start", "span_end"]
    lost = gold.join(predicted.select(spans), spans, "left_anti").alias("g")
    p = predicted.alias("p")
    touch = (F.col("g.key") == F.col("p.key")) & (F.col("p.span_start") < F.col("g.span_end")) & (F.col("p.span_end") > F.col("g.span_start"))
    pairs = lost.join(p, touch).select("g.key", F.col("g.word").alias("gold_word"), "g.span_start", "g.span_end", F.col("p.span_start").alias("s"), F.col("p.word").alias("w"))
    grouped = pairs.groupBy("key", "gold_word", "span_start", "span_end").agg(F.array_sort(F.collect_list(F.struct("s", "w"))).alias("x"))
    return grouped.select("key", "gold_word", "span_start", "span_end", F.array_join(F.transform("x", lambda x: x["w"]), " ").alias("found"))
