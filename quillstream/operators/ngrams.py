"""N-gram counts and language-model probabilities, as joins and aggregates."""

from __future__ import annotations

from collections import Counter
from copy import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asked import BEGIN, END, UNKNOWN, AskedCounts
from .corpus import distinct_rows, line_words, rows_of, vocabulary


def known_words(w: DataFrame, threshold: int = 1) -> DataFrame:
    """The words that occur more than `threshold` times."""
    return vocabulary(w).where(F.col("cnt") > threshold).select("word")


def closed(w: DataFrame, known: DataFrame) -> DataFrame:
    """words() with each unknown word as <unk>, and an end after every sentence."""
    marked = w.join(known.withColumn("is_known", F.lit(True)), "word", "left").select(
        "doc_id", "sent", "i", F.when(F.col("is_known"), F.col("word")).otherwise(UNKNOWN).alias("word")
    )
    ends = w.groupBy("doc_id", "sent").agg((F.max("i") + 1).alias("i")).withColumn("word", F.lit(END))
    return marked.unionByName(ends)


def histories(c: DataFrame, order: int = 3) -> DataFrame:
    """closed() with h1..h{order-1}: the words before, the nearest first."""
    place = W.partitionBy("doc_id", "sent").orderBy("i")
    return c.select("*", *(F.lag("word", k, BEGIN).over(place).alias(f"h{k}") for k in range(1, order)))


def raw_grams(rows: DataFrame, order: int) -> DataFrame:
    """(h{order-1}.., h1, word, cnt) of word_rows(), words as they are; cut inside the row, so that no token is shuffled alone."""
    times = F.col("n") if "n" in rows.columns else F.lit(1).cast("long")
    rows = rows.select(times.alias("n"), F.concat(F.array_repeat(F.lit(BEGIN), order - 1), "words", F.array(F.lit(END))).alias("m"))
    names = [*(f"h{k}" for k in range(order - 1, 0, -1)), "word"]
    # Shifted copies of the sentence side by side; those of the first words are as long as the last, which ends at the end.
    parts = F.arrays_zip(*(F.slice("m", F.lit(k + 1), F.size("m") - (order - 1)).alias(n) for k, n in enumerate(names)))
    return rows.select("n", F.inline(parts).alias(*names)).groupBy(*names).agg(F.sum("n").alias("cnt"))


def closed_counts(raw: DataFrame, known: DataFrame) -> DataFrame:
    """raw_grams() with each unknown word as <unk>: distinct n-grams are marked, and not tokens."""
    names = [c for c in raw.columns if c != "cnt"]
    for c in names:
        marked = raw.join(known.select(F.col("word").alias(c), F.lit(True).alias("is_known")), c, "left")
        raw = marked.withColumn(c, F.when(F.col("is_known") | F.col(c).isin(BEGIN, END), F.col(c)).otherwise(UNKNOWN)).drop("is_known")
    return raw.groupBy(*names).agg(F.sum("cnt").alias("cnt"))


def ngram_counts(h: DataFrame, order: int) -> DataFrame:
    """(h{order-1}.., h1, word, cnt) of one order; every n-gram ends on a word or an end."""
    return h.groupBy(*(f"h{k}" for k in range(order - 1, 0, -1)), "word").agg(F.count("*").alias("cnt"))


def context_tables(counts: DataFrame, order: int) -> DataFrame:
    """(context, total, types)."""
    context = [f"h{k}" for k in range(order - 1, 0, -1)]
    return counts.groupBy(*context).agg(F.sum("cnt").alias("total"), F.count("*").alias("types"))


def continuation_counts(counts: DataFrame, order: int) -> DataFrame:
    """Of n-grams of order-1, how many different words come before them, from counts of `order`."""
    return counts.groupBy(*(f"h{k}" for k in range(order - 2, 0, -1)), "word").agg(F.count("*").alias("cnt"))


def char_bigrams(w: DataFrame) -> DataFrame:
    """(prev, ch, cnt) over distinct words, with both ends marked."""
    chars = w.select("word").distinct().select(F.concat(F.array(F.lit(BEGIN)), F.split("word", ""), F.array(F.lit(END))).alias("c"))
    pair = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("prev"), F.element_at("c", i + 1).alias("ch")))
    return chars.select(F.explode(pair).alias("p")).groupBy("p.prev", "p.ch").agg(F.count("*").alias("cnt"))


def char_scores(w: DataFrame, bigrams: DataFrame, k: float = 0.1) -> DataFrame:
    """(word, char_logp) of the distinct words: add-k over character pairs, the end included."""
    totals = bigrams.groupBy("prev").agg(F.sum("cnt").alias("total"))
    size = bigrams.agg((F.countDistinct(F.when(F.col("ch") != END, F.col("ch"))) + 1).alias("v"))
    distinct = w.select("word").distinct()
    chars = distinct.select("word", F.concat(F.array(F.lit(BEGIN)), F.split("word", ""), F.array(F.lit(END))).alias("c"))
    pair = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("prev"), F.element_at("c", i + 1).alias("ch")))
    each = chars.select("word", F.explode(pair).alias("p")).select("word", "p.prev", "p.ch")
    scored = each.join(bigrams, ["prev", "ch"], "left").join(totals, "prev", "left").join(F.broadcast(size))  # size is one row
    logp = F.log((F.coalesce("cnt", F.lit(0)) + k) / (F.coalesce("total", F.lit(0)) + k * F.col("v")))
    return scored.groupBy("word").agg(F.sum(logp).alias("char_logp"))


#: Rows of a table that may be sent to every task, so that another is narrowed before it is shuffled.
FEW = 1 << 18


def among(df: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a table whose key is asked for; few keys are sent to the rows, before the rows are grouped or shuffled."""
    asked = asked.select(*on).distinct().persist()
    return df.join(F.broadcast(asked) if asked.count() <= FEW else asked, on, "left_semi")


class NgramModel:
    """Counts of a training corpus, words() or better word_rows(), and the probability of other text under a smoothing."""

    def __init__(self, train: DataFrame, order: int = 3, k: float = 0.01, discount: float = 0.75, threshold: int = 1):
        self.order, self.k, self.discount, self.threshold = order, k, discount, threshold
        self.train, self._counted, self._asked = rows_of(train), [], []
        # Different sentences, kept as text; n-grams are cut from them when they are asked for.
        self.rows = distinct_rows(self.train).persist()
        line = F.col("line")
        each = self.rows.select("n", F.xxhash64(line).alias("at"), F.explode(line_words(line)).alias("word"))
        self.vocab = each.groupBy("word").agg(F.sum("n").alias("cnt"), F.min("at").alias("at")).persist()
        self.known = self.vocab.where(F.col("cnt") > threshold).select("word")
        closed_rows = self._closed_rows()
        self.gram = {n: raw_grams(closed_rows, n) for n in range(2, order + 1)}
        ends = self.rows.agg(F.sum("n").alias("cnt")).select(F.lit(END).alias("word"), "cnt")
        rare = self.vocab.where(F.col("cnt") <= threshold).agg(F.sum("cnt").alias("cnt")).select(F.lit(UNKNOWN).alias("word"), "cnt")
        self.gram[1] = self.vocab.where(F.col("cnt") > threshold).select("word", "cnt").union(rare.union(ends).where(F.col("cnt") > 0))
        # One row: tokens, and the vocabulary with <unk> and </s>.
        self.size = self.gram[1].agg(F.sum("cnt").alias("n_all")).join(self.known.agg((F.count("*") + 2).alias("v")))

    def _closed_rows(self) -> DataFrame:
        """(words, n): the different sentences with each unknown word as <unk>.  A word that occurs once is in one sentence, whose hash
        the vocabulary holds, so that only these words are sent to their sentences; a clash of hashes marks nothing, as
        the other sentence does not hold the word."""
        line = F.col("line")
        if self.threshold < 1:
            return self.rows.select(line_words(line).alias("words"), "n")
        rare = self.vocab.where(F.col("cnt") <= self.threshold)
        if self.threshold > 1:
            each = self.rows.select(F.xxhash64(line).alias("at"), F.explode(line_words(line)).alias("word"))
            rare = each.join(rare.select("word"), "word")
        marks = rare.groupBy("at").agg(F.collect_set("word").alias("rare"))
        joined = self.rows.withColumn("at", F.xxhash64(line)).join(marks, "at", "left").select(line_words(line).alias("words"), "n", "rare")
        marked = F.transform("words", lambda x: F.when(F.array_contains("rare", x), UNKNOWN).otherwise(x))
        return joined.select(F.when(F.col("rare").isNull(), F.col("words")).otherwise(marked).alias("words"), "n")

    def keep(self) -> NgramModel:
        """The model with its highest order counted once and kept, where its tables are read several times over."""
        self.gram[self.order] = self.gram[self.order].persist()
        names = [*(f"h{k}" for k in range(self.order - 1, 0, -1)), "word"]
        for n in range(2, self.order):
            self.gram[n] = self.gram[self.order].groupBy(*names[self.order - n :]).agg(F.sum("cnt").alias("cnt"))
        return self

    def counted(self, *texts: DataFrame) -> tuple[AskedCounts | None, list[tuple]]:
        """What the training text says of all n-grams of the texts, counted in one pass, and their n-grams with `times`; none if they are
        more than a driver should hold.  Texts whose n-grams have been counted are not counted again."""
        if self.threshold > 1:
            return None, []
        for seen, *said in self._asked:
            if len(texts) == 1 and seen is texts[0]:
                return tuple(said)
        every = []
        for text in texts:
            every += map(tuple, raw_grams(rows_of(text), self.order).limit(FEW + 1).collect())
            if len(every) > FEW:
                return None, []
        grams = {g[:-1] for g in every}
        found = next((c for c in self._counted if grams <= c.grams), None)
        if found is None:
            self._counted.append(found := AskedCounts(self.train, grams, self.order, self.threshold))
        if len(texts) == 1:
            self._asked.append((texts[0], found, every))
        return found, every

    def with_k(self, k: float) -> NgramModel:
        """The same counts under another k."""
        other = copy(self)
        other.k = k
        return other

    def vocabulary(self, *texts: DataFrame) -> DataFrame:
        """(word, cnt) of the training text, from the pass that counts the n-grams of the texts."""
        found, _ = self.counted(*texts)
        return self.vocab.select("word", "cnt") if found is None else found.vocab

    def known_in(self, text: DataFrame) -> DataFrame:
        """The known words that a text holds."""
        found, every = self.counted(text)
        if found is None:
            return self._known_in(text)
        return text.sparkSession.createDataFrame([(w,) for w in sorted({w for g in every for w in g[:-1]} & found.known)], "word string")

    def _known_in(self, text: DataFrame) -> DataFrame:
        return among(self.known, vocabulary(text).select("word"), ["word"]).persist()

    def asked_grams(self, text: DataFrame) -> DataFrame:
        """The distinct n-grams of a text in the model's words, with `times`."""
        rows = rows_of(text)
        return closed_counts(raw_grams(rows, self.order), self._known_in(rows)).withColumnRenamed("cnt", "times").persist()

    def looked_up(self, text: DataFrame) -> DataFrame:
        """histories() of a text with c{n}, t{n}, d{n}: the count of the n-gram, its context's total and types.

        Counts are joined once for every distinct n-gram of the text, not once for every token; of the training text only
        n-grams in contexts of the text are counted, in one pass where they are few."""
        cols = [f"h{k}" for k in range(self.order - 1, 0, -1)]
        found, every = self.counted(text)
        if found is not None:
            return self._rows_of_counts(text, found, every)
        grams = asked = self.asked_grams(text)
        for n in range(1, self.order + 1):
            context = cols[self.order - n :]
            counts = among(self.gram[n], asked.select(*(context or ["word"])), context or ["word"]).persist()
            grams = grams.join(counts.withColumnRenamed("cnt", f"c{n}"), [*context, "word"], "left")
            if n > 1:
                totals = context_tables(counts, n).select(*context, F.col("total").alias(f"t{n}"), F.col("types").alias(f"d{n}"))
                grams = grams.join(totals, context, "left")
        grams = grams.fillna(0, [f"c{n}" for n in range(1, self.order + 1)] + [f"{x}{n}" for x in "td" for n in range(2, self.order + 1)])
        return grams.join(F.broadcast(self.size))  # one row

    def _rows_of_counts(self, text: DataFrame, found: AskedCounts, every: list[tuple]) -> DataFrame:
        """The rows of looked_up() from counts that the driver holds."""
        times: Counter[tuple[str, ...]] = Counter()
        for *gram, n in every:
            times[found.close(tuple(gram))] += n
        orders = range(1, self.order + 1)
        rows = []
        for gram, n in times.items():
            parts = [gram[self.order - m :] for m in orders]
            looked = [found.count[parts[0]]]
            for p in parts[1:]:
                looked += [found.count[p], found.total[p[:-1]], found.types[p[:-1]]]
            rows.append((*gram, n, *looked, found.n_all, found.v))
        names = [*(f"h{k}" for k in range(self.order - 1, 0, -1)), "word"]
        counts = ["c1", *(f"{x}{m}" for m in orders[1:] for x in "ctd")]
        kind = ", ".join([*(f"{c} string" for c in names), *(f"{c} long" for c in ("times", *counts, "n_all", "v"))])
        return text.sparkSession.createDataFrame(rows, kind)

    def probability(self, smoothing: str, k: Column | float | None = None) -> Column:
        """The probability of a row of looked_up(); an order whose context was never seen hands down to the lower one."""
        k = F.lit(self.k) if k is None else k if isinstance(k, Column) else F.lit(k)
        p = (F.col("c1") + k) / (F.col("n_all") + k * F.col("v"))
        for n in range(2, self.order + 1):
            c, t, d = F.col(f"c{n}"), F.col(f"t{n}"), F.col(f"d{n}")
            seen = (c + d * p) / (t + d) if smoothing == "witten_bell" else (c + k) / (t + k * F.col("v"))
            p = F.when(t == 0, p).otherwise(seen)
        return p

    def continuation_probability(self, text: DataFrame) -> DataFrame:
        """looked_up-like rows with `p` by absolute discounting of continuation counts.

        The highest order has no continuation counts, so its level passes on the next lower one, as
        in the model reproduced here."""
        cols = [f"h{k}" for k in range(self.order - 1, 0, -1)]
        grams = asked = self.asked_grams(text)
        one = continuation_counts(self.gram[2], 2).persist()  # one row a word
        total = one.agg(F.sum("cnt").alias("k_all"))
        grams = grams.join(one.withColumnRenamed("cnt", "k1"), "word", "left").fillna(0, ["k1"]).join(F.broadcast(total)).join(F.broadcast(self.size))  # one row each
        p = (F.col("k1") + self.k) / (F.col("k_all") + self.k * F.col("v"))
        for n in range(2, self.order):
            context = cols[self.order - n :]
            lower = continuation_counts(among(self.gram[n + 1], asked.select(*context), context), n + 1).persist()
            totals = context_tables(lower, n).select(*context, F.col("total").alias(f"kt{n}"), F.col("types").alias(f"kd{n}"))
            grams = grams.join(lower.withColumnRenamed("cnt", f"k{n}"), [*context, "word"], "left").join(totals, context, "left").fillna(0, [f"k{n}", f"kt{n}", f"kd{n}"])
            t = F.col(f"kt{n}")
            p = F.when(t == 0, p).otherwise(F.greatest(F.col(f"k{n}") - self.discount, F.lit(0.0)) / t + self.discount * F.col(f"kd{n}") / t * p)
        return grams.withColumn("p", p)


def normalisation(model: NgramModel, smoothing: str) -> DataFrame:
    """(h{order-1}.., h1, total): the sum of P(word | context) over the whole vocabulary, for every context seen, shorter ones with
    nulls before them; smoothing: witten_bell, addk, or continuation, which has no counts at the highest order.

    Words that follow the context are summed one by one; all others share what the lower order leaves beside those
    words, so that contexts and vocabulary are never crossed."""
    k, names = model.k, [f"h{i}" for i in range(model.order - 1, 0, -1)]
    if smoothing == "continuation":
        counts = {n - 1: continuation_counts(model.gram[n], n) for n in range(2, model.order + 1)}
    else:
        counts = model.gram
    vocabulary = model.size.select("v")
    first = counts[1].agg(F.sum("cnt").alias("n"), F.count("*").alias("n_types")).join(F.broadcast(vocabulary))  # one row each
    share = (F.col("cnt") + k) / (F.col("n") + k * F.col("v"))
    p = counts[1].join(F.broadcast(first)).select("word", share.alias("p"))
    below = p.agg(F.sum("p").alias("seen")).join(first).select((F.col("seen") + (F.col("v") - F.col("n_types")) * k / (F.col("n") + k * F.col("v"))).alias("below"))
    out = None
    for n in range(2, max(counts) + 1):
        context = names[model.order - n :]
        rows = counts[n].join(context_tables(counts[n], n), context).join(p.withColumnRenamed("p", "low"), [*context[1:], "word"])
        rows = rows.join(F.broadcast(vocabulary))
        c, t, d, low = (F.col(x) for x in ("cnt", "total", "types", "low"))
        if smoothing == "witten_bell":
            own, rest = (c + d * low) / (t + d), d / (t + d)
        elif smoothing == "addk":
            own, rest = (c + k) / (t + k * F.col("v")), (F.col("v") - d) * k / (t + k * F.col("v"))
        else:
            own, rest = F.greatest(c - model.discount, F.lit(0.0)) / t + model.discount * d / t * low, model.discount * d / t
        rows = rows.withColumn("p", own)
        sums = rows.groupBy(*context).agg(F.sum("p").alias("seen"), F.sum("low").alias("met"), F.max(rest).alias("rest"))
        sums = sums.join(below, context[1:]) if n > 2 else sums.join(F.broadcast(below))
        left = F.lit(1.0) if smoothing == "addk" else F.col("below") - F.col("met")
        totals = sums.select(*context, (F.col("seen") + F.col("rest") * left).alias("total"))
        part = totals.select(*(F.col(x) if x in context else F.lit(None).cast("string").alias(x) for x in names), "total")
        out = part if out is None else out.unionByName(part)
        p, below = rows.select(*context, "word", "p"), totals.withColumnRenamed("total", "below")
    return out


def sentence_scores(model: NgramModel, text: DataFrame, smoothing: str, *keys: str) -> DataFrame:
    """(keys, logp, n_words): of each sentence of `text`, ends included in logp."""
    looked = model.looked_up(text).withColumn("p", model.probability(smoothing))
    h = histories(closed(text, model.known_in(text)), model.order)
    names = [*(f"h{k}" for k in range(model.order - 1, 0, -1)), "word"]
    return h.join(looked.select(*names, "p"), names).groupBy(*keys).agg(F.sum(F.log("p")).alias("logp"), (F.count("*") - 1).alias("n_words"))


def perplexity(scored: DataFrame) -> DataFrame:
    """One row from rows (p, times): tokens, log-probability and perplexity."""
    logp = F.sum(F.log("p") * F.col("times"))
    return scored.agg(F.sum("times").alias("n_tokens"), logp.alias("logp"), F.exp(-logp / F.sum("times")).alias("perplexity"))


def windows(w: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, sent, i, words): every full window of `size` words inside a sentence, by its first word."""
    frame = W.partitionBy("doc_id", "sent").orderBy("i").rowsBetween(0, size - 1)
    return w.select("doc_id", "sent", "i", F.collect_list("word").over(frame).alias("words")).where(F.size("words") == size)


def tumbling_windows(w: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, win, n, words): a document's words in runs of `size`, across sentences; a last run of one word is dropped."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("sent", "i")) - 1
    rows = w.withColumn("at", place).withColumn("win", F.floor(F.col("at") / size))
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return rows.groupBy("doc_id", "win").agg(F.count("*").alias("n"), words.alias("words")).where("n > 1")


def spelled_out(text: DataFrame, known: DataFrame, bigrams: DataFrame, *keys: str) -> DataFrame:
    """(keys, char_logp): what the spelling of the words that a model does not know adds to its log-probability."""
    new = text.join(known, "word", "left_anti")
    return new.join(char_scores(new, bigrams), "word").groupBy(*keys).agg(F.sum("char_logp").alias("char_logp"))


def coverage(w: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, sent, n_words, coverage): the part of a sentence's words that the model knows."""
    seen = w.join(known.withColumn("is_known", F.lit(1)), "word", "left")
    return seen.groupBy("doc_id", "sent").agg(F.count("*").alias("n_words"), F.avg(F.coalesce("is_known", F.lit(0))).alias("coverage"))


def nearest_rank(df: DataFrame, column: str, fractions: list[float]) -> list[float | None]:
    """The values at index round-half-even(f * (n-1)) of the sorted column, exactly, without sorting it.

    Each round counts 1,024 parts of the range that holds the answer, until it holds one value; the
    driver sees the counts only."""
    values = df.select(F.col(column).alias("x")).where("x is not null").persist()
    n, least, most = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    out: list[float | None] = []
    for f in fractions:
        k, low, high = round(f * (n - 1)) if n else 0, least, most
        while n and low < high:
            step = (high - low) / 1024
            part = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(step)), F.lit(1023))
            cells = values.where(F.col("x").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
            for c in sorted(cells, key=lambda c: c.part):
                if k < c.n:
                    low, high = c.a, c.b
                    break
                k -= c.n
        out.append(low if n else None)
    values.unpersist()
    return out
