"""Hidden Markov tagging: sufficient statistics, probabilities, decoding and scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tags import AGREEMENT, MORPHOLOGY, coarse_tag, tag_feature

BEGIN, END = "<bos>", "<eos>"


def emissions(tagged: DataFrame) -> DataFrame:
    """(tag, word, cnt) of rows (word, tag), or (words, tags) a sentence; what is such a table already stays as it is."""
    if "cnt" in tagged.columns:
        return tagged
    if "tags" in tagged.columns:
        tagged = tagged.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("tags").alias("tag"))))
    return tagged.groupBy("tag", "word").agg(F.count("*").alias("cnt"))


def tag_histories(tagged: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, sent, i, tag, h1..): the tags before, an end after every sentence.  Rows with an array of `tags` are cut inside the
    row, to (tag, h1..)."""
    if "tags" in tagged.columns:
        rows = tagged.select(F.concat(F.array_repeat(F.lit(BEGIN), order - 1), "tags", F.array(F.lit(END))).alias("m"))
        names = [*(f"h{k}" for k in range(order - 1, 0, -1)), "tag"]
        return rows.select(F.inline(F.arrays_zip(*(F.slice("m", F.lit(k + 1), F.size("m") - (order - 1)).alias(n) for k, n in enumerate(names)))))
    ends = tagged.groupBy("doc_id", "sent").agg((F.max("i") + 1).alias("i")).withColumn("tag", F.lit(END))
    rows = tagged.select("doc_id", "sent", "i", "tag").unionByName(ends)
    place = W.partitionBy("doc_id", "sent").orderBy("i")
    return rows.select("*", *(F.lag("tag", k, BEGIN).over(place).alias(f"h{k}") for k in range(1, order)))


def tag_ngrams(histories: DataFrame, order: int) -> DataFrame:
    """(h.., tag, cnt) of rows tag_histories(), or of their counts (summarised())."""
    cnt = F.sum("cnt") if "cnt" in histories.columns else F.count("*")
    return histories.groupBy(*(f"h{k}" for k in range(order - 1, 0, -1)), "tag").agg(cnt.alias("cnt"))


def summarised(histories: DataFrame) -> DataFrame:
    """Trigram counts in place of tag_histories(), made once and held; the tagset bounds their number, which is checked."""
    rows = tag_ngrams(histories, 3)
    found = rows.limit(MAX_TRANSITIONS + 1).collect()
    if len(found) > MAX_TRANSITIONS:
        raise ValueError("the tagset is too large for a transition table")
    return histories.sparkSession.createDataFrame(found, rows.schema).coalesce(1)


def interpolation_weights(histories: DataFrame, floor: float = 1e-3) -> DataFrame:
    """(n, weight) for orders 1 to 3: each trigram votes its count for the order that, with the trigram itself taken out,
    predicts its last tag best; the lowest among equals; every weight is at least `floor` before scaling."""
    one, two, three = (tag_ngrams(histories, n) for n in (1, 2, 3))
    t2 = two.groupBy("h1").agg(F.sum("cnt").alias("t2"))
    t3 = three.groupBy("h2", "h1").agg(F.sum("cnt").alias("t3"))
    total = one.agg(F.sum("cnt").alias("t1"))
    rows = (
        three.withColumnRenamed("cnt", "c3").join(two.withColumnRenamed("cnt", "c2"), ["h1", "tag"]).join(one.withColumnRenamed("cnt", "c1"), "tag")
        .join(t2, "h1").join(t3, ["h2", "h1"]).join(F.broadcast(total))  # one row
    )
    ratio = {n: F.when(F.col(f"t{n}") > 1, (F.col(f"c{n}") - 1) / (F.col(f"t{n}") - 1)).otherwise(-1.0) for n in (1, 2, 3)}
    best = F.when((ratio[3] > ratio[2]) & (ratio[3] > ratio[1]), 3).when(ratio[2] > ratio[1], 2).otherwise(1)
    votes = rows.groupBy(best.alias("n")).agg(F.sum("c3").alias("votes"))
    orders = histories.sparkSession.createDataFrame([(1,), (2,), (3,)], "n int")
    shares = orders.join(votes, "n", "left").select("n", F.coalesce("votes", F.lit(0)).alias("votes"))
    every = W.partitionBy()  # three rows
    floored = shares.withColumn("raw", F.greatest(F.col("votes") / F.sum("votes").over(every), F.lit(floor)))
    return floored.select("n", (F.col("raw") / F.sum("raw").over(every)).alias("weight"))


def suffix_counts(tagged: DataFrame, rare: int = 10, longest: int = 5) -> DataFrame:
    """(suffix, tag, cnt) over the tokens of rare words; suffix '' holds the base counts."""
    few = emissions(tagged).withColumn("total", F.sum("cnt").over(W.partitionBy("word"))).where(F.col("total") <= rare)
    lengths = F.sequence(F.lit(0), F.least(F.lit(longest), F.length("word")))
    each = few.select("tag", "cnt", F.explode(F.transform(lengths, lambda n: F.substring(F.col("word"), F.length("word") - n + 1, n))).alias("suffix"))
    return each.groupBy("suffix", "tag").agg(F.sum("cnt").alias("cnt"))


def suffix_base(suffixes: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, p, theta): the add-one tag distribution of rare words, and its variance around evenness."""
    base = tags.select("tag").distinct().join(suffixes.where("suffix = ''").select("tag", "cnt"), "tag", "left")
    every = W.partitionBy()  # one row a tag
    p = base.select("tag", ((F.coalesce("cnt", F.lit(0)) + 1) / (F.sum(F.coalesce("cnt", F.lit(0))).over(every) + F.count("*").over(every))).alias("p"))
    n = F.count("*").over(every)
    p = p.withColumn("n", n).withColumn("away", (F.col("p") - 1 / F.col("n")) * (F.col("p") - 1 / F.col("n")))
    return p.select("tag", "p", F.when(F.col("n") > 1, F.sum("away").over(every) / (F.col("n") - 1)).otherwise(0.0).alias("theta"))


def suffix_distribution(words: DataFrame, suffixes: DataFrame, base: DataFrame, longest: int = 5) -> DataFrame:
    """(word, tag, p): successive abstraction from the base over ever longer suffixes, up to the first that was never seen."""
    counts = suffixes.where("suffix <> ''")
    totals = counts.groupBy("suffix").agg(F.sum("cnt").alias("total"))
    out = words.select("word").distinct().join(F.broadcast(base))  # one row a tag
    out = out.withColumn("open", F.lit(True))
    for n in range(1, longest + 1):
        key = F.when(F.length("word") >= n, F.substring(F.col("word"), F.length("word") - n + 1, F.lit(n)))
        out = out.withColumn("suffix", key).join(totals, "suffix", "left").join(counts, ["suffix", "tag"], "left")
        out = out.withColumn("open", F.col("open") & F.col("total").isNotNull())
        out = out.select("word", "tag", "theta", "open", F.when(F.col("open"), (F.coalesce("cnt", F.lit(0)) / F.col("total") + F.col("theta") * F.col("p")) / (1 + F.col("theta"))).otherwise(F.col("p")).alias("p"))
    return out.select("word", "tag", "p")


def transition_table(histories: DataFrame, weights: DataFrame) -> DataFrame:
    """(h2, h1, tag, p): the interpolated probability of each tag after each context seen; orders without the context
    hand their weight on.  Its size is bounded by the tagset."""
    one, two, three = (tag_ngrams(histories, n) for n in (1, 2, 3))
    t3 = three.groupBy("h2", "h1").agg(F.sum("cnt").alias("t3"))
    t2 = two.groupBy("h1").agg(F.sum("cnt").alias("t2"))
    total = one.agg(F.sum("cnt").alias("t1"))
    flat = weights.agg(*(F.max(F.when(F.col("n") == n, F.col("weight"))).alias(f"l{n}") for n in (1, 2, 3)))
    tags = one.select("tag", F.col("cnt").alias("c1"))
    rows = t3.join(F.broadcast(tags)).join(F.broadcast(total)).join(F.broadcast(flat)).join(t2, "h1")  # tags: one row a tag
    rows = rows.join(two.withColumnRenamed("cnt", "c2"), ["h1", "tag"], "left").join(three.withColumnRenamed("cnt", "c3"), ["h2", "h1", "tag"], "left")
    c2, c3 = F.coalesce("c2", F.lit(0)), F.coalesce("c3", F.lit(0))
    p = F.col("l1") * F.col("c1") / F.col("t1") + F.col("l2") * c2 / F.col("t2") + F.col("l3") * c3 / F.col("t3")
    return rows.select("h2", "h1", "tag", p.alias("p"))


def baseline_fit(tagged: DataFrame) -> DataFrame:
    """(word, tag): the most frequent tag of each word, the first in the alphabet among equals."""
    return emissions(tagged).groupBy("word").agg(F.min(F.struct((-F.col("cnt")).alias("o"), "tag"))["tag"].alias("tag"))


def baseline_tag(words: DataFrame, fitted: DataFrame, default: str = "NOUN") -> DataFrame:
    return words.join(fitted.withColumnRenamed("tag", "pred"), "word", "left").withColumn("pred", F.coalesce("pred", F.lit(default)))


def word_candidates(words: DataFrame, tagged: DataFrame, unknown_tags: int = 8) -> DataFrame:
    """(word, options): for each distinct word its possible tags and log emissions.  A word of the corpus has the tags it was
    seen with; another has the best by its suffixes, with the posterior divided by the tag's prior."""
    distinct = words.select("word").distinct()
    counts = emissions(tagged).persist()  # read four times
    per_tag = counts.groupBy("tag").agg(F.sum("cnt").alias("total"))
    seen = distinct.join(counts, "word").join(F.broadcast(per_tag), "tag").select("word", "tag", F.log(F.col("cnt") / F.col("total")).alias("e"), (-F.col("cnt")).alias("o"))
    every = W.partitionBy()  # one row a tag
    prior = per_tag.select("tag", (F.col("total") / F.sum("total").over(every)).alias("prior"))
    suffixes = suffix_counts(counts)
    new = distinct.join(counts.select("word").distinct(), "word", "left_anti")
    guessed = suffix_distribution(new, suffixes, suffix_base(suffixes, per_tag)).join(F.broadcast(prior), "tag")
    best = F.row_number().over(W.partitionBy("word").orderBy(F.desc("p"), "tag"))
    guessed = guessed.withColumn("r", best).where(F.col("r") <= unknown_tags).select("word", "tag", (F.log("p") - F.log("prior")).alias("e"), F.col("r").cast("long").alias("o"))
    options = F.array_sort(F.collect_list(F.struct("o", "tag", "e")))
    return seen.unionByName(guessed).groupBy("word").agg(options.alias("options"))


def viterbi(options: list[list[tuple[str, float]]], transition: dict[tuple[str, str], dict[str, float]], default: str, beam: int | None = None) -> list[str]:
    """The most probable tags; states are the last two tags.  Without a continuation the best state goes on with the best tag."""
    column: dict[tuple[str, str], float] = {(BEGIN, BEGIN): 0.0}
    back: list[dict[tuple[str, str], tuple[str, str]]] = []
    fallback: dict[str, dict[str, float]] = transition.get(("", ""), {})  # type: ignore[assignment]

    def after(state: tuple[str, str]) -> dict[str, float]:
        return transition.get(state) or transition.get(("", state[1])) or fallback

    for choice in options:
        choice = choice or [(default, 0.0)]
        new: dict[tuple[str, str], float] = {}
        link: dict[tuple[str, str], tuple[str, str]] = {}
        for state, score in column.items():
            known = after(state)
            for tag, emission in choice:
                logp = known.get(tag)
                if logp is None:
                    continue
                key = (state[1], tag)
                if score + logp + emission > new.get(key, -math.inf):
                    new[key], link[key] = score + logp + emission, state
        if not new:
            tag, emission = max(choice, key=lambda c: c[1])
            state = max(column, key=column.__getitem__)
            new, link = {(state[1], tag): column[state] + emission}, {(state[1], tag): state}
        if beam is not None and len(new) > beam:
            new = {k: new[k] for k in sorted(new, key=lambda k: -new[k])[:beam]}
        column = new
        back.append(link)
    if not back:
        return []
    state = max(column, key=lambda s: column[s] + after(s).get(END, -math.inf))
    out = []
    for link in reversed(back):
        out.append(state[1])
        state = link[state]
    return out[::-1]


#: Rows of transition tables that may be collected: the cube of a tagset of 200 tags.
MAX_TRANSITIONS = 8_000_000


def transition_dict(histories: DataFrame, weights: DataFrame, order: int = 3) -> dict[tuple[str, str], dict[str, float]]:
    """Log probabilities by context: both tags (at order 3), the last alone as ('', tag), none as ('', '').  The size is checked."""
    if order not in (2, 3):
        raise ValueError(order)
    if histories.select("tag").distinct().count() ** 3 > MAX_TRANSITIONS:
        raise ValueError("the tagset is too large for a transition table")
    out: dict[tuple[str, str], dict[str, float]] = {}
    for r in transition_table(histories, weights).where("p > 0").collect() if order == 3 else ():
        out.setdefault((r.h2, r.h1), {})[r.tag] = math.log(r.p)
    w = {r.n: r.weight for r in weights.collect()}
    one = {r.tag: r.cnt for r in tag_ngrams(histories, 1).collect()}
    two: dict[str, dict[str, int]] = {}
    for r in tag_ngrams(histories, 2).collect():
        two.setdefault(r.h1, {})[r.tag] = r.cnt
    n = sum(one.values())
    out["", ""] = {t: math.log(c / n) for t, c in one.items()}
    for h, row in two.items():
        total = sum(row.values())
        out["", h] = {t: math.log((w[1] * c / n + w[2] * row.get(t, 0) / total) / (w[1] + w[2])) for t, c in one.items()}
    return out


def viterbi_tags(words: DataFrame, tagged: DataFrame, beam: int | None = None, order: int = 3) -> DataFrame:
    """(doc_id, sent, i, word, pred): options joined for each distinct word, one pass of Python a sentence; a tag
    depends on the order-1 before it."""
    histories = summarised(tag_histories(tagged))
    table = transition_dict(histories, interpolation_weights(histories), order)
    often = histories.where(F.col("tag") != END).groupBy("tag").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "tag").first()
    default = often["tag"] if often else "NOUN"
    joined = words.join(word_candidates(words, tagged), "word", "left")
    rows = joined.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("i", "word", "options"))).alias("items"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            preds = []
            for items in batch["items"]:
                options = [[(o["tag"], o["e"]) for o in (x["options"] if x["options"] is not None else [])] for x in items]
                preds.append(viterbi(options, table, default, beam))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "sent": batch["sent"], "i": [[x["i"] for x in items] for items in batch["items"]], "word": [[x["word"] for x in items] for items in batch["items"]], "pred": preds})

    tagged_rows = rows.mapInPandas(run, "doc_id long, sent long, i array<long>, word array<string>, pred array<string>")
    return tagged_rows.select("doc_id", "sent", F.explode(F.arrays_zip("i", "word", "pred")).alias("x")).select("doc_id", "sent", "x.i", "x.word", "x.pred")


def choose_order(dev: DataFrame, train: DataFrame, orders: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(n, accuracy, chosen): how well each order tags the words of `dev`; the best is chosen, the higher among equals."""
    gold = dev.select("doc_id", "sent", "i", "tag")
    found = []
    for n in orders:
        right = viterbi_tags(dev, train, order=n).join(gold, ["doc_id", "sent", "i"]).agg(F.avg((F.col("tag") == F.col("pred")).cast("double"))).first()[0]
        found.append((n, round(right or 0.0, 6)))
    best = max(found, key=lambda x: (x[1], x[0]))[0]
    return dev.sparkSession.createDataFrame([(n, a, n == best) for n, a in found], "n int, accuracy double, chosen boolean")


def sequence_logprob(tagged: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, sent, logp, n_unseen): the joint log-probability of words and tags, as joins; pairs never seen and contexts
    never seen are counted and not scored."""
    histories = summarised(tag_histories(train))
    table = transition_table(histories, interpolation_weights(histories))
    counts = emissions(train)
    totals = counts.groupBy("tag").agg(F.sum("cnt").alias("total"))
    rows = tag_histories(tagged).join(tagged.select("doc_id", "sent", "i", "word"), ["doc_id", "sent", "i"], "left")
    scored = rows.join(table, ["h2", "h1", "tag"], "left").join(counts, ["tag", "word"], "left").join(totals, "tag", "left")
    e = F.when(F.col("tag") == END, 0.0).when(F.col("cnt").isNotNull(), F.log(F.col("cnt") / F.col("total")))
    logp = F.when(F.col("p") > 0, F.log("p")) + e
    return scored.groupBy("doc_id", "sent").agg(F.sum(F.coalesce(logp, F.lit(0.0))).alias("logp"), F.count_if(logp.isNull()).alias("n_unseen"))


def tag_scores(predicted: DataFrame, known: DataFrame) -> DataFrame:
    """One row from (doc_id, sent, word, tag, pred): accuracy over all, known and unknown words, and sentences without an error."""
    rows = predicted.join(known.select("word", F.lit(True).alias("known")), "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    right = (F.col("tag") == F.col("pred")).cast("long")
    sents = rows.groupBy("doc_id", "sent").agg(F.count("*").alias("n"), F.sum(right).alias("ok"), F.count_if("known").alias("n_known"), F.sum(right * F.col("known").cast("long")).alias("ok_known"))
    total = sents.agg(F.sum("n").alias("n_tokens"), F.sum("ok").alias("n_right"), F.sum("n_known").alias("n_known"), F.sum("ok_known").alias("n_known_right"), F.count("*").alias("n_sentences"), F.count_if(F.col("n") == F.col("ok")).alias("n_exact"))
    unknown = F.col("n_tokens") - F.col("n_known")
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return total.select(
        "n_tokens", "n_right", "n_known", "n_known_right", "n_sentences", "n_exact", rate(F.col("n_right"), F.col("n_tokens")).alias("accuracy"),
        rate(F.col("n_known_right"), F.col("n_known")).alias("known_accuracy"), rate(F.col("n_right") - F.col("n_known_right"), unknown).alias("unknown_accuracy"), rate(unknown, F.col("n_tokens")).alias("oov_rate"),
    )


def confusion(predicted: DataFrame) -> DataFrame:
    """(gold, pred, cnt)."""
    return predicted.groupBy(F.col("tag").alias("gold"), "pred").agg(F.count("*").alias("cnt"))


def confusion_rows(predicted: DataFrame) -> DataFrame:
    """(tag, n_gold, n_pred, n_right, precision, recall, f1) for every tag on either side."""
    cells = confusion(predicted)
    gold = cells.groupBy(F.col("gold").alias("tag")).agg(F.sum("cnt").alias("n_gold"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("cnt")).otherwise(0)).alias("n_right"))
    pred = cells.groupBy(F.col("pred").alias("tag")).agg(F.sum("cnt").alias("n_pred"))
    both = gold.join(pred, "tag", "full").fillna(0)
    p, r = (F.coalesce(F.try_divide(F.col("n_right"), F.col(c)), F.lit(0.0)) for c in ("n_pred", "n_gold"))
    return both.select("tag", "n_gold", "n_pred", "n_right", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def confusion_square(predicted: DataFrame, tags: list[str]) -> DataFrame:
    """One row a gold tag of the list: its counts for each of the tags, `other`, and recall."""
    cells = confusion(predicted)
    wide = cells.where(F.col("gold").isin(tags)).groupBy("gold").agg(
        *(F.sum(F.when(F.col("pred") == t, F.col("cnt")).otherwise(0)).alias(f"as_{t}") for t in tags),
        F.sum(F.when(~F.col("pred").isin(tags), F.col("cnt")).otherwise(0)).alias("other"),
        F.round(F.sum(F.when(F.col("pred") == F.col("gold"), F.col("cnt")).otherwise(0)) / F.sum("cnt"), 6).alias("recall"),
    )
    return wide


def agreement(tagged: DataFrame, names: tuple[str, ...] = AGREEMENT) -> DataFrame:
    """(context, n_pairs, n_reproduced, n_correct) and the total (context null), from rows with gold `features` and a predicted
    morphological tag `pred`: neighbours that share a feature value, whether the predicted tags agree on it, and on the right value."""
    place = W.partitionBy("doc_id", "sent").orderBy("i")
    both = tagged.select("*", *(F.lead(c).over(place).alias(f"r_{c}") for c in ("tag", "features", "pred")))

    def short(name: str) -> Column:
        table = MORPHOLOGY[name]
        value = F.try_element_at("features", F.lit(name))
        same = value == F.try_element_at("r_features", F.lit(name))
        return F.when(same, F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), value))

    gold = {n: short(n) for n in names}
    left, right = ({n: tag_feature(F.col(c), n) for n in names} for c in ("pred", "r_pred"))
    counted, reproduced, correct = F.lit(False), F.lit(True), F.lit(True)
    for n in names:
        counted = counted | gold[n].isNotNull()
        same = F.coalesce(left[n] == right[n], F.lit(False))
        reproduced = reproduced & (gold[n].isNull() | same)
        correct = correct & (gold[n].isNull() | F.coalesce(left[n] == gold[n], F.lit(False)))
    rows = both.where(F.col("r_tag").isNotNull() & counted).select(F.concat("tag", F.lit("+"), "r_tag").alias("context"), reproduced.alias("ok"), (reproduced & correct).alias("right"))
    return rows.rollup("context").agg(F.count("*").alias("n_pairs"), F.count_if("ok").alias("n_reproduced"), F.count_if("right").alias("n_correct"))


def agreement_bias(histories: DataFrame, head: str = "NOUN", dependent: str = "ADJ", determiner: str = "DET", limit: int = 4) -> DataFrame:
    """(head_tag, agreeing, clashing, underspecified): how the transition model divides the dependent's tags after each of the
    most frequent fully marked heads and its matching determiner; contexts never seen give no row."""
    histories = summarised(histories)
    one = tag_ngrams(histories, 1)
    marks = lambda c: (tag_feature(F.col(c), "Gender"), tag_feature(F.col(c), "Number"))
    gender, number = marks("tag")
    heads = one.where((coarse_tag(F.col("tag")) == head) & gender.isNotNull() & number.isNotNull()).orderBy(F.desc("cnt"), "tag").limit(limit)
    heads = heads.select(F.col("tag").alias("h1"), F.concat_ws("-", F.lit(determiner), gender, number).alias("h2"))
    table = transition_table(histories, interpolation_weights(histories)).where(coarse_tag(F.col("tag")) == dependent)
    rows = table.join(F.broadcast(heads), ["h1", "h2"])  # `limit` rows
    g, n = marks("tag")
    hg, hn = marks("h1")
    kind = F.when(g.isNull() | n.isNull(), "underspecified").when((g == hg) & (n == hn), "agreeing").otherwise("clashing")
    part = lambda k: F.round(F.coalesce(F.sum(F.when(kind == k, F.col("p"))), F.lit(0.0)), 6).alias(k)
    return rows.groupBy(F.col("h1").alias("head_tag")).agg(part("agreeing"), part("clashing"), part("underspecified"))
