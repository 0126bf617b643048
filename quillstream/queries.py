"""The register of the library's queries and of their DuckDB SQL.

Every query runs over its whole tables.  Models are learned from `documents` and asked about
`benchmark`; the texts are invented, so tags and trees are pure functions of the words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import tags
from .functions.text import is_valid_word, match_case, token_parts
from .operators import analysis, checks, corpus, grammar, ngrams, parsing, reports, segmentation, spelling, tagging
from .oracle import SQL, notation_sql
from .plans import experiments, pseudo_gold
from .sources.corpora import corpus_stats as stats_of
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.words(_docs(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_words(), a row a sentence."""
    return corpus.word_rows(_docs(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark items."""
    return corpus.words(spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))


@query
def tokens_normalised(spark, sf_dir):
    return corpus.tokens(_docs(spark, sf_dir))


@query
def tokens_clean(spark, sf_dir):
    return corpus.tokens(_docs(spark, sf_dir)).where(is_valid_word(F.col("token"))).select("doc_id", "pos", F.lower("token").alias("word"))


@query
def token_split_case(spark, sf_dir):
    distinct = corpus.tokens(_docs(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n")).withColumn("p", token_parts(F.col("token"))).where("p is not null")
    swapped = F.reverse(F.lower("p.core"))
    return distinct.select("token", "n", "p.leading", "p.core", "p.trailing", match_case(F.col("p.core"), swapped).alias("cased"))


@query
def sentence_boundaries(spark, sf_dir):
    return corpus.sentences(_docs(spark, sf_dir)).groupBy("doc_id", "sent").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_tokens"))


@query
def gold_spans(spark, sf_dir):
    return corpus.spans(_words(spark, sf_dir))


@query
def unigrams(spark, sf_dir):
    return corpus.vocabulary(_words(spark, sf_dir))


@query
def bigrams(spark, sf_dir):
    return spelling.bigram_counts(_rows(spark, sf_dir))


@query
def ngram_counts_3(spark, sf_dir):
    return ngrams.NgramModel(_rows(spark, sf_dir)).gram[3]


@query
def context_tables(spark, sf_dir):
    return ngrams.context_tables(ngrams.NgramModel(_rows(spark, sf_dir)).gram[3], 3)


@query
def kn_continuation(spark, sf_dir):
    return ngrams.continuation_counts(ngrams.NgramModel(_rows(spark, sf_dir)).gram[3], 3)


@query
def char_bigrams(spark, sf_dir):
    return ngrams.char_bigrams(_words(spark, sf_dir))


@query
def length_percentile(spark, sf_dir):
    w = _words(spark, sf_dir)
    out = None
    for share in (0.5, 0.9, 0.999, 1.0):
        row = corpus.length_at(w, share).select(F.lit(share).alias("share"), "length")
        out = row if out is None else out.union(row)
    return out


@query
def stratified_split(spark, sf_dir):
    return corpus.stratified_split(_docs(spark, sf_dir).select("doc_id", "source"))


@query
def corpus_profile(spark, sf_dir):
    return corpus.corpus_profile(_docs(spark, sf_dir))


@query
def merge_injection(spark, sf_dir):
    return corpus.inject_merges(_rows(spark, sf_dir))


@query
def symdel_candidates(spark, sf_dir):
    asked = _asked(spark, sf_dir).select(F.col("word").alias("query")).distinct()
    return spelling.candidates(asked, corpus.vocabulary(_words(spark, sf_dir)), "B")


@query
def correct_nonword(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    vocab = corpus.vocabulary(rows).persist()  # read by the tests, the candidates and their ranking
    return spelling.correct_nonwords(spelling.test_words(rows, vocab), vocab)


@query
def spell_accuracy_by_edit(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    vocab = corpus.vocabulary(rows).persist()
    fixed = spelling.correct_nonwords(spelling.test_counts(rows, vocab).persist(), vocab)
    right = F.when(F.col("is_right"), F.col("n")).otherwise(0)
    counts = fixed.groupBy("kind").agg(F.sum("n").alias("n_tests"), F.sum(right).alias("n_right"))
    return counts.withColumn("accuracy", F.round(F.col("n_right") / F.col("n_tests"), 6))


def _real(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return spelling.realword_scores(_asked(spark, sf_dir), corpus.vocabulary(rows).persist(), spelling.bigram_counts(rows))


@query
def realword_scores(spark, sf_dir):
    return _real(spark, sf_dir).withColumn("score", F.round("score", 6))


@query
def correct_realword(spark, sf_dir):
    return spelling.correct_realwords(_real(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("own_score", "best_score")})


@query
def realword_threshold_sweep(spark, sf_dir):
    best = spelling.correct_realwords(_real(spark, sf_dir))
    grid = F.explode(F.array(*(F.lit(t) for t in (2.0, 1.5, 1.1, 1.0, 0.5, 0.1)))).alias("threshold")
    gain = F.round(F.col("best_score") - F.col("own_score"), 9) > F.col("threshold")
    return best.select("*", grid).groupBy("threshold").agg(F.count_if(gain).alias("n_changed"), F.count("*").alias("n_words"))


@query
def sliding_windows(spark, sf_dir):
    return ngrams.windows(_words(spark, sf_dir), 10).withColumn("words", F.array_join("words", " "))


@query
def coverage(spark, sf_dir):
    return ngrams.coverage(_asked(spark, sf_dir), ngrams.known_words(_words(spark, sf_dir))).withColumn("coverage", F.round("coverage", 6))


def _looked_up(spark, sf_dir):
    model = ngrams.NgramModel(_rows(spark, sf_dir))
    return model, model.looked_up(_asked(spark, sf_dir))


@query
def lm_witten_bell(spark, sf_dir):
    model, rows = _looked_up(spark, sf_dir)
    return rows.select("h2", "h1", "word", "times", F.round(F.log(model.probability("witten_bell")), 6).alias("logp"))


@query
def lm_addk(spark, sf_dir):
    model, rows = _looked_up(spark, sf_dir)
    return rows.select("h2", "h1", "word", "times", F.round(F.log(model.probability("addk")), 6).alias("logp"))


@query
def lm_kneser_ney(spark, sf_dir):
    model = ngrams.NgramModel(_rows(spark, sf_dir))
    return model.continuation_probability(_asked(spark, sf_dir)).select("h2", "h1", "word", "times", F.round(F.log("p"), 6).alias("logp"))


@query
def lm_perplexity(spark, sf_dir):
    model, rows = _looked_up(spark, sf_dir)
    return ngrams.perplexity(rows.withColumn("p", model.probability("witten_bell"))).withColumns({c: F.round(c, 4) for c in ("logp", "perplexity")})


@query
def addk_sweep(spark, sf_dir):
    model, rows = _looked_up(spark, sf_dir)
    each = rows.select("*", F.explode(F.array(*(F.lit(k) for k in (0.001, 0.01, 0.1, 0.5, 1.0)))).alias("k")).withColumn("p", model.probability("addk", F.col("k")))
    return each.groupBy("k").agg(F.round(F.exp(-F.sum(F.log("p") * F.col("times")) / F.sum("times")), 4).alias("perplexity"))


#: Inputs of the two queries about notations.
BROWN_SAMPLE = [t + suffix for t in tags.BROWN_TO_PENN for suffix in ("", "-TL", "-HL", "-NC", "-TL-HL", "*", "+BEZ")] + ["", "zz", "nn-tl"]
FEATURE_SAMPLE = [(p, f) for p in ("NOUN", "ADJ", "VERB") for f in ("_", "", "Gender=Fem|Number=Sing", "Number=Plur", "Gender=Masc,Neut|Number=Ptan|X", "Case=Nom|Gender=Odd|Number=Coll", "Number=Dual|Person=3")]


@query
def brown_tag_map(spark, sf_dir):
    raw = spark.createDataFrame([(t,) for t in BROWN_SAMPLE], "raw string")
    return raw.select("raw", tags.normalise_brown_tag(F.col("raw")).alias("tag"), tags.brown_to_penn(F.col("raw")).alias("penn"))


@query
def feats_morph_tag(spark, sf_dir):
    raw = spark.createDataFrame(FEATURE_SAMPLE, "upos string, feats string").withColumn("morph", tags.morph_tag(F.col("upos"), tags.parse_features(F.col("feats"))))
    return raw.select("upos", "feats", "morph", tags.coarse_tag(F.col("morph")).alias("coarse"), tags.tag_feature(F.col("morph"), "Gender").alias("gender"), tags.tag_feature(F.col("morph"), "Number").alias("number"))


@query
def corpus_stats(spark, sf_dir):
    t = corpus.tokens(_docs(spark, sf_dir))
    return stats_of(t.select(F.col("token").alias("form"), F.when(F.length("clean") == 1, "SYM").otherwise("X").alias("tag")), longest=12)


def _asked_windows(spark, sf_dir):
    """Every window of ten benchmark words, as sentences of their own."""
    w = ngrams.windows(_asked(spark, sf_dir), 10).withColumn("key", F.concat_ws("/", "doc_id", "sent", "i"))
    return w.select("key", F.posexplode("words").alias("k", "word")).select(F.col("key").alias("doc_id"), F.lit(0).alias("sent"), (F.col("k") + 1).alias("i"), "word")


@query
def window_perplexity(spark, sf_dir):
    model = ngrams.NgramModel(_rows(spark, sf_dir), k=0.001)
    scored = ngrams.sentence_scores(model, _asked_windows(spark, sf_dir), "addk", "doc_id")
    return scored.select(F.col("doc_id").alias("key"), F.round(F.exp(-F.col("logp") / (F.col("n_words") + 1)), 4).alias("perplexity"))


@query
def calibration_percentiles(spark, sf_dir):
    rows = window_perplexity(spark, sf_dir)
    shares = [0.02, 0.1, 0.5, 0.9, 0.95]
    return spark.createDataFrame(list(zip(shares, ngrams.nearest_rank(rows, "perplexity", shares), strict=True)), "share double, perplexity double")


@query
def lm_normalisation(spark, sf_dir):
    """The sum of P(word | context) over the vocabulary, for every context of one or two words and every smoothing."""
    model, out = ngrams.NgramModel(_rows(spark, sf_dir)).keep(), None
    for smoothing in ("witten_bell", "addk", "continuation"):
        part = ngrams.normalisation(model, smoothing).select(F.lit(smoothing).alias("smoothing"), "h2", "h1", F.round("total", 6).alias("total"))
        out = part if out is None else out.union(part)
    return out


@query
def lm_open_vocab(spark, sf_dir):
    """Sentence log-probabilities in which an unknown word costs its spelling too."""
    asked = _asked(spark, sf_dir)
    model = ngrams.NgramModel(_rows(spark, sf_dir))
    spelled = ngrams.spelled_out(asked, model.known_in(asked), ngrams.char_bigrams(model.vocabulary(asked)), "doc_id", "sent")
    rows = ngrams.sentence_scores(model, asked, "witten_bell", "doc_id", "sent").join(spelled, ["doc_id", "sent"], "left")
    return rows.select("doc_id", "sent", "n_words", F.round(F.col("logp") + F.coalesce("char_logp", F.lit(0.0)), 5).alias("logp"))


@query
def tumbling_windows(spark, sf_dir):
    return ngrams.tumbling_windows(_words(spark, sf_dir), 10).withColumn("words", F.array_join("words", " "))


@query
def symdel_index(spark, sf_dir):
    return spelling.symdel_index(corpus.vocabulary(_words(spark, sf_dir)))


@query
def benchmark_words(spark, sf_dir):
    return spelling.benchmark_words(corpus.vocabulary(_words(spark, sf_dir)))


@query
def edits1_candidates(spark, sf_dir):
    ascii_ = "^[a-z]+$"
    asked = _asked(spark, sf_dir).select(F.col("word").alias("query")).distinct().where(F.col("query").rlike(ascii_))
    return spelling.candidates(asked, corpus.vocabulary(_words(spark, sf_dir)).where(F.col("word").rlike(ascii_)), "A")


@query
def edits1_candidates_all(spark, sf_dir):
    """The a-z edits of every benchmark word among all words, accented ones too."""
    asked = _asked(spark, sf_dir).select(F.col("word").alias("query")).distinct()
    return spelling.candidates(asked, corpus.vocabulary(_words(spark, sf_dir)), "A")


@query
def method_ab_diff(spark, sf_dir):
    ascii_ = "^[a-z]+$"
    asked = _asked(spark, sf_dir).select(F.col("word").alias("query")).distinct().where(F.col("query").rlike(ascii_))
    vocab = corpus.vocabulary(_words(spark, sf_dir)).where(F.col("word").rlike(ascii_))
    a, b = (spelling.candidates(asked, vocab, m).withColumn(m, F.lit(True)) for m in "AB")
    both = a.join(b, ["query", "cand"], "full")
    return both.agg(F.count("A").alias("n_a"), F.count("B").alias("n_b"), F.count_if(F.col("A").isNull() | F.col("B").isNull()).alias("n_different"))


@query
def correct_sentence(spark, sf_dir):
    w = _words(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    return spelling.SpellingCorrector(corpus.vocabulary(w), spelling.bigram_counts(w)).correct(items)


def _strings(w):
    chars = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), "")
    return w.groupBy("doc_id", "sent").agg(chars.alias("chars"))


@query
def greedy_segment(spark, sf_dir):
    return segmentation.greedy(_strings(_asked(spark, sf_dir)), ngrams.known_words(_words(spark, sf_dir)))


def _greedy_spans(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    strings = _strings(asked).withColumn("key", F.concat_ws("/", "doc_id", "sent"))
    found = segmentation.word_spans(segmentation.greedy(strings, ngrams.known_words(_words(spark, sf_dir)))).join(strings.select("key", "chars"), "chars")
    return corpus.spans(asked).withColumn("key", F.concat_ws("/", "doc_id", "sent")), found


@query
def segmentation_scores(spark, sf_dir):
    return segmentation.segmentation_scores(*_greedy_spans(spark, sf_dir))


@query
def overlap_errors(spark, sf_dir):
    return segmentation.overlap_errors(*_greedy_spans(spark, sf_dir))


@query
def dp_segment(spark, sf_dir):
    return segmentation.segment(_strings(_asked(spark, sf_dir)), _rows(spark, sf_dir), segmentation.DecoderConfig(beam_width=4, max_word_len=19)).select("chars", "words", F.round("score", 6).alias("score"))


def _gold(spark, sf_dir):
    return pseudo_gold.tagged(_rows(spark, sf_dir))


def _gold_rows(spark, sf_dir, morph=False):
    """_gold(), a row a sentence."""
    return pseudo_gold.tagged_rows(_rows(spark, sf_dir), morph)


def _gold_trees(spark, sf_dir):
    return pseudo_gold.tree_rows(_rows(spark, sf_dir))


def _asked_gold(spark, sf_dir):
    return pseudo_gold.tagged(_asked(spark, sf_dir))


@query
def hmm_emissions(spark, sf_dir):
    return tagging.emissions(_gold(spark, sf_dir))


@query
def hmm_transitions(spark, sf_dir):
    return tagging.tag_ngrams(tagging.tag_histories(_gold_rows(spark, sf_dir)), 3)


@query
def deleted_interpolation(spark, sf_dir):
    return tagging.interpolation_weights(tagging.summarised(tagging.tag_histories(_gold_rows(spark, sf_dir)))).withColumn("weight", F.round("weight", 6))


@query
def suffix_model(spark, sf_dir):
    return tagging.suffix_counts(_gold(spark, sf_dir))


@query
def suffix_dist(spark, sf_dir):
    g = _gold(spark, sf_dir)
    suffixes = tagging.suffix_counts(g)
    asked = _asked(spark, sf_dir).select("word").distinct()
    return tagging.suffix_distribution(asked, suffixes, tagging.suffix_base(suffixes, g)).withColumn("p", F.round("p", 6))


@query
def transition_prob(spark, sf_dir):
    h = tagging.summarised(tagging.tag_histories(_gold_rows(spark, sf_dir)))
    return tagging.transition_table(h, tagging.interpolation_weights(h)).withColumn("p", F.round("p", 6))


@query
def sequence_logprob(spark, sf_dir):
    return tagging.sequence_logprob(_asked_gold(spark, sf_dir), _gold_rows(spark, sf_dir)).withColumn("logp", F.round("logp", 5))


def _fitted(spark, sf_dir, asked, tag="tag"):
    """The most frequent tag of each word that is asked for; other words are left out before any is counted."""
    return tagging.baseline_fit(ngrams.among(_gold(spark, sf_dir).select("word", F.col(tag).alias("tag")), asked, ["word"])).persist()


def _baseline(spark, sf_dir):
    asked = _asked_gold(spark, sf_dir)
    return tagging.baseline_tag(asked, _fitted(spark, sf_dir, asked))


@query
def baseline_tags(spark, sf_dir):
    return _baseline(spark, sf_dir).select("doc_id", "sent", "i", "word", "tag", "pred")


@query
def viterbi_tags(spark, sf_dir):
    return tagging.viterbi_tags(_asked(spark, sf_dir), _gold_rows(spark, sf_dir))


@query
def tag_scores(spark, sf_dir):
    asked = _asked_gold(spark, sf_dir)
    fitted = _fitted(spark, sf_dir, asked)
    return tagging.tag_scores(tagging.baseline_tag(asked, fitted), fitted)


@query
def confusion(spark, sf_dir):
    return tagging.confusion(_baseline(spark, sf_dir))


@query
def confusion_matrix_rows(spark, sf_dir):
    return tagging.confusion_rows(_baseline(spark, sf_dir))


@query
def confusion_square(spark, sf_dir):
    """The three most frequent gold tags against each other, columns in their order."""
    predicted = _baseline(spark, sf_dir).persist()  # read for its tags, then for its rows
    top = reports.common_tags(tagging.confusion(predicted), 3)
    return tagging.confusion_square(predicted, top).withColumnsRenamed({f"as_{t}": f"as_rank_{k + 1}" for k, t in enumerate(top)})


@query
def most_confused(spark, sf_dir):
    return reports.most_confused(tagging.confusion(_baseline(spark, sf_dir)))


@query
def weakest_tags(spark, sf_dir):
    return reports.weakest(tagging.confusion_rows(_baseline(spark, sf_dir)))


@query
def error_examples(spark, sf_dir):
    """Three wrongly tagged words of each gold tag."""
    wrong = _baseline(spark, sf_dir).where("pred <> tag").select("doc_id", "sent", "i", "word", "tag", "pred")
    return reports.examples(wrong, "tag", F.struct("doc_id", "sent", "i"))


@query
def sampled_documents(spark, sf_dir):
    """A dev sample of 200 documents and how it would be shown."""
    rows = reports.draw(_docs(spark, sf_dir).select("doc_id", "lang"), 200, "doc_id")
    return rows.select("doc_id", "lang", reports.percent(F.lit(1.0) / 200).alias("share"))


@query
def sample_reachability(spark, sf_dir):
    """Words of the benchmark's sentences that no segmentation over the known words can give back."""
    rows = _strings(_asked(spark, sf_dir)).join(corpus.rows_of(_asked(spark, sf_dir)), ["doc_id", "sent"])
    strings = rows.select("chars", F.array_join("words", " ").alias("words")).distinct()
    return reports.unreachable(strings, ngrams.known_words(_words(spark, sf_dir)))


@query
def agreement(spark, sf_dir):
    asked = _asked_gold(spark, sf_dir)
    return tagging.agreement(tagging.baseline_tag(asked, _fitted(spark, sf_dir, asked, "morph"), "NOUN-Sg"))


@query
def agreement_bias(spark, sf_dir):
    return tagging.agreement_bias(tagging.tag_histories(_gold_rows(spark, sf_dir, morph=True)))


@query
def pipeline_scores(spark, sf_dir):
    """Gold words of the benchmark against greedy segmentation and baseline tags: right, lost by segmentation, wrongly tagged."""
    gold, found = _greedy_spans(spark, sf_dir)
    gold = pseudo_gold.tagged(gold).select("key", "span_start", "span_end", "tag")
    pred = tagging.baseline_tag(found, tagging.baseline_fit(_gold(spark, sf_dir))).select("key", "span_start", "span_end", "pred")
    joined = gold.join(pred, ["key", "span_start", "span_end"], "left")
    out = joined.agg(F.count("*").alias("n_tokens"), F.count_if(F.col("pred") == F.col("tag")).alias("n_right"), F.count_if(F.col("pred").isNull()).alias("n_lost"), F.count_if(F.col("pred") != F.col("tag")).alias("n_mistagged"))
    return out.withColumn("accuracy", F.round(F.col("n_right") / F.col("n_tokens"), 6))


@query
def oracle_transitions(spark, sf_dir):
    return parsing.oracle_instances(pseudo_gold.with_heads(_asked_gold(spark, sf_dir)))


@query
def transition_histogram(spark, sf_dir):
    return parsing.transition_histogram(parsing.oracle_counts(_gold_trees(spark, sf_dir)))


@query
def las(spark, sf_dir):
    """The attachment of every word to the next one, scored against the gold heads."""
    gold = pseudo_gold.with_heads(_asked_gold(spark, sf_dir))
    guess = gold.select("doc_id", "sent", (F.col("i") + 1).alias("head"), F.col("i").alias("dep"), F.lit("noun").alias("label"))
    return parsing.attachment(gold, guess)


@query
def dependency_parse(spark, sf_dir):
    """The parser trained on the documents, scored on the benchmark."""
    train = parsing.oracle_counts(_gold_trees(spark, sf_dir)).persist()
    gold = pseudo_gold.with_heads(_asked_gold(spark, sf_dir))
    names = [r.b0 for r in train.where(F.col("b0") != parsing.NONE).select("b0").distinct().orderBy("b0").collect()]  # every word is once the next
    return parsing.attachment(gold, parsing.parse_sentences(gold, parsing.rankings(parsing.classifier(train), names)))


def _grammar(spark, sf_dir):
    return grammar.rule_probabilities(grammar.productions(pseudo_gold.flat_tree_rows(_rows(spark, sf_dir))))


@query
def pcfg_rules(spark, sf_dir):
    return _grammar(spark, sf_dir).withColumn("logp", F.round("logp", 6))


def _asked_ids(spark, sf_dir):
    return _asked_gold(spark, sf_dir).select(F.concat_ws("/", "doc_id", "sent").alias("id"), "i", "word", "tag")


@query
def cky_parse(spark, sf_dir):
    return grammar.parse_sentences(_asked_ids(spark, sf_dir), _grammar(spark, sf_dir)).withColumn("logp", F.round("logp", 6))


@query
def grammar_floors(spark, sf_dir):
    """The levels of the grammar's scores, from parses of 400 drawn sentences: a sample is what is asked for."""
    rows = _rows(spark, sf_dir).withColumn("id", F.concat_ws("/", "doc_id", "sent"))
    drawn = reports.sampled_lengths(rows, 400).persist()
    words = drawn.select("id", "doc_id", "sent", F.posexplode("words").alias("at", "word")).withColumn("i", F.col("at") + 1).drop("at")
    gold = pseudo_gold.tagged(words).select("id", "i", "word", "tag").persist()
    parsed = grammar.parse_sentences(gold, _grammar(spark, sf_dir)).persist()
    found = checks.grammar_floors(parsed, tagging.baseline_tag(gold, tagging.baseline_fit(_gold(spark, sf_dir))))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(found.items())], "name string, level double")


@query
def cky_relational(spark, sf_dir):
    """All chart cells of up to four tags."""
    binary, _ = grammar.split_rules(_grammar(spark, sf_dir))
    leaves = _asked_ids(spark, sf_dir).select("id", "i", F.col("tag").alias("symbol"), F.lit(0.0).alias("logp"))
    return grammar.cky_joins(leaves, binary, 4).withColumn("logp", F.round("logp", 6))


#: Floors of the verdicts, per word: fixed values of the queries.
FLOORS = {"bigram_p02": -9.0, "bigram_p10": -8.0, "trigram_p02": -9.5, "trigram_p10": -8.5, "pcfg_p02": -9.107, "pcfg_p10": -7.812}


def _scored(spark, sf_dir, parsed, asked=None, model=None):
    asked = _asked(spark, sf_dir) if asked is None else asked
    model = ngrams.NgramModel(_rows(spark, sf_dir)) if model is None else model
    two, three = (ngrams.sentence_scores(model, asked, s, "doc_id", "sent") for s in ("witten_bell", "addk"))
    known = ngrams.coverage(asked, model.known_in(asked)).select("doc_id", "sent", "coverage")
    rows = two.select("doc_id", "sent", "n_words", F.col("logp").alias("bigram_logp")).join(three.select("doc_id", "sent", F.col("logp").alias("trigram_logp")), ["doc_id", "sent"]).join(known, ["doc_id", "sent"])
    rows = rows.withColumn("id", F.concat_ws("/", "doc_id", "sent"))
    if parsed is None:
        return rows.withColumn("pcfg_logp", F.lit(None).cast("double"))
    return rows.join(parsed.select("id", F.col("logp").alias("pcfg_logp")), "id", "left")


@query
def method_choice(spark, sf_dir):
    judged = analysis.judge(_scored(spark, sf_dir, None), FLOORS)
    return judged.select("id", "n_words", F.round("bigram_per_word", 4).alias("bigram_per_word"), F.round("trigram_per_word", 4).alias("trigram_per_word"), F.round("coverage", 6).alias("coverage"), "method", "verdict")


@query
def experiment_counters(spark, sf_dir):
    return analysis.counters(analysis.judge(_scored(spark, sf_dir, None), FLOORS))


@query
def lm_calibration(spark, sf_dir):
    """The floors of both language models' per-word scores and the alert levels of the windows' perplexity."""
    judged = analysis.judge(_scored(spark, sf_dir, None), FLOORS).select("bigram_per_word", "trigram_per_word").persist()
    found = [(f"{m}_p{round(100 * s):02d}", v) for m in ("bigram", "trigram") for s, v in zip((0.02, 0.1), ngrams.nearest_rank(judged, f"{m}_per_word", [0.02, 0.1]), strict=True)]
    judged.unpersist()
    windows = window_perplexity(spark, sf_dir)
    found += [(f"window_ppl_p{round(100 * s)}", v) for s, v in zip((0.9, 0.95), ngrams.nearest_rank(windows, "perplexity", [0.9, 0.95]), strict=True)]
    return spark.createDataFrame(found, "name string, value double").withColumn("value", F.round("value", 4))


@query
def tag_improvement(spark, sf_dir):
    """The most frequent tag of each word against one tag for all."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    rows = _baseline(spark, sf_dir).agg(share(F.col("tag") == "NOUN").alias("baseline"), share(F.col("tag") == F.col("pred")).alias("model"))
    return analysis.improvement(rows.select(F.lit("tag accuracy").alias("metric"), "baseline", "model"))


@query
def summary_table(spark, sf_dir):
    return analysis.summary(analysis.judge(_scored(spark, sf_dir, cky_parse(spark, sf_dir)), FLOORS))


def _windows(asked):
    return ngrams.windows(asked, 10).select(F.concat_ws("/", "doc_id", "sent", "i").alias("key"), "words")


def _alerts(windows, model):
    """The checks of the windows, at the level that one in twenty exceeds, from the counts that `model` has made of their text."""
    vocab = model.vocabulary(checks.window_text(windows))
    scored = checks.window_scores(windows, model.with_k(0.001), vocab, spelling.bigram_counts(model.train)).withColumn("perplexity", F.round("perplexity", 4)).persist()
    return checks.fired(scored, checks.window_threshold(scored))


@query
def window_alerts(spark, sf_dir):
    """The grammar check of every window of ten benchmark words, at the level that one in twenty exceeds."""
    return _alerts(_windows(_asked(spark, sf_dir)), ngrams.NgramModel(_rows(spark, sf_dir)))


@query
def window_agreement(spark, sf_dir):
    """Sentences with a window that fired against their final verdict."""
    asked, model = _asked(spark, sf_dir), ngrams.NgramModel(_rows(spark, sf_dir))
    windows = _windows(asked)
    model.counted(asked, checks.window_text(windows))  # both texts in one pass
    flags = _alerts(windows, model).withColumn("id", F.regexp_extract("key", "^(.*)/[0-9]+$", 1)).groupBy("id").agg(F.bool_or("fired").alias("flagged"))
    judged = analysis.judge(_scored(spark, sf_dir, None, asked, model), FLOORS).persist()  # read for the flags too
    flags = judged.select("id").join(flags, "id", "left").select("id", F.coalesce("flagged", F.lit(False)).alias("flagged"))
    return analysis.compare_live(judged, flags)


@query
def count_triggers(spark, sf_dir):
    """(doc_id, trigger, sent, words): the window of the last ten words at every tenth, and the sentence open then."""
    stream = live.token_stream(_docs(spark, sf_dir))
    windows = live.run_batch(stream, None).where("kind = 'WINDOW'")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))
    return windows.select("doc_id", place.cast("long").alias("trigger"), "sent", "words")


@query
def live_alerts(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    stream = live.token_stream(items)
    return live.run_batch(stream, live.check_tokens(stream, _rows(spark, sf_dir)))


@query
def sample_passages(spark, sf_dir):
    return live.sample_passages(_docs(spark, sf_dir))


@query
def merge_sweep(spark, sf_dir):
    return experiments.merge_sweep(_rows(spark, sf_dir))


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    every = SQL | notation_sql(BROWN_SAMPLE, FEATURE_SAMPLE, tags.BROWN_TO_PENN, tags.MORPHOLOGY)
    return {name: every[name] for name in _found if name in every}
