import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from quillstream.operators import analysis, corpus, grammar, ngrams, parsing, segmentation, spelling, tagging
from quillstream.plans import experiments, pseudo_gold

TEXT = ["the cat sat. the dog ran. the cat ran.", "a dog sat on the mat. the cats sat.", None, "", "the mat. the cat sat on the mat."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "s") for k, t in enumerate(TEXT)], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def w(docs):
    return corpus.words(docs).persist()


def test_sentences_and_spans(w):
    rows = corpus.spans(w).where("doc_id = 0 and sent = 1").orderBy("i").collect()
    assert [(r.word, r.span_start, r.span_end) for r in rows] == [("the", 0, 3), ("dog", 3, 6), ("ran", 6, 9)]


def test_split_sizes_are_exact(spark):
    df = spark.createDataFrame([(k, "g" if k < 55 else None) for k in range(80)], "doc_id long, source string")
    got = {(r.source, r.split): r["count"] for r in corpus.stratified_split(df).groupBy("source", "split").count().collect()}
    assert got == {("g", "train"): 44, ("g", "dev"): 5, ("g", "test"): 6, (None, "train"): 20, (None, "dev"): 2, (None, "test"): 3}


@pytest.mark.parametrize("smoothing", ["witten_bell", "addk", "continuation"])
@pytest.mark.parametrize("threshold", [0, 1])
def test_normalisation_covers_every_context(w, smoothing, threshold):
    model = ngrams.NgramModel(w, threshold=threshold)
    got = {(r.h2, r.h1): r.total for r in ngrams.normalisation(model, smoothing).collect()}
    grams = {tuple(r): n for *r, n in ((r.h2, r.h1, r.word, r.cnt) for r in model.gram[3].collect())}
    pairs, singles = {}, {}
    for (_, h, x), n in grams.items():
        pairs[h, x] = pairs.get((h, x), 0) + (1 if smoothing == "continuation" else n)
    raw = pairs if smoothing != "continuation" else dict.fromkeys({(h, x) for _, h, x in grams}, 1)
    for (_, x), n in raw.items():
        singles[x] = singles.get(x, 0) + n
    vocab = {r.word for r in model.known.collect()} | {"<unk>", "</s>"}
    k, v = model.k, len(vocab)

    def p(x, *context):
        if not context:
            return (singles.get(x, 0) + k) / (sum(singles.values()) + k * v)
        table = {1: pairs, 2: grams}[len(context)]
        after = [n for g, n in table.items() if g[:-1] == context]
        c, t, d = table.get((*context, x), 0), sum(after), len(after)
        if smoothing == "addk":
            return (c + k) / (t + k * v)
        low = p(x, *context[1:])
        return (c + d * low) / (t + d) if smoothing == "witten_bell" else max(c - model.discount, 0) / t + model.discount * d / t * low

    contexts = {(None, h) for h, _ in pairs} | ({g[:2] for g in grams} if smoothing != "continuation" else set())
    assert set(got) == contexts
    for h2, h1 in contexts:
        assert got[h2, h1] == pytest.approx(sum(p(x, *([h2] if h2 else []), h1) for x in vocab), abs=1e-9)


@pytest.mark.parametrize("smoothing", ["witten_bell", "addk"])
def test_probabilities_sum_to_one(spark, w, smoothing):
    model = ngrams.NgramModel(w, order=2, threshold=0)
    vocab = [r.word for r in model.known.collect()] + ["<unk>", "</s>"]
    if smoothing == "addk":
        seen = ["the", "<s>"]
    else:
        seen = ["the", "<s>", "mat"]
    gram = {(r.h1, r.word): r.cnt for r in model.gram[2].collect()}
    one = {r.word: r.cnt for r in model.gram[1].collect()}
    n_all, v = model.size.first()
    for h in seen:
        t, d = sum(c for (a, _), c in gram.items() if a == h), sum(a == h for a, _ in gram)
        rows = spark.createDataFrame([(one.get(x, 0), gram.get((h, x), 0), t, d, n_all, v) for x in vocab], "c1 long, c2 long, t2 long, d2 long, n_all long, v long")
        assert rows.agg(F.sum(model.probability(smoothing))).first()[0] == pytest.approx(1.0)


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3, 6)], "x double")
    assert ngrams.nearest_rank(df, "x", [0.0, 0.1, 0.3, 0.5, 1.0]) == [1.0, 1.0, 3.0, 3.0, 6.0]
    assert ngrams.nearest_rank(df.limit(0), "x", [0.5]) == [None]


def test_methods_agree_and_correct(spark, w):
    vocab = corpus.vocabulary(w)
    asked = spark.createDataFrame([("teh",), ("dgo",), ("cet",), ("mats",), ("zzzz",)], "query string")
    a, b, both = ({(r.query, r.cand) for r in spelling.candidates(asked, vocab, m).collect()} for m in ("A", "B", "both"))
    assert a == b == both and ("teh", "the") in a and ("mats", "mat") in a
    tests = spark.createDataFrame([("teh", "the"), ("zzzz", "z")], "corrupted string, original string")
    got = {r.corrupted: (r.corrected, r.is_right) for r in spelling.correct_nonwords(tests, vocab).collect()}
    assert got == {"teh": ("the", True), "zzzz": ("zzzz", False)}
    with pytest.raises(ValueError):
        spelling.candidates(asked, vocab, "C")


def test_sentence_correction_keeps_marks_and_case(spark, w):
    corrector = spelling.SpellingCorrector(corpus.vocabulary(w), spelling.bigram_counts(w), threshold=0.2)
    rows = spark.createDataFrame([(1, "Teh (cat) sat, 3 times!"), (2, "zzzz don't"), (3, ""), (4, "THE dgo ran.")], "id long, text string")
    got = {r.id: r.corrected for r in corrector.correct(rows).collect()}
    assert got[1].startswith("The (") and got[1].endswith(", 3 times!") and got[2] == "zzzz don't" and got[3] == "" and got[4].split()[0] == "THE" and got[4].endswith("ran.")


def test_dynamic_program_beats_greedy(spark):
    train = corpus.words(spark.createDataFrame([(k, "theta ble the table is here. the table theta.") for k in range(4)], "doc_id long, text string"))
    strings = spark.createDataFrame([("thetable",), ("",)], "chars string")
    known = ngrams.known_words(train)
    greedy = {r.chars: r.words for r in segmentation.greedy(strings, known).collect()}
    best = {r.chars: r.words for r in segmentation.segment(strings, train, segmentation.DecoderConfig(beam_width=None)).collect()}
    assert greedy["thetable"] == "theta ble" and best["thetable"] == "the table" and greedy[""] == best[""] == ""


def test_exact_decoding_is_optimal(spark, w):
    strings = spark.createDataFrame([("thecats",)], "chars string")
    part, model = next(segmentation.local_models(strings, w, 3))
    words = segmentation.decode("thecats", model, segmentation.DecoderConfig(beam_width=None))
    every = []
    for cuts in itertools.product((0, 1), repeat=6):
        out, last = [], 0
        for i, c in enumerate(cuts):
            if c:
                out.append("thecats"[last : i + 1])
                last = i + 1
        every.append([*out, "thecats"[last:]])
    assert model.sentence(words) == pytest.approx(max(map(model.sentence, every)))


def test_models_are_split_beyond_the_limit(spark, w):
    strings = spark.createDataFrame([(c,) for c in ("thecat", "adog", "onthemat", "satran")], "chars string")
    parts = list(segmentation.local_models(strings, w, 2, limit=12))
    assert len(parts) > 1 and sorted(r.chars for p, _ in parts for r in p.collect()) == ["adog", "onthemat", "satran", "thecat"]


def test_scores_of_segmentation(spark):
    gold = spark.createDataFrame([("k", "ab", 0, 2), ("k", "c", 2, 3), ("k", "d", 3, 4)], "key string, word string, span_start int, span_end int")
    pred = spark.createDataFrame([("k", "ab", 0, 2), ("k", "cd", 2, 4)], "key string, word string, span_start int, span_end int")
    r = segmentation.segmentation_scores(gold, pred).first()
    assert (r.n_gold, r.n_pred, r.n_matched, r.precision, r.f1, r.n_exact) == (3, 2, 1, 0.5, 0.4, 0) and r.boundary_f1 == round(2 / 3, 6)
    assert {(x.gold_word, x.found) for x in segmentation.overlap_errors(gold, pred).collect()} == {("c", "cd"), ("d", "cd")}


def test_viterbi_is_optimal(spark, w):
    gold = pseudo_gold.tagged(w)
    h = tagging.tag_histories(gold)
    table = tagging.transition_dict(h, tagging.interpolation_weights(h))
    options = [[("DET", -0.5), ("NOUN", -1.0)], [("NOUN", -0.2), ("VERB", -0.9)], [("ADJ", -0.3), ("VERB", -0.4), ("DET", -2.0)]]

    def score(path):
        state, out = (tagging.BEGIN, tagging.BEGIN), 0.0
        for i, t in enumerate([*path, tagging.END]):
            after = table.get(state) or table.get(("", state[1])) or table["", ""]
            out += after.get(t, -math.inf) + (dict(options[i])[t] if i < len(options) else 0.0)
            state = (state[1], t)
        return out

    best = tagging.viterbi(options, table, "NOUN")
    assert score(best) == pytest.approx(max(score(p) for p in itertools.product(*([t for t, _ in o] for o in options))))
    assert tagging.viterbi([], table, "NOUN") == []
    weights = [r.weight for r in tagging.interpolation_weights(h).collect()]
    assert sum(weights) == pytest.approx(1.0)
    sums = tagging.transition_table(h, tagging.interpolation_weights(h)).groupBy("h2", "h1").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)


def test_suffix_distribution_sums_to_one(spark, w):
    gold = pseudo_gold.tagged(w)
    suffixes = tagging.suffix_counts(gold)
    d = tagging.suffix_distribution(spark.createDataFrame([("batmat",), ("x",)], "word string"), suffixes, tagging.suffix_base(suffixes, gold))
    assert all(r.s == pytest.approx(1.0) for r in d.groupBy("word").agg(F.sum("p").alias("s")).collect())


def test_oracle_rebuilds_projective_trees():
    tags, heads, rels = ["D", "N", "V", "D", "N"], [2, 3, 0, 5, 3], ["det", "nsubj", "root", "det", "obj"]
    steps = parsing.oracle(tags, heads, rels)
    assert [t for _, t in steps][:4] == ["SHIFT", "SHIFT", "LEFT-ARC(det)", "SHIFT"] and len(steps) == 2 * len(tags)
    ranked = {f: [t] for f, t in steps}
    arcs = parsing.parse(tags, ranked)
    assert len(arcs) == len(tags)
    assert parsing.oracle([], [], []) == []
    crossed = parsing.oracle(["A", "B", "C", "D"], [3, 4, 0, 3], ["r"] * 4)
    assert [t for _, t in crossed].count("SHIFT") == 4


def test_classifier_learns_the_oracle(spark, w):
    gold = pseudo_gold.with_heads(pseudo_gold.tagged(w))
    model = parsing.classifier(parsing.oracle_instances(gold), rounds=20)
    ranked = parsing.rankings(model, ["ADJ", "ADV", "DET", "NOUN", "VERB"])
    score = parsing.attachment(gold, parsing.parse_sentences(gold, ranked)).first()
    assert score.n_tokens == w.count() and score.las > 40


def test_trees_and_rules(spark):
    assert grammar.read_tree("( (S (NP (D the) (N cat)) (VP (V sat))))")[0] == "S" and grammar.read_tree("(S (") is None
    rules = grammar.binarise(grammar.read_tree("(S (A a) (B b) (C c) (D d))"))
    assert ("S", "A", "S|<B-C>") in rules and ("S|<C-D>", "C", "D") in rules and ("A", "a", None) in rules
    g = grammar.rule_probabilities(grammar.productions(spark.createDataFrame([("(S (A a) (B b))",), ("(S (A c) (B b))",), (None,)], "tree string")), 1)
    assert all(r.s == pytest.approx(1.0) for r in g.groupBy("lhs").agg(F.sum(F.exp("logp")).alias("s")).collect())


def test_chart_by_function_and_by_joins(spark):
    trees = ["(S (NP (D the) (N cat)) (VP (V saw) (NP (D a) (N dog))))", "(S (NP (D a) (N dog)) (VP (V saw) (NP (D the) (N cat))))"]
    g = grammar.rule_probabilities(grammar.productions(spark.createDataFrame([(t,) for t in trees], "tree string")))
    rows = spark.createDataFrame([("x", i + 1, t, p) for i, (t, p) in enumerate(zip("the dog saw the owl".split(), "DNVDN"))], "id string, i long, word string, tag string")
    r = grammar.parse_sentences(rows, g).first()
    binary, lexical = grammar.split_rules(g)
    leaves = rows.join(lexical, rows.word == lexical.word, "left").select("id", "i", F.coalesce("lhs", "tag").alias("symbol"), F.coalesce("logp", F.lit(0.0)).alias("logp"))
    top = grammar.cky_joins(leaves, binary, 5).where("i = 1 and j = 5 and symbol = 'S'").first()
    assert r.logp == pytest.approx(top.logp) and r.parse == "(S (NP (D the) (N dog)) (VP (V saw) (NP (D the) (N owl))))"
    assert not grammar.is_root("S|<A-B>") and grammar.is_root("SBAR")


def test_verdicts_and_agreement(spark):
    rows = spark.createDataFrame([("a", 4, -20.0, -20.0, -20.0, 1.0), ("b", 4, None, -50.0, -45.0, 0.9), ("c", 4, None, -30.0, -1.0, 0.5)], "id string, n_words int, pcfg_logp double, bigram_logp double, trigram_logp double, coverage double")
    floors = {"pcfg_p02": -5.0, "pcfg_p10": -4.5, "bigram_p02": -9.0, "bigram_p10": -5.0, "trigram_p02": -8.0, "trigram_p10": -6.0}
    judged = analysis.judge(rows, floors)
    assert {(r.id, r.method, r.verdict) for r in judged.collect()} == {("a", "pcfg", "grammatical"), ("b", "trigram", "ungrammatical"), ("c", "bigram", "borderline")}
    live = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "id string, flagged boolean")
    r = analysis.compare_live(judged, live).first()
    assert (r.both_flagged, r.live_only, r.final_only, r.neither) == (1, 1, 1, 0)
    assert len(analysis.summary(judged).columns) == 9


def test_improvement_and_counters(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.75), ("b", 1.0, 1.0)], "metric string, baseline double, model double")
    assert [(r.gain, r.error_reduction) for r in analysis.improvement(rows).orderBy("metric").collect()] == [(0.25, 0.5), (0.0, None)]
    judged = spark.createDataFrame([("bigram", "grammatical")] * 2 + [("bigram", None)], "method string, verdict string")
    assert sorted(r.n for r in analysis.counters(judged).collect()) == [1, 2]


def test_tuning_grid_takes_the_first_best(spark):
    rows = [(s, 0, i + 1, x) for s in range(6) for i, x in enumerate(("the", "big", "dog") if s % 2 else ("a", "red", "cat"))]
    few = spark.createDataFrame(rows, "doc_id long, sent long, i long, word string")
    found = experiments.tune_segmentation(few, few, penalties=(0.0, -8.0), beams=(4, 8)).collect()
    best = max(found[:2], key=lambda r: r.f1).penalty
    assert [(r.penalty, r.beam) for r in found] == [(0.0, 8), (-8.0, 8), (best, 4)]
    assert max(r.f1 for r in found) == 1.0


def test_sentences_are_cut_in_the_row(spark):
    rows = [(1, 'One two. Three "four five!" J. Smith said so.'), (2, ""), (3, None), (4, "No end"), (5, "Ends. 12 .")]
    found = corpus.sentences(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.sent) for r in found if r.doc_id == 1] == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 1), (1, 5, 1), (1, 6, 2), (1, 7, 2), (1, 8, 2), (1, 9, 2)]
    assert [(r.doc_id, r.sent) for r in found if r.doc_id > 1] == [(4, 0), (4, 0), (5, 0), (5, 1), (5, 1)]


def window_model(spark):
    from quillstream.operators import checks

    rows = spark.createDataFrame([(k, 0, s.split()) for k, s in enumerate(["the cat sat on the mat"] * 20 + ["the dog ran to the house"] * 20 + ["the cut hurt him"] * 3)], "doc_id long, sent int, words array<string>")
    return checks, rows, ngrams.NgramModel(rows, k=0.001)


def test_a_window_fires_on_odd_words_and_on_real_word_errors(spark):
    checks, rows, model = window_model(spark)
    windows = spark.createDataFrame([("clean", "the cat sat on the mat".split()), ("odd", "mat on to sat ran the".split()), ("real", "the cut sat on the mat".split()), ("none", [])], "key string, words array<string>")
    scored = checks.window_scores(windows, model, corpus.vocabulary(rows), spelling.bigram_counts(rows)).persist()
    got = {r.key: r for r in scored.collect()}
    assert set(got) == {"clean", "odd", "real"} and got["odd"].perplexity > 5 * got["clean"].perplexity
    assert got["clean"].n_fixes == 0 and got["real"].n_fixes == 1
    by = {r.key: r.fired for r in checks.fired(scored, got["real"].perplexity + 1).collect()}
    assert by == {"clean": False, "odd": True, "real": True}
    assert checks.window_threshold(scored) == max(r.perplexity for r in got.values()) and checks.window_threshold(scored.limit(0)) == float("inf")


def test_ngram_counts_are_those_of_tokens(spark):
    rows = spark.createDataFrame([(1, 0, "a b a c".split()), (1, 1, ["b"]), (2, 0, "a a b d".split())], "doc_id long, sent int, words array<string>")
    tokens = rows.select("doc_id", "sent", F.posexplode("words").alias("at", "word")).select("doc_id", "sent", (F.col("at") + 1).alias("i"), "word")
    model = ngrams.NgramModel(rows)
    h = ngrams.histories(ngrams.closed(tokens, model.known))
    for n in (1, 2, 3):
        cols = [*(f"h{k}" for k in range(n - 1, 0, -1)), "word", "cnt"]
        assert sorted(tuple(r) for r in model.gram[n].select(cols).collect()) == sorted(tuple(r) for r in ngrams.ngram_counts(h, n).select(cols).collect())
    again = ngrams.NgramModel(tokens)
    assert sorted(map(tuple, again.gram[3].collect())) == sorted(map(tuple, model.gram[3].collect()))


def test_small_reports(spark):
    from quillstream.operators import reports

    cells = spark.createDataFrame([("N", "N", 9), ("N", "V", 4), ("V", "N", 4), ("V", "V", 2), ("A", "N", 1)], "gold string, pred string, cnt long")
    assert [tuple(r) for r in reports.most_confused(cells, 2).collect()] == [("N", "V", 4), ("V", "N", 4)] and reports.common_tags(cells, 2) == ["N", "V"]
    rows = spark.createDataFrame([("a", 30, 0.5), ("b", 10, 0.1), ("c", 20, 0.5), ("d", 25, 0.2)], "tag string, n_gold long, f1 double")
    assert [r.tag for r in reports.weakest(rows, 20, 2).collect()] == ["d", "a"]
    t = spark.createDataFrame([(float(k),) for k in range(1, 101)] + [(None,)], "ms double")
    assert tuple(reports.latency(t).first()) == (100, 50.5, 95.0, 100.0) and tuple(reports.latency(t.limit(0)).first()) == (0, None, None, None)
    two = spark.createDataFrame([(1, ["a", "b"], ["a", "x"])], "id int, o array<string>, n array<string>")
    assert two.select(reports.highlighted(F.col("o"), F.col("n"))).first()[0] == "a [x]" and [tuple(r) for r in reports.changes(two, "id", "o", "n").collect()] == [(1, 2, "b", "x")]
    assert spark.range(1).select(reports.percent(F.lit(0.95611))).first()[0] == "95.61%"
    sents = spark.createDataFrame([(k, ["w"] * k) for k in range(40)], "id int, words array<string>")
    got = [r.id for r in reports.sampled_lengths(sents, 5).collect()]
    assert len(set(got)) == 5 and all(3 <= k <= 25 for k in got) and got == [r.id for r in reports.sampled_lengths(sents, 5).collect()]
    strings = spark.createDataFrame([("abc", "a bc"), ("xy", "x y"), ("q", "q")], "chars string, words string")
    vocab = spark.createDataFrame([("a",), ("bc",), ("x",)], "word string")
    assert sorted(tuple(r) for r in reports.unreachable(strings, vocab).collect()) == [("q", "q"), ("xy", "y")]


def test_order_of_the_tagger_and_its_choice(spark):
    rows = [(k, 0, i + 1, w, t) for k in range(12) for i, (w, t) in enumerate([("the", "DET"), ("dog", "NOUN"), ("runs", "VERB")])]
    tagged = spark.createDataFrame(rows, "doc_id long, sent long, i int, word string, tag string")
    chosen = tagging.choose_order(tagged, tagged).collect()
    assert [(r.n, r.accuracy, r.chosen) for r in chosen] == [(2, 1.0, False), (3, 1.0, True)]
    with pytest.raises(ValueError):
        tagging.viterbi_tags(tagged, tagged, order=4)


def test_floors_are_merged_and_read(spark, tmp_path):
    from quillstream.operators import checks

    path = str(tmp_path / "floors")
    assert checks.read_floors(spark, path) == {}
    checks.write_floors(spark, path, {"a": 1.0, "b": 2.0})
    assert checks.write_floors(spark, path, {"b": 3.0}) == {"a": 1.0, "b": 3.0} == checks.read_floors(spark, str(tmp_path / "none"), path)
    parsed = spark.createDataFrame([("1", 3, -8.0), ("2", 3, None), ("3", 30, None), ("4", 4, -5.0)], "id string, n_words int, logp double")
    tags = spark.createDataFrame([("1", "A", "A"), ("2", "A", "B"), ("3", "A", "B")], "id string, tag string, pred string")
    got = checks.grammar_floors(parsed, tags)
    assert (got["pcfg_p02"], got["pcfg_median"], got["n_sampled"], got["tag_agreement"]) == (-2.0, -2.0, 3.0, 0.5) and got["parse_rate"] == pytest.approx(2 / 3)


def test_ngrams_are_shuffled_once_and_only_those_asked_for(spark):
    rows = spark.createDataFrame([(1, 0, "a b a c".split()), (1, 1, ["b"]), (2, 0, "a a b d".split())], "doc_id long, sent int, words array<string>")
    model = ngrams.NgramModel(rows)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(model.gram[3]).count("Exchange hashpartitioning(h2") == 1
    asked = spark.createDataFrame([("a", "b")], "h2 string, h1 string")
    narrow = ngrams.among(model.gram[3], asked, ["h2", "h1"])
    lines = plan(narrow).splitlines()
    assert min(k for k, x in enumerate(lines) if "LeftSemi" in x) > min(k for k, x in enumerate(lines) if "Exchange hashpartitioning(h2" in x)
    assert sorted(tuple(r) for r in narrow.select("h2", "h1", "word", "cnt").collect()) == [("a", "b", "<unk>", 1), ("a", "b", "a", 1)]


def test_a_large_file_is_dealt_out(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(k, "some text") for k in range(500)], "doc_id long, text string").coalesce(1).write.parquet(path)
    monkeypatch.setattr(corpus, "TASK_BYTES", 64)
    monkeypatch.setattr(corpus, "SMALL_SHARE", 64, raising=False)
    docs = spark.read.parquet(path)
    assert corpus.word_rows(docs).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_local_models_hold_neighbours_only(spark):
    rows = spark.createDataFrame([(k, 0, s.split()) for k, s in enumerate(["ab cd ab", "cd ab cd", "xy ab xy"] * 2)], "doc_id long, sent int, words array<string>")
    strings = spark.createDataFrame([("abcd",), ("xy",)], "chars string")
    parts = list(segmentation.local_models(strings, rows, 2))
    assert len(parts) == 1 and parts[0][1].known == {"ab", "cd", "xy"}
    grams = {g for g in parts[0][1].grams if len(g) == 2}
    assert ("ab", "cd") in grams and ("cd", "</s>") in grams and not grams & {("cd", "ab"), ("xy", "ab")}


def test_long_sentences_are_parsed_too(spark):
    n = 40
    tree = "(S " + " ".join(f"(D w{k})" for k in range(n)) + ")"
    g = grammar.rule_probabilities(grammar.productions(spark.createDataFrame([(tree,)] * 2, "tree string")))
    rows = spark.createDataFrame([("x", k + 1, f"w{k}", "D") for k in range(n)] + [("y", k + 1, f"w{k}", "D") for k in range(4)], "id string, i long, word string, tag string")
    got = {r.id: r for r in grammar.parse_sentences(rows, g).collect()}
    assert got["x"].n_words == n and got["x"].parse is not None and got["y"].parse is not None
    capped = {r.id: r.parse is None for r in grammar.parse_sentences(rows, g, longest=25).collect()}
    assert capped == {"x": True, "y": False}


def test_merge_shares_read_the_text_once(spark, w):
    rows = corpus.rows_of(w).select("doc_id", "sent", "words")
    found = experiments.merge_sweep(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    for r in found.collect():
        tokens = corpus.inject_merges(w, r.share).collect()
        assert (r.n_tokens, r.n_merged) == (len(tokens), sum(t.merged - 1 for t in tokens))


def test_best_of_deletions_is_the_best_of_all_pairs(spark):
    from quillstream.functions.edits import lookup_keys, offered_keys

    words = [a + b for a in ("", "a", "ab", "né", "aab", "ñu") for b in ("a", "b", "ba", "aba", "é", "ééa", "xyz")]
    vocab = spark.createDataFrame([(w, 1 + n % 3) for n, w in enumerate(sorted(set(words)))], "word string, cnt long")
    asked = spark.createDataFrame([(w,) for w in {x + y for x in ("a", "b", "ab", "éa", "nn", "abb") for y in ("", "b", "c", "ab", "é", "yxz")}], "query string").join(vocab.withColumnRenamed("word", "query"), "query", "left_anti")
    want = {tuple(r) for r in spelling.best_by_count(spelling.candidates(asked, vocab), vocab).collect()}
    assert {tuple(r) for r in spelling.best_of_deletions(asked, vocab).collect()} == want and len(want) > 15
    # Two words of n letters share at most n keys, however many others do; under a key there is one word to join.
    near = spark.range(1).select(F.size(F.array_intersect(lookup_keys(F.lit("abc")), offered_keys(F.lit("xbc")))), F.size(F.array_intersect(lookup_keys(F.lit("abc")), offered_keys(F.lit("bcd")))))
    assert tuple(near.first()) == (1, 0)


def test_tests_counted_before_they_are_joined_are_the_tests(spark):
    rows = spark.createDataFrame([(d, 0, ["house", "mouse", "tree"]) for d in range(40)] + [(99, 0, ["a"])], "doc_id long, sent long, words array<string>")
    vocab = corpus.vocabulary(rows)
    one = {tuple(r) for r in spelling.test_words(rows, vocab).groupBy("kind", "original", "corrupted").count().select("kind", "original", "corrupted", "count").collect()}
    assert {tuple(r) for r in spelling.test_counts(rows, vocab).select("kind", "original", "corrupted", "n").collect()} == one and one


def test_benchmark_words_are_made_of_distinct_words_not_of_tokens(spark):
    rows = spark.createDataFrame([(1, 0, ["house"] * 5 + ["mouse"])], "doc_id long, sent long, words array<string>")
    plan = spelling.benchmark_words(corpus.vocabulary(rows), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and all("md5" not in line for line in plan.split("InMemoryRelation")[1].splitlines()[1:6])


def _as_rows(rows, *drop):
    return sorted(tuple(r) for r in rows.drop(*drop).collect())


def test_gold_made_inside_the_row_is_that_of_the_words(spark, docs, w):
    rows = corpus.word_rows(docs)
    one, other = pseudo_gold.tagged(rows), pseudo_gold.tagged(w)
    assert _as_rows(one, "features") == _as_rows(other, "features") and one.select("features").collect() != []
    assert "Exchange" not in pseudo_gold.tagged(rows.limit(100).persist())._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    for morph in (False, True):
        tagged = other.withColumn("tag", F.col("morph")) if morph else other
        made = pseudo_gold.tagged_rows(rows, morph)
        assert _as_rows(tagging.tag_ngrams(tagging.tag_histories(made), 3)) == _as_rows(tagging.tag_ngrams(tagging.tag_histories(tagged), 3))
        assert _as_rows(tagging.emissions(made).select("tag", "word", "cnt")) == _as_rows(tagging.emissions(tagged).select("tag", "word", "cnt"))


def test_instances_counted_in_batches_are_the_instances(spark, docs, w):
    names = ["s0", "s1", "b0", "b1", "label"]
    want = parsing.oracle_instances(pseudo_gold.with_heads(pseudo_gold.tagged(w))).groupBy(*names).count()
    got = parsing.oracle_counts(pseudo_gold.tree_rows(corpus.word_rows(docs)))
    assert _as_rows(got.select(*names, "n")) == _as_rows(want) and want.count() > 10
    assert parsing.oracle_counts(spark.createDataFrame([([], [], [])], "tags array<string>, heads array<long>, deprels array<string>")).count() == 0


def test_chart_reads_rules_and_shorter_cells_from_memory(spark):
    leaves = spark.createDataFrame([("x", i, "N", 0.0) for i in range(1, 5)], "id string, i int, symbol string, logp double")
    rules = grammar.rule_probabilities(spark.createDataFrame([("N", "N", "N", 2)], "lhs string, b string, c string, n long"))
    plan = grammar.cky_joins(leaves, grammar.split_rules(rules)[0], 4)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert plan.where("i = 1 and j = 4").count() == 1


def test_pair_scores_are_read_from_memory_by_both_neighbours(spark, w):
    scored = spelling.realword_scores(w, corpus.vocabulary(w), spelling.bigram_counts(w))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"InMemoryRelation \[[^\]]*(?:logp|before|after)#\d+\]", plan)) == 2


@pytest.mark.parametrize(("order", "threshold"), [(2, 1), (3, 1), (3, 0), (4, 1)])
def test_asked_ngrams_are_counted_in_one_pass_that_keeps_no_sentence(spark, monkeypatch, order, threshold):
    import random

    from quillstream.operators import asked

    draw, text = random.Random(order), []
    for k in range(60):  # many words met once, side by side too, and sentences of one word
        text.append([draw.choice("aabbbcde") if draw.random() < 0.6 else f"w{draw.randrange(90)}" for _ in range(draw.randrange(1, 9))])
    kind = "doc_id long, sent int, words array<string>"
    rows = spark.createDataFrame([(k, 0, w) for k, w in enumerate(text)], kind)
    few = spark.createDataFrame([(k, 0, w) for k, w in enumerate(text[:9] + [["new", "a", "b"], ["a", "new", "old", "b"]])], kind)
    monkeypatch.setattr(asked, "CHUNK", 40)
    spark.catalog.clearCache()
    got = ngrams.NgramModel(rows, order, threshold=threshold).looked_up(few)
    found = sorted(map(tuple, got.select(sorted(got.columns)).collect()))
    assert not [x.name() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo() if "line" in x.name()]
    monkeypatch.setattr(ngrams, "FEW", 0)  # by joins, as for texts of any size
    want = ngrams.NgramModel(rows, order, threshold=threshold).looked_up(few)
    assert sorted(got.columns) == sorted(want.columns) and found == sorted(map(tuple, want.select(sorted(want.columns)).collect()))


def test_two_texts_are_counted_in_one_pass(spark):
    checks, rows, model = window_model(spark)
    windows = spark.createDataFrame([("clean", "the cat sat on the mat".split()), ("odd", "mat on to sat ran the".split())], "key string, words array<string>")
    text = rows.where("doc_id < 5").select("doc_id", "sent", F.posexplode("words").alias("at", "word")).select("doc_id", "sent", (F.col("at") + 1).alias("i"), "word")
    model.counted(text, checks.window_text(windows))
    scored = checks.window_scores(windows, model.with_k(0.001), model.vocabulary(text), spelling.bigram_counts(model.train))
    assert scored.count() == 2 and ngrams.sentence_scores(model, text, "addk", "doc_id", "sent").count() == 5
    assert len(model._counted) == 1 and sorted(map(tuple, model.vocabulary(text).collect())) == sorted(map(tuple, corpus.vocabulary(rows).collect()))
