import os

from pyspark.sql import functions as F

from quillstream.sources import corpora
from quillstream.streaming import live

CONLLU = "# sent_id = 1\n1-2\tDel\t_\t_\t_\t_\t_\t_\t_\t_\n1\tLa\tel\tDET\t_\tGender=Fem|Number=Sing\t2\tdet\t_\t_\n2\tCasa\tcasa\tNOUN\t_\tGender=Fem|Number=Sing\t0\troot\t_\t_\n2.1\tx\tx\tX\t_\t_\t_\t_\t_\t_\n  \n# two\n1\t.\t.\tPUNCT\t_\t_\t0\troot\t_\t_\n2\tbad line\n"


def test_readers(spark, tmp_path):
    (tmp_path / "ca01").write_text("The/at dog/nn-tl isn't/bez* $/sym ./.\n\n\tA/at/nn b/zz\n")
    rows = corpora.read_tagged(spark, str(tmp_path / "ca01")).orderBy("sent_id", "pos").collect()
    assert [(r.sent_id, r.form, r.tag) for r in rows] == [("brown-ca01-0", "the", "DT"), ("brown-ca01-0", "dog", "NN"), ("brown-ca01-0", "isnt", "VBZ"), ("brown-ca01-1", "aat", "NN"), ("brown-ca01-1", "b", "X")]
    bank = tmp_path / "bank"
    bank.mkdir()
    (bank / "es-train.conllu").write_text(CONLLU)
    tokens = corpora.read_conllu(spark, str(bank / "*.conllu")).orderBy("sent", "id").collect()
    assert [(r.sent, r.id, r.form, r.head) for r in tokens] == [(0, 1, "La", 2), (0, 2, "Casa", 0), (1, 1, ".", 0)]
    loaded = corpora.load_treebank(spark, str(bank)).orderBy("id").collect()
    assert [(r.form, r.split, r.features["Gender"]) for r in loaded] == [("la", "train", "Fem"), ("casa", "train", "Fem")]
    (tmp_path / "trees").write_text("(S (A a))\n\n(S (B b))\n")
    assert corpora.read_trees(spark, str(tmp_path / "trees")).count() == 2


def test_missing_treebank(spark, tmp_path):
    try:
        corpora.load_treebank(spark, str(tmp_path))
    except FileNotFoundError:
        return
    raise AssertionError


def test_store_builds_once(spark, tmp_path):
    store, calls = corpora.ModelStore(spark, str(tmp_path / "m")), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert store.load_or_build("t", build).count() == 3 and store.load_or_build("t", build).count() == 3 and len(calls) == 1
    store.save_params("p", {"k": 1.5, "a": [1]})
    assert store.load_params("p") == {"k": 1.5, "a": [1]}
    assert "id" in corpora.write_report(spark.range(2), str(tmp_path / "r"), "Title")


CHECKED = "doc_id long, ord long, words string, merges long, fixes long, alerts string, ends boolean, last boolean"


def stream_rows():
    rows = []
    for doc in (1, 2):
        for k in range(1, 38):
            words = f"w{k} v{k}" if k % 7 == 0 else f"w{k}" if k % 11 else ""
            alerts = "SEGMENT" if k % 7 == 0 else "SPELL,SPELL" if k == 12 else ""
            rows.append((doc, k, words, int(k % 7 == 0), 2 if k == 12 else 0, alerts, k % 9 == 0, k == 37))
    return rows


def events(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_and_batch_agree(spark, tmp_path):
    rows = stream_rows()
    checked = spark.createDataFrame(rows, CHECKED)
    source = tmp_path / "in"
    for part in range(4):
        spark.createDataFrame([r for r in rows if (r[1] - 1) // 10 == part], CHECKED).coalesce(1).write.mode("append").parquet(str(source / f"p{part}"))
    stream = spark.readStream.schema(CHECKED).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = live.run_stream(stream).writeStream.format("memory").queryName("live_events").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = events(spark.table("live_events"))
    tokens = checked.select("doc_id", "ord", F.concat(F.lit("t"), "ord").alias("token"), "ends")
    table = checked.where("doc_id = 1").select(F.concat(F.lit("t"), "ord").alias("token"), "words", "merges", "fixes", "alerts")
    want = events(live.run_batch(tokens, table))
    assert got == want and {e[2] for e in got} == {"SEGMENT", "SPELL", "WINDOW", "SENTENCE"}


def test_window_flag_falls_on_the_next_sentence():
    tokens = [(f"w{k}", 0, 0, "", k == 9) for k in range(10)]
    kinds = lambda fix: [(e[2], e[3]) for e in live.advance(1, live.LiveState(), iter(tokens), 10, fix)]
    assert kinds(False) == [("WINDOW", 1), ("SENTENCE", 0)] and kinds(True) == [("WINDOW", 0), ("SENTENCE", 0)]


def test_one_trigger_for_a_token_of_many_words():
    state = live.LiveState()
    out = list(live.advance(1, state, iter([(" ".join("abcdefghijklmnopqrstuvwxy"), 24, 0, "", False)]), 10))
    assert [e[2] for e in out] == ["WINDOW"] and state.next_trigger == 20 and len(state.last) == 10
    assert [e[2] for e in live.close(1, state)] == ["SENTENCE"] and list(live.close(1, live.LiveState())) == []


def test_grammar_alerts_flag_their_sentences(spark):
    columns = "doc_id long, seq long, kind string, sent long, words string, merges long, fixes long, flagged boolean"
    events = spark.createDataFrame([(1, 1, "WINDOW", 0, "a b", 0, 0, False), (1, 2, "SENTENCE", 0, "a b", 0, 0, False), (1, 3, "WINDOW", 1, "b c", 0, 0, False), (1, 4, "SENTENCE", 1, "c", 0, 0, False)], columns)
    checked = spark.createDataFrame([("1/1", False), ("1/3", True)], "key string, fired boolean")
    got = live.with_grammar(events, checked)
    assert sorted((r.seq, r.kind, r.flagged) for r in got.collect()) == [(1, "WINDOW", False), (2, "SENTENCE", False), (3, "GRAMMAR", True), (3, "WINDOW", False), (4, "SENTENCE", True)]
    assert sorted((r.sent, r.flagged) for r in live.sentence_flags(got).collect()) == [(0, False), (1, True)]
    late = got.where("kind = 'GRAMMAR'").unionByName(events)  # the alert of one batch, the sentence of another
    assert sorted((r.sent, r.flagged) for r in live.sentence_flags(late).collect()) == [(0, False), (1, True)]
    assert {r.kind: r.n for r in live.alert_counts(got).collect()} == {"WINDOW": 2, "SENTENCE": 2, "GRAMMAR": 1}


def test_a_checked_stream_is_written_and_calls_back(spark, tmp_path):
    columns = "doc_id long, seq long, kind string, sent long, words string, merges long, fixes long, flagged boolean"
    spark.createDataFrame([(1, 1, "WINDOW", 0, "a b", 0, 0, False), (1, 2, "SENTENCE", 0, "a b", 0, 0, False)], columns).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
    started = live.write_checked(stream, lambda w: w.select("key", F.lit(True).alias("fired")), str(tmp_path / "out"), str(tmp_path / "point"), lambda df, n: seen.append((n, [r.kind for r in df.collect()])))
    started.processAllAvailable()
    started.stop()
    assert seen == [(0, ["GRAMMAR"])]
    assert [(r.sent, r.flagged) for r in live.sentence_flags(spark.read.parquet(str(tmp_path / "out"))).collect()] == [(0, True)]


def test_an_owners_model_comes_first_and_is_never_written(spark, tmp_path):
    own, other = corpora.ModelStore(spark, str(tmp_path / "own")), str(tmp_path / "other")
    made = []
    build = lambda: made.append(1) or spark.range(3).toDF("x")
    assert own.load_first("m", [other], build).count() == 3 and own.load_first("m", [other], build).count() == 3 and len(made) == 1
    assert not os.path.exists(other)
    spark.range(5).toDF("x").write.parquet(f"{other}/m")
    assert own.load_first("m", [other], build).count() == 5


def test_typed_lines_and_long_reports(spark, tmp_path):
    assert [tuple(r) for r in corpora.read_lines(spark, ["a b", "", " c ", "EXIT", "d"]).collect()] == [(0, "a b"), (1, "c")]
    assert corpora.write_report(spark.range(5), str(tmp_path / "r"), limit=2).splitlines()[-1] == "... the first 2 rows only"
