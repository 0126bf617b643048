import os

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quillstream.llm import common, components, tokens

SF = "/root/testdata/sf0.001"


def test_token_spans_follow_the_word_rule():
    texts = ["a\x0bB c\xa0d", None, "", " \t\r\n", "é ÉA", "x" * (tokens.WINDOW + 10) + " y"]
    h, ptr = tokens.token_hashes(pa.array(texts))
    assert np.diff(ptr).tolist() == [3, 0, 0, 0, 2, 2]
    a, _ = tokens.token_hashes(pa.array(["b", "B", "ab", "ba", "", "abc" * 9]))
    assert a[0] == a[1] and len(set(a.tolist())) == 4 and h[1] == a[0]


def test_windows_do_not_change_hashes(monkeypatch):
    texts = pa.array(["the quick  brown fox", "jumps", None, "over the lazy dog " * 20])
    whole, _ = tokens.token_hashes(texts)
    monkeypatch.setattr(tokens, "WINDOW", 8)
    small, _ = tokens.token_hashes(texts)
    assert (whole == small).all()


def test_shingles_of_short_rows():
    h, ptr = tokens.token_hashes(pa.array(["a b c d", "a b", "a", None, "a b c"]))
    s, p = tokens.shingles(h, ptr, 3)
    assert np.diff(p).tolist() == [2, 1, 1, 0, 1] and s[0] == s[4] and len(set(s.tolist())) == 4


def test_packing_round_trips():
    values = np.array([0, 1, 1, 70000, 2**60], np.uint64)
    assert (common.unpack(common.pack(values)) == values).all() and (common.unpack_sorted(common.pack_sorted(values)) == values).all()
    assert len(common.unpack(common.pack(values[:0]))) == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 102), (7, 7), (50, 50), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components.connected_components(df, common.Staging(spark)).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 102, 103: 102, 50: 50}
    assert components.connected_components(df.limit(0), common.Staging(spark)).count() == 0
    dealt = components.connected_components(df, common.Staging(spark), hot=2)
    assert {r.node: r.label for r in dealt.collect()} == got


def test_a_bit_filter_parts_rows_and_loses_none(spark):
    rows = spark.range(5000).select((F.col("id") * 7919).alias("a"), F.col("id").cast("string").alias("b")).union(spark.createDataFrame([(None, "x")], "a long, b string"))
    keys = rows.where("a % 10 = 0").select("a")
    bits = common.BitFilter(common.Staging(spark), keys, "a")
    inside, outside = bits.rows(rows, "a"), bits.rows(rows, "a", found=False)
    assert inside.columns == rows.columns and inside.count() + outside.count() == 5001
    assert inside.join(keys, "a", "left_semi").count() == 500 and outside.join(keys, "a").count() == 0 and inside.count() < 1000
    assert common.BitFilter(common.Staging(spark), keys.limit(0), "a").rows(rows, "a").count() == 0


def test_a_hot_key_joins_as_any_other(spark):
    many = spark.createDataFrame([(k % 3 if k % 2 else 7, k) for k in range(60)] + [(None, 99)], "k int, x int")
    one = spark.createDataFrame([(k, f"v{k}") for k in (0, 1, 7, 8)], "k int, y string")
    for how in ("inner", "left"):
        for hot in (1, 20, 1000):
            got = sorted((str(r.k), r.x, str(r.y)) for r in common.join_hot(many, 61, one, "k", F.col("x"), how, hot).collect())
            assert got == sorted((str(r.k), r.x, str(r.y)) for r in many.join(one, "k", how).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.Staging(spark).write(stage(spark, docs, SF))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and (docs.columns == columns or name == "encode")
        if name == "quality":
            gone = before - ids
            assert all(labels[i] != (1, 0) for i in gone & labels.keys()) or sum(labels[i] == (1, 0) for i in gone & labels.keys()) <= 2
        before = ids
    assert before and corpus_pipeline.run(spark, SF).count() == len(before)


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """Labels and benchmark beside documents of two languages, with junk, a leak, copies, nulls and repeated rows."""
    import random

    rng = random.Random(12)
    words = {"en": "the quick brown fox jumps over lazy dogs while rain falls on green hills and old stone walls near quiet rivers".split(), "de": "der schnelle braune fuchs springt über faule hunde während regen auf grüne hügel und alte mauern am stillen fluss fällt".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randrange(30)) * (rng.random() < 0.2) for _ in range(n))
    rows, labels = [], []
    for k in range(400):
        lang = ("en", "de")[k % 2]
        body = text(lang, 60)
        if k % 5 == 0:
            body = " ".join(w + "###" for w in body.split())
        rows.append((k, body, lang, "s", len(body)))
        labels.append((k, int(k % 5 != 0), 0))
    item = "what is the tallest tower of that old town answer it is the grey one by the bridge"
    rows.append((500, text("en", 20) + " " + item + " " + text("en", 20), "en", "s", 0))
    rows += [(501, rows[1][1], "de", "s", 0), (502, rows[3][1] + " nachtrag", "de", "s", 0)]
    rows += [(503, text("en", 50), "en", "s", 0)] * 2 + [(504, rows[7][1], "de", "s", 0), (504, text("de", 50), "de", "s", 0)]
    rows += [(505, None, None, None, None), (506, "", "en", "s", 0), (507, "12 34 !!", "en", "s", 0), (None, text("en", 40), None, None, None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(labels + [(9999, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


CLASHES = "id score lang_pred weight selected draw_key good component_id kept text_hash h1 item_id label node part".split()


def test_every_stage_by_hand(spark, small_tables):
    import corpus_pipeline

    folder, rows = small_tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())

    def run(name, df):
        out = stages[name](spark, df, folder)
        assert out.columns == df.columns and all(r[c] == f"own {c}" for r in out.collect() for c in CLASHES)
        return common.Staging(spark).write(out)

    told = run("language", docs)
    assert ids(told) == sorted((str(r[0]), r[1]) for r in rows if r[0] not in (505, 506, 507))
    drawn = run("quality", told)
    kept = {r.doc_id for r in drawn.collect()}
    junk = {r[0] for r in rows if r[0] is not None and r[0] < 400 and r[0] % 5 == 0}
    clean = {r[0] for r in rows if r[0] not in (505, 506, 507)} - junk
    assert len(junk & kept) <= 0.1 * len(junk) and len(clean - kept) <= 0.1 * len(clean)
    single = run("near_copies", told)
    gone = [(501, rows[1][1]), (502, rows[3][1] + " nachtrag"), (504, rows[7][1])]
    want = [(r[0], r[1]) for r in rows if r[0] not in (505, 506, 507) and (r[0], r[1]) not in gone]
    want.remove(next(w for w in want if w[0] == 503))  # one of two equal rows
    assert ids(single) == sorted((str(i), t) for i, t in want)
    assert ids(run("leaks", single)) == sorted((str(i), t) for i, t in want if i != 500)
    encoded = stages["encode"](spark, docs, folder).collect()
    assert len(encoded) == len(rows) and all(r.n_tokens == len(r.tokens) for r in encoded) and {r.n_tokens for r in encoded if r.doc_id in (505, 506)} == {0}


def test_every_stage_of_no_rows(spark, small_tables):
    import corpus_pipeline

    folder, _ = small_tables
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert all(stage(spark, none, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_the_pipeline_is_its_stages_in_order(spark, small_tables):
    import corpus_pipeline

    folder, rows = small_tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.Staging(spark).write(stage(spark, docs, folder))
    look = lambda df: sorted((str(r.doc_id), list(r.tokens), r.n_tokens) for r in df.collect())
    assert look(corpus_pipeline.run(spark, folder)) == look(docs) and docs.count() < len(rows)
