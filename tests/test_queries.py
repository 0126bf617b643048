"""Queries against DuckDB over the smallest tables; all of them with QUILLSTREAM_ALL=1."""

import os

import duckdb
import pytest

from quillstream import queries as register

SF = "/root/testdata/sf0.001"
FEW = ["gold_spans", "bigrams", "kn_continuation", "symdel_candidates", "deleted_interpolation", "transition_prob", "pcfg_rules", "brown_tag_map", "agreement", "merge_injection", "benchmark_words", "tumbling_windows", "lm_normalisation", "lm_open_vocab", "lm_witten_bell", "correct_nonword", "count_triggers", "window_alerts", "window_agreement", "confusion_square", "most_confused", "weakest_tags", "error_examples", "sampled_documents", "sample_reachability"]
NAMES = sorted(register.oracle_sql()) if os.environ.get("QUILLSTREAM_ALL") else FEW


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = register.queries()[name](spark, SF)
    want = duck.sql(register.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda rows, cols: sorted((tuple(r[i] for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in rows), key=repr)
    assert order(df.collect(), df.columns) == order(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_candidates_of_all_words_are_the_a_to_z_edits(spark, duck):
    import string

    from quillstream.operators import corpus

    got = {tuple(r) for r in register.queries()["edits1_candidates_all"](spark, SF).select("query", "cand").collect()}
    words = lambda t, key: {r.word for r in corpus.words(spark.read.parquet(f"{SF}/{t}.parquet").withColumnRenamed(key, "doc_id")).select("word").distinct().collect()}
    vocab, want = words("documents", "doc_id"), set()
    for q in words("benchmark", "item_id"):
        cuts = [(q[:k], q[k:]) for k in range(len(q) + 1)]
        made = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        made |= {a + c + b[n:] for a, b in cuts for c in string.ascii_lowercase for n in (0, 1) if len(b) >= n}
        want |= {(q, c) for c in made & vocab if c != q}
    assert got == want and any(not q.isascii() for q, _ in got)
    assert got == set(duck.sql(register.oracle_sql()["edits1_candidates_all"]).fetchall())


def test_every_query_that_sql_can_express_has_sql():
    without = set(register.queries()) - set(register.oracle_sql())
    assert without == {"correct_sentence", "grammar_floors", "dp_segment", "viterbi_tags", "oracle_transitions", "transition_histogram", "dependency_parse", "cky_parse", "summary_table", "live_alerts"}


def test_entry_imports_without_the_training_data_part(monkeypatch):
    import importlib.util
    import sys

    import __spark_entry__ as entry

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n == "quillstream.llm" else find(n, *a))
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(register.queries()) and set(entry.oracle_sql()) == set(register.oracle_sql())
