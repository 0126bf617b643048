import itertools

import pytest
from pyspark.sql import functions as F

from quillstream.functions import edits, tags, text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first().x


def brute_edits(w):
    a = "abcdefghijklmnopqrstuvwxyz"
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {l + r[1:] for l, r in cuts if r} | {l + r[1] + r[0] + r[2:] for l, r in cuts if len(r) > 1}
    return out | {l + c + r[1:] for l, r in cuts if r for c in a} | {l + c + r for l, r in cuts for c in a}


@pytest.mark.parametrize("word", ["a", "ab", "abca", "über"])
def test_edits_are_complete(spark, word):
    assert set(one(spark, edits.edits1(F.col("w")), w=word)) == brute_edits(word)
    assert set(one(spark, edits.deletions(F.col("w")), w=word)) == {word[:i] + word[i + 1 :] for i in range(len(word))}


def test_no_edits_of_nothing(spark):
    assert one(spark, edits.edits1(F.col("w")), w="") == [] and one(spark, edits.deletions(F.col("w")), w="") == []


def test_one_edit_apart(spark):
    strings = ["".join(p) for n in range(0, 4) for p in itertools.product("ab", repeat=n)] + ["é", "eé"]
    df = spark.createDataFrame([(s,) for s in strings], "a string")
    got = {(r.a, r.b) for r in df.crossJoin(df.withColumnRenamed("a", "b")).where(edits.one_edit_apart(F.col("a"), F.col("b"))).collect()}

    def near(a, b):
        every = set("abé") | set(a) | set(b)
        cuts = [(a[:i], a[i:]) for i in range(len(a) + 1)]
        out = {a} | {l + r[1:] for l, r in cuts if r} | {l + r[1] + r[0] + r[2:] for l, r in cuts if len(r) > 1}
        return b in out | {l + c + r[1:] for l, r in cuts if r for c in every} | {l + c + r for l, r in cuts for c in every}

    assert got == {(a, b) for a in strings for b in strings if near(a, b)}


@pytest.mark.parametrize("token,parts", [("(Hello),", ("(", "Hello", "),")), ("café", None), ("_x", None), ("don't", None), ("...", None), ("I", ("", "I", ""))])
def test_token_parts(spark, token, parts):
    got = one(spark, text.token_parts(F.col("t")), t=token)
    assert (tuple(got) if got else None) == parts


@pytest.mark.parametrize("ref,word,want", [("I", "it", "IT"), ("ABC", "abd", "ABD"), ("Abc", "abd", "Abd"), ("abc", "abd", "abd")])
def test_match_case(spark, ref, word, want):
    assert one(spark, text.match_case(F.col("r"), F.col("w")), r=ref, w=word) == want


@pytest.mark.parametrize("token,want", [("end.", True), ('end."', True), ("J.", False), (".", False), ("end", False), ("ok!)", True), ("a.b", False)])
def test_ends_sentence(spark, token, want):
    assert one(spark, text.ends_sentence(F.col("t")), t=token) is want


def test_two_policies_of_forms(spark):
    assert one(spark, text.normalise_form(F.col("t")), t="Don't") == "dont" and one(spark, text.normalise_form(F.col("t"), "drop"), t="Don't") == ""


@pytest.mark.parametrize("raw,tag,penn", [("NN-TL", "NN", "NN"), ("PPSS+BER-HL", "PPSS", "PRP"), ("BEZ*", "BEZ", "VBZ"), ("*", "*", "RB"), ("", "X", "X"), ("FW-IN", "FW-IN", "X"), ("NN$", "NN$", "NN")])
def test_brown_tags(spark, raw, tag, penn):
    assert one(spark, tags.normalise_brown_tag(F.col("t")), t=raw) == tag and one(spark, tags.brown_to_penn(F.col("t")), t=raw) == penn


def test_morphology(spark):
    tag = tags.morph_tag(F.col("p"), tags.parse_features(F.col("f")))
    assert one(spark, tag, p="ADJ", f="Number=Plur|Gender=Masc,Neut|junk") == "ADJ-Masc-Pl"
    assert one(spark, tag, p="ADJ", f="_") == "ADJ"
    assert one(spark, tags.coarse_tag(F.col("t")), t="-LRB-") == "-LRB-" and one(spark, tags.tag_feature(F.col("t"), "Number"), t="NOUN-Fem-Sg") == "Sg"
    assert one(spark, tags.universal_to_penn(F.col("t")), t="PRON") == "PRP" and one(spark, tags.universal_to_penn(F.col("t")), t="ODD") == "NN"


def test_corruptions_are_one_edit(spark):
    df = spark.createDataFrame([(w, k) for w in ("a", "word", "aab") for k in range(40)], "w string, k long")
    for kind in ("deletion", "insertion", "replacement", "transposition"):
        rows = df.select("w", edits.corrupt(F.col("w"), F.lit(kind), edits.keyed_number(F.col("w"), F.col("k"))).alias("c")).where("c is not null")
        assert rows.where((F.col("c") == F.col("w")) | ~edits.one_edit_apart(F.col("w"), F.col("c"))).count() == 0


def test_a_letter_and_its_mark_are_one_letter(spark):
    df = spark.createDataFrame([("café!",), ("café",), (None,)], "x string")
    assert [r[0] for r in df.select(text.normalise_form(F.col("x"))).collect()] == ["café", "café", None]


def test_functions_are_known_to_sql(spark):
    assert "clean_word" in text.register_functions(spark)
    row = spark.sql("SELECT clean_word(\"Don't\"), is_valid_word('abc'), size(split_words(' a b ')), ends_sentence('end.'), ends_sentence('J.')").first()
    assert tuple(row) == ("dont", True, 2, True, False)
