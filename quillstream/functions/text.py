"""Scalar text functions, as column expressions that stay inside code generation."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = "[ \\n\\t\\r]+"


def split_words(text: Column) -> Column:
    """The blank-separated tokens of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda t: t != "")


def clean_word(token: Column) -> Column:
    """Lower case, letters only."""
    return F.regexp_replace(F.lower(token), "[^\\p{L}]", "")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Letters with marks as one character each (NFC), for which Spark has no function."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalise_form(form: Column, policy: str = "strip") -> Column:
    """`strip` keeps the letters of a form, `drop` keeps only forms that are all letters (else empty); a letter and the mark
    that follows it are one letter."""
    form = composed(form)
    if policy == "strip":
        return clean_word(form)
    if policy == "drop":
        return F.when(form.rlike("^\\p{L}+$"), F.lower(form)).otherwise("")
    raise ValueError(policy)


def is_valid_word(token: Column) -> Column:
    """Whether a token is letters from end to end, so that don't is no word."""
    return token.rlike("^\\p{L}+$")


def token_parts(token: Column) -> Column:
    """A token as (leading, core, trailing): marks, ASCII letters, marks; null if it has another form."""
    mark, core = "[^\\p{L}\\p{N}_]*", "[A-Za-z]+"
    pattern = f"^({mark})({core})({mark})$"
    parts = [F.regexp_extract(token, pattern, k).alias(n) for k, n in ((1, "leading"), (2, "core"), (3, "trailing"))]
    return F.when(token.rlike(pattern), F.struct(*parts))


def match_case(reference: Column, word: Column) -> Column:
    """The word in the case of the reference: all capitals, a leading capital, or as it is."""
    first = F.substring(reference, 1, 1)
    return (
        F.when((reference == F.upper(reference)) & (reference != F.lower(reference)), F.upper(word))
        .when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30))))
        .otherwise(word)
    )


def ends_sentence(token: Column) -> Column:
    """Whether a token closes a sentence: . ! or ? before closing marks, and more than one letter, which spares initials.  Most tokens
    are told by their last character, without a pattern."""
    marked = reduce(or_, (token.endswith(c) for c in ".!?\"')]}"))
    return marked & token.rlike("[.!?][\"')\\]}]*$") & (F.length(clean_word(token)) > 1)


def band(score: Column, low: Column, mid: Column) -> Column:
    """The three verdicts; null is no score at all."""
    return F.when(score.isNull() | (score < low), "ungrammatical").when(score < mid, "borderline").otherwise("grammatical")


def choose_method(parseable: Column, n_words: Column, per_word: Column, coverage: Column, floor: Column, longest: int = 25, least_coverage: float = 0.80) -> Column:
    """Grammar where it parses well enough, else trigrams where they know enough of the words, else bigrams."""
    return (
        F.when(parseable & (n_words <= longest) & (per_word >= floor), "pcfg").when(coverage >= least_coverage, "trigram").otherwise("bigram")
    )


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the text functions known to SQL, as expressions that the optimizer sees through, and `composed` as a vectorised one."""
    sql = {
        "clean_word(token STRING)": r"regexp_replace(lower(token), '[^\\p{L}]', '')",
        "is_valid_word(token STRING)": r"token RLIKE '^\\p{L}+$'",
        "split_words(line STRING)": r"filter(split(coalesce(line, ''), '[ \\n\\t\\r]+'), t -> t <> '')",
        "ends_sentence(token STRING)": r"token RLIKE '[.!?][\"\')\\]}]*$' AND length(regexp_replace(lower(token), '[^\\p{L}]', '')) > 1",
    }
    kinds = {"clean_word": "STRING", "is_valid_word": "BOOLEAN", "split_words": "ARRAY<STRING>", "ends_sentence": "BOOLEAN"}
    for head, body in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kinds[head.split('(')[0]]} RETURN {body}")
    spark.udf.register("composed", composed)
    return [*kinds, "composed"]
