import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus_rows():
    """Texts with exact copies, near copies, ties, nulls, blanks, one long text and repeated rows."""
    rng = random.Random(7)
    rows = []
    for k in range(120):
        rows.append((k, " ".join(words(rng, rng.randrange(3, 80))), ["en", "de"][k % 2], "s", 0))
    base = words(rng, 120)
    for k in range(120, 150):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
        rows.append((k, " ".join(copy), "en", "s", 0))
    rows += [(k, rows[3][1], "en", "s", 0) for k in range(150, 160)]
    rows += [(160, None, None, None, None), (161, "", "en", "s", 0), (162, " \t\n ", "en", "s", 0), (163, "One", "en", "s", 0), (164, "one two", "de", "s", 0), (165, "ONE two", None, "s", 0)]
    rows += [(166, " ".join(words(rng, 6000)), "de", "s", 0), (None, "no id at all here", "en", "s", 0), (167, "same row twice of five words", "en", "s", 0), (167, "same row twice of five words", "en", "s", 0)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus_rows):
    return spark.createDataFrame(corpus_rows, DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = "id node label a b keys h1 h2 score kept fold chunk good weight rep key part tokens lang_pred component_id n_links".split()
    return docs.select("*", *(F.lit("z").alias(n) for n in names))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
