"""Dependency parsing: arc-standard oracle, transition classifier, greedy parser, attachment score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, ROOT = "NONE", "ROOT"
_COUNTED = ["s0", "s1", "b0", "b1", "label", "n"]

#: Different instances that a task holds before it hands their counts on.
MAX_INSTANCES = 100_000
_INSTANCE = "doc_id long, sent long, step long, s0 string, s1 string, b0 string, b1 string, label string"


def _features(stack: list[int], buffer: list[int], pos: list[str]) -> tuple[str, str, str, str]:
    at = lambda seq, k: pos[seq[k]] if len(seq) > (k if k >= 0 else -k - 1) else NONE
    return at(stack, -1), at(stack, -2), at(buffer, 0), at(buffer, 1)


def oracle(tags: list[str], heads: list[int], relations: list[str]) -> list[tuple[tuple[str, str, str, str], str]]:
    """The (features, transition) pairs that build a gold tree; where no arc fits at the end, a right arc is forced."""
    n = len(tags)
    pos, waiting = [ROOT, *tags, NONE, NONE], [0] * (n + 1)
    for h in heads:
        if 0 <= h <= n:
            waiting[h] += 1
    head, relation = [-1, *heads], ["", *relations]
    stack, first, out = [0], 1, []
    while first <= n or len(stack) > 1:
        top = stack[-1]
        under = stack[-2] if len(stack) > 1 else None
        seen = (pos[top], NONE if under is None else pos[under], pos[first], pos[first + 1])
        if under and head[under] == top and not waiting[under]:
            out.append((seen, f"LEFT-ARC({relation[under]})"))
            waiting[top] -= 1
            del stack[-2]
        elif under is not None and (first > n or head[top] == under and not waiting[top]):
            out.append((seen, f"RIGHT-ARC({relation[top]})"))
            if head[top] == under:
                waiting[under] -= 1
            stack.pop()
        else:
            out.append((seen, "SHIFT"))
            stack.append(first)
            first += 1
    return out


def _sentences(gold: DataFrame, *columns: str) -> DataFrame:
    """One row a sentence, with an array of the columns in the order of i."""
    return gold.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("items"))


def oracle_instances(gold: DataFrame) -> DataFrame:
    """(doc_id, sent, step, s0, s1, b0, b1, label) from rows (doc_id, sent, i, tag, head, deprel)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, sent, items in zip(batch["doc_id"], batch["sent"], batch["items"], strict=True):
                pairs = oracle([x["tag"] for x in items], [x["head"] for x in items], [x["deprel"] for x in items])
                out += [(doc, sent, k, *f, t) for k, (f, t) in enumerate(pairs)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _INSTANCE.split(", ")])

    return _sentences(gold, "tag", "head", "deprel").mapInPandas(run, _INSTANCE)


def oracle_counts(trees: DataFrame) -> DataFrame:
    """(s0, s1, b0, b1, label, n): oracle_instances() of rows (tags, heads, deprels), a row a sentence, counted.  Equal trees of a batch
    are taken once and its instances counted before they leave Python; then their number is bounded by the tagset."""
    schema = "s0 string, s1 string, b0 string, b1 string, label string, n long"

    def rows(found: Counter) -> pa.RecordBatch:
        flat = [(*f, t, n) for (f, t), n in found.items()]
        columns = zip(*flat, strict=True) if flat else [[]] * len(_COUNTED)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 5 else pa.int64()) for k, c in enumerate(columns)], _COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for tree, n in Counter(zip(*(map(tuple, c.to_pylist()) for c in batch.columns), strict=True)).items():
                for step in oracle(*tree):
                    found[step] += n
            if len(found) > MAX_INSTANCES:
                yield rows(found)
                found.clear()
        yield rows(found)

    # Arrays go to Python as they are: joined to strings, Spark would make them over for every use.
    parts = trees.select("tags", "heads", "deprels").mapInArrow(run, schema)
    return parts.groupBy(*_COUNTED[:-1]).agg(F.sum("n").alias("n"))


def transition_histogram(instances: DataFrame) -> DataFrame:
    """(label, cnt) of oracle_instances() or oracle_counts()."""
    return instances.groupBy("label").agg((F.sum("n") if "n" in instances.columns else F.count("*")).alias("cnt"))


def classifier(instances: DataFrame, c: float = 1.0, rounds: int = 100):
    """One-hot multinomial logistic regression on the four features of oracle_instances() or oracle_counts(), with sum-loss strength
    `c`; unseen values are a zero block."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    names = ["s0", "s1", "b0", "b1"]
    # Equal instances are one weighted row: at most (tags + 2)^4 feature values, whatever the corpus.
    times = F.sum("n") if "n" in instances.columns else F.count("*")
    rows = instances.groupBy(*names, "label").agg(times.cast("double").alias("weight")).coalesce(1).persist()
    n = rows.agg(F.sum("weight")).first()[0] or 1.0
    fitted = Pipeline(
        stages=[
            StringIndexer(inputCols=names, outputCols=[f"{x}_i" for x in names], handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"{x}_i" for x in names], outputCols=[f"{x}_v" for x in names], dropLast=True),
            StringIndexer(inputCol="label", outputCol="y", handleInvalid="skip", stringOrderType="alphabetAsc"),
            _assembler([f"{x}_v" for x in names]),
            LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=rounds),
        ]
    ).fit(rows)
    rows.unpersist()
    return fitted


def training_accuracy(model, instances: DataFrame) -> float:
    """The share of the instances whose transition the classifier ranks first."""
    rows = instances.groupBy("s0", "s1", "b0", "b1", "label").agg(F.count("*").cast("double").alias("weight"))
    right = model.transform(rows).agg(F.sum(F.when(F.col("prediction") == F.col("y"), F.col("weight"))) / F.sum("weight")).first()[0]
    return right or 0.0


def save_classifier(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def _assembler(columns: list[str]):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="x")


def rankings(model, tags: list[str]) -> dict[tuple[str, str, str, str], list[str]]:
    """The transitions for every possible feature tuple, the most probable first; bounded by (tags + 2)^4."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import SparkSession

    if (len(tags) + 2) ** 4 > 1_000_000:
        raise ValueError("the tagset is too large for a table of rankings")
    spark = SparkSession.getActiveSession()
    values = spark.createDataFrame([(t,) for t in [*tags, NONE, ROOT]], "v string").coalesce(1)
    grid = values.withColumnRenamed("v", "s0")
    for name in ("s1", "b0", "b1"):
        grid = grid.crossJoin(values.withColumnRenamed("v", name))  # of the tagset with itself, not of data
    labels = model.stages[2].labels
    scored = model.transform(grid.withColumn("label", F.lit(labels[0])).withColumn("weight", F.lit(1.0))).select("s0", "s1", "b0", "b1", vector_to_array("probability").alias("p"))
    return {(r.s0, r.s1, r.b0, r.b1): [labels[k] for k in sorted(range(len(labels)), key=lambda k: (-r.p[k], labels[k]))] for r in scored.collect()}


def parse(tags: list[str], ranked: dict[tuple[str, str, str, str], list[str]], strict_root: bool = False) -> list[tuple[int, int, str]]:
    """(head, dependent, label) arcs: always the first transition in rank that can be made, at most 4n+10 of them.

    With strict_root, nothing is attached to the root while words are left."""
    pos = [ROOT, *tags]
    stack, first, arcs, n = [0], 1, [], len(tags)
    for _ in range(4 * n + 10):
        if first > n and len(stack) <= 1:
            break
        seen = _features(stack, [k for k in (first, first + 1) if k <= n], pos)
        for t in [*ranked.get(seen, ()), "SHIFT", "RIGHT-ARC(dep)"]:
            if t == "SHIFT":
                if first <= n:
                    stack.append(first)
                    first += 1
                    break
            elif len(stack) > 1 and t.startswith("LEFT") and stack[-2]:
                arcs.append((stack[-1], stack.pop(-2), t[9:-1]))
                break
            elif len(stack) > 1 and t.startswith("RIGHT") and not (strict_root and not stack[-2] and first <= n):
                arcs.append((stack[-2], stack[-1], t[10:-1]))
                stack.pop()
                break
        else:
            break
    return arcs


def parse_sentences(tagged: DataFrame, ranked: dict) -> DataFrame:
    """(doc_id, sent, head, dep, label) of rows (doc_id, sent, i, tag)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(d, s, *a) for d, s, items in zip(batch["doc_id"], batch["sent"], batch["items"], strict=True) for a in parse([x["tag"] for x in items], ranked)]
            yield pd.DataFrame(out, columns=["doc_id", "sent", "head", "dep", "label"])

    return _sentences(tagged, "tag").mapInPandas(run, "doc_id long, sent long, head long, dep long, label string")


def attachment(gold: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row: tokens, heads right, heads and labels right, and both scores in per cent; a token without an arc is wrong."""
    found = gold.join(arcs.select("doc_id", "sent", F.col("dep").alias("i"), F.col("head").alias("p_head"), "label"), ["doc_id", "sent", "i"], "left")
    head = F.coalesce(F.col("head") == F.col("p_head"), F.lit(False))
    both = head & F.coalesce(F.col("label") == F.col("deprel"), F.lit(False))
    out = found.agg(F.count("*").alias("n_tokens"), F.count_if(head).alias("n_heads"), F.count_if(both).alias("n_right"))
    return out.select("*", F.round(100 * F.col("n_heads") / F.col("n_tokens"), 4).alias("uas"), F.round(100 * F.col("n_right") / F.col("n_tokens"), 4).alias("las"))
