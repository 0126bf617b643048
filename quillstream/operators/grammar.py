"""Probabilistic grammar: trees to rules, rule probabilities, chart parsing as joins and as a function."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import among

Tree = tuple  # (symbol, children); a leaf is a word

_TOKEN = re.compile(r"[()]|[^\s()]+")


def read_tree(text: str) -> Tree | None:
    """A bracketed tree, or None if the brackets do not close."""
    stack: list[list] = [[]]
    for token in _TOKEN.findall(text):
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) < 2:
                return None
            node = stack.pop()
            stack[-1].append((node[0], node[1:]) if node and isinstance(node[0], str) else ("", node))
        else:
            stack[-1].append(token)
    top = stack[0]
    if len(stack) != 1 or len(top) != 1 or isinstance(top[0], str):
        return None
    return top[0][1][0] if top[0][0] == "" and len(top[0][1]) == 1 and not isinstance(top[0][1][0], str) else top[0]


def binarise(tree: Tree, markov: int = 2) -> list[tuple[str, str, str | None]]:
    """The rules (lhs, first, second) of a tree after joining chains of single symbols and splitting long rules; a symbol that
    stands for the rest of a rule is named by the next `markov` sisters; second is None over a word."""
    out: list[tuple[str, str, str | None]] = []

    def visit(node: Tree) -> str:
        symbol, children = node
        while len(children) == 1 and not isinstance(children[0], str):
            symbol, children = f"{symbol}+{children[0][0]}", children[0][1]
        if len(children) == 1:
            out.append((symbol, children[0], None))
            return symbol
        names = [visit(c) if not isinstance(c, str) else c for c in children]
        left = symbol
        for k in range(len(names) - 2):
            rest = f"{symbol}|<{'-'.join(names[k + 1 : k + 1 + markov])}>"
            out.append((left, names[k], rest))
            left = rest
        if len(names) > 1:
            out.append((left, names[-2], names[-1]))
        return symbol

    visit(tree)
    return out


def productions(trees: DataFrame, markov: int = 2) -> DataFrame:
    """(lhs, b, c, n) of a column `tree` of bracketed trees, that of its number `n` if there is one; c is null over a word; text that
    is no tree gives none.  Rules are counted a batch at a time, so that few rows leave Python; a rule may have several rows."""
    counted = trees.select("tree", F.col("n") if "n" in trees.columns else F.lit(1).cast("long").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple, int] = {}
            for t, n in zip(batch["tree"], batch["n"], strict=True):
                if t and (tree := read_tree(t)) is not None:
                    for r in binarise(tree, markov):
                        found[r] = found.get(r, 0) + n
            yield pd.DataFrame([(*r, n) for r, n in found.items()], columns=["lhs", "b", "c", "n"]).astype({"n": "int64"})

    return counted.mapInPandas(run, "lhs string, b string, c string, n long")


def rule_probabilities(rules: DataFrame, min_count: int = 2) -> DataFrame:
    """(lhs, b, c, cnt, logp): maximum likelihood among the rules of a symbol that occur often enough."""
    counts = rules.groupBy("lhs", "b", "c").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= min_count).persist()  # read for the totals too
    totals = counts.groupBy("lhs").agg(F.sum("cnt").alias("total"))  # one row a symbol; a tag's lexicon is not sorted into one task
    return counts.join(totals, "lhs").select("lhs", "b", "c", "cnt", F.log(F.col("cnt") / F.col("total")).alias("logp"))


def split_rules(grammar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Binary rules (lhs, b, c, logp), and lexical rules (word, lhs, logp), the best of those that differ in case only."""
    binary = grammar.where("c is not null").select("lhs", "b", "c", "logp")
    lexical = grammar.where("c is null").groupBy(F.lower("b").alias("word"), "lhs").agg(F.max("logp").alias("logp"))
    return binary, lexical


def is_root(symbol: str) -> bool:
    return symbol.startswith("S") and "|" not in symbol


#: Binary rules that may be held by each task.
MAX_RULES = 1_000_000


def cky(words: list[str], leaves: list[dict[str, float]], binary: dict[str, dict[str, list[tuple[str, float]]]]) -> tuple[str | None, float | None]:
    """The best tree of a sentence symbol and its log-probability, or nothing: S if it spans the words, else the best.

    binary: by the left and then by the right symbol, so that a split looks at pairs that a rule joins, not at all pairs."""
    n, none = len(words), {}
    chart: dict[tuple[int, int], dict[str, tuple[float, tuple | None]]] = {(i, i): {s: (p, None) for s, p in leaves[i].items()} for i in range(n)}
    # By its first word: the ends of the cells that hold a symbol which is a rule's left one, with these symbols.
    lefts: list[list[tuple[int, list[tuple[str, float]]]]] = [[] for _ in range(n)]

    def note(i: int, j: int) -> None:
        if able := [(b, p) for b, (p, _) in chart[i, j].items() if b in binary]:
            lefts[i].append((j, able))

    for i in range(n):
        note(i, i)
    for span in range(2, n + 1):
        for i in range(n - span + 1):
            j = i + span - 1
            cell: dict[str, tuple[float, tuple | None]] = {}
            for k, able in lefts[i]:
                right = chart[k + 1, j]
                if not right:
                    continue
                for b, pb in able:
                    joined = binary.get(b, none)
                    for c in right if len(right) < len(joined) else joined:
                        if c in joined and c in right:
                            pc = right[c][0]
                            for lhs, p in joined[c]:
                                if lhs not in cell or p + pb + pc > cell[lhs][0]:
                                    cell[lhs] = (p + pb + pc, (k, b, c))
            chart[i, j] = cell
            note(i, j)
    top = chart.get((0, n - 1), {})
    roots = [s for s in top if is_root(s)]
    if not roots:
        return None, None
    root = "S" if "S" in roots else max(roots, key=lambda s: top[s][0])
    out: list[str] = []
    todo: list = [(root, 0, n - 1)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        symbol, i, j = x
        link = chart[i, j][symbol][1]
        if link is None:
            out.append(f"({symbol} {words[i]})")
        else:
            k, b, c = link
            out.append(f"({symbol} ")
            todo += [")", (c, k + 1, j), " ", (b, i, k)]
    return "".join(out), top[root][0]


def parse_sentences(sentences: DataFrame, grammar: DataFrame, longest: int | None = None) -> DataFrame:
    """(id, n_words, parse, logp) of rows (id, i, word, tag); a word without a rule is its tag with probability 1.  Every sentence is
    parsed, or with `longest` those of up to so many words: the chart's cost grows with the cube of the length."""
    binary, lexical = split_rules(grammar.persist())  # read for both kinds of rules
    held = binary.limit(MAX_RULES + 1).collect()
    if len(held) > MAX_RULES:
        raise ValueError("the grammar is too large to hold")
    rules: dict[str, dict[str, list[tuple[str, float]]]] = {}
    for r in sorted(held):
        rules.setdefault(r.b, {}).setdefault(r.c, []).append((r.lhs, r.logp))
    sentences = sentences.persist()
    lexical = among(lexical, sentences.select(F.lower("word").alias("word")), ["word"])
    found = lexical.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("lhs", "logp"))).alias("options"))
    joined = sentences.withColumn("key", F.lower("word")).join(found.withColumnRenamed("word", "key"), "key", "left")
    rows = joined.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "word", "tag", "options"))).alias("items"))
    kind = sentences.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ident, items in zip(batch["id"], batch["items"], strict=True):
                leaves = [{o["lhs"]: o["logp"] for o in x["options"]} if x["options"] is not None else {x["tag"]: 0.0} for x in items]
                out.append((ident, *cky([x["word"] for x in items], leaves, rules)))
            yield pd.DataFrame(out, columns=["id", "parse", "logp"]).astype({"logp": "float64"})

    asked = (rows if longest is None else rows.where(F.col("n") <= longest)).repartition(4 * sentences.sparkSession.sparkContext.defaultParallelism)
    parsed = asked.select("id", "items").mapInPandas(run, f"id {kind}, parse string, logp double")
    return rows.select("id", F.col("n").alias("n_words")).join(parsed, "id", "left")


def cky_joins(leaves: DataFrame, binary: DataFrame, longest: int) -> DataFrame:
    """(id, i, j, symbol, logp): the chart as one three-way join a span length, for comparison and for SQL.  The rules and the
    cells so far are held, as each length reads both again."""
    binary = binary.persist()
    chart = leaves.select("id", F.col("i"), F.col("i").alias("j"), "symbol", "logp")
    for span in range(2, longest + 1):
        left, right = chart.alias("l"), chart.alias("r")
        joined = left.join(right, (F.col("l.id") == F.col("r.id")) & (F.col("r.i") == F.col("l.j") + 1) & (F.col("r.j") - F.col("l.i") == span - 1))
        ruled = joined.join(binary.alias("g"), (F.col("g.b") == F.col("l.symbol")) & (F.col("g.c") == F.col("r.symbol")))
        cells = ruled.groupBy("l.id", "l.i", "r.j", F.col("g.lhs").alias("symbol")).agg(F.max(F.col("g.logp") + F.col("l.logp") + F.col("r.logp")).alias("logp"))
        chart = chart.unionByName(cells).persist()
    return chart


def sentence_floor(values: list[float], share: float) -> float:
    """The nearest-rank value of a short list; minus infinity of none."""
    ranked = sorted(values)
    return ranked[round(share * (len(ranked) - 1))] if ranked else -math.inf
