"""Readers of tagged text, CoNLL-U and bracketed trees, and a store of model tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import brown_to_penn, normalise_brown_tag, parse_features
from ..functions.text import normalise_form


def read_tagged(spark: SparkSession, path: str, tagset: str = "penn", policy: str = "strip", longest: int = 25, dropped: tuple[str, ...] = ("SYM",)) -> DataFrame:
    """(file, sent_id, pos, form, tag) of files of `word/tag` lines, one sentence a line; blank lines are none.

    The tag stands after the last slash; forms are normalised, empty and overlong ones and dropped tags left out; sent_id counts the
    sentences of a file by their place in it."""
    if tagset not in ("penn", "native"):
        raise ValueError(tagset)
    files = spark.read.text(path, wholetext=True).select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), "value")
    lines = F.filter(F.split("value", "\\n"), lambda x: F.trim(x) != "")
    sents = files.select("file", F.posexplode(lines).alias("n", "line"))
    each = sents.select("file", "n", F.posexplode(F.split(F.trim("line"), "\\s+")).alias("pos", "t"))
    form, tag = F.regexp_extract("t", "^(.*)/([^/]+)$", 1), F.regexp_extract("t", "^(.*)/([^/]+)$", 2)
    mapped = brown_to_penn(tag) if tagset == "penn" else normalise_brown_tag(tag)
    rows = each.select("file", F.concat_ws("-", F.lit("brown"), "file", F.col("n").cast("string")).alias("sent_id"), "pos", normalise_form(form, policy).alias("form"), mapped.alias("tag"))
    return rows.where((F.col("form") != "") & (F.length("form") <= longest) & ~F.col("tag").isin(*dropped))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, id, form, upos, feats, head, deprel) of CoNLL-U files.

    A line of blanks ends a sentence, # lines are notes; word ranges, empty nodes, lines of fewer than ten columns and ids or
    heads that are not numbers are passed over."""
    files = spark.read.text(path, wholetext=True).select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), "value")
    blocks = F.filter(F.split(F.regexp_replace("value", "\\r", ""), "\\n[ \\t]*\\n"), lambda b: F.trim(b) != "")
    sents = files.select("file", F.posexplode(blocks).alias("sent", "block"))
    lines = sents.select("file", "sent", F.explode(F.filter(F.split("block", "\\n"), lambda x: ~F.startswith(x, F.lit("#")))).alias("line"))
    cells = lines.select("file", F.col("sent").cast("long").alias("sent"), F.split(F.trim("line"), "\\t").alias("c")).where(F.size("c") >= 10)
    cell = lambda k: F.get("c", F.lit(k))
    rows = cells.select("file", "sent", cell(0).try_cast("int").alias("id"), cell(1).alias("form"), cell(3).alias("upos"), cell(5).alias("feats"), cell(6).try_cast("int").alias("head"), cell(7).alias("deprel"))
    return rows.where("id is not null and head is not null")


def treebank_sentences(tokens: DataFrame, policy: str = "strip", longest: int = 25, dropped: tuple[str, ...] = ("SYM",)) -> DataFrame:
    """read_conllu() rows with dropped tags, empty forms and overlong forms left out, in this order, and feats as a map."""
    kept = tokens.where(~F.col("upos").isin(*dropped)).withColumn("form", normalise_form(F.col("form"), policy))
    return kept.where((F.col("form") != "") & (F.length("form") <= longest)).withColumn("features", parse_features(F.col("feats")))


def load_treebank(spark: SparkSession, directory: str) -> DataFrame:
    """All splits of a treebank directory with `split`; a split without files is left out, none at all is an error."""
    out = None
    for split in ("train", "dev", "test"):
        try:
            part = treebank_sentences(read_conllu(spark, f"{directory}/*{split}*.conllu")).withColumn("split", F.lit(split))
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(directory)
    return out


def corpus_stats(raw: DataFrame, longest: int = 25, dropped: tuple[str, ...] = ("SYM",)) -> DataFrame:
    """One row from rows (form, tag): how many tokens are kept, changed and left out for each reason."""
    clean = normalise_form(F.col("form"))
    reason = F.when(clean == "", "empty").when(F.length(clean) > longest, "too_long").when(F.col("tag").isin(*dropped), "dropped_tag").otherwise("kept")
    rows = raw.select(reason.alias("r"), (F.lower("form") != clean).alias("altered"))
    is_ = lambda name: F.count_if(F.col("r") == name).alias(f"n_{name}")
    return rows.agg(F.count("*").alias("n_raw"), is_("kept"), is_("empty"), is_("too_long"), is_("dropped_tag"), F.count_if((F.col("r") == "kept") & F.col("altered")).alias("n_altered"))


def read_lines(spark: SparkSession, lines: Iterable[str], stop: str = "exit") -> DataFrame:
    """(id, text) of typed lines up to the stop word, in any case, or the end; blank lines are passed over."""
    kept = []
    for line in lines:
        if line.strip().lower() == stop:
            break
        if line.strip():
            kept.append((len(kept), line.strip()))
    return spark.createDataFrame(kept, "id long, text string")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(tree): one bracketed tree a line."""
    return spark.read.text(path).select(F.trim("value").alias("tree")).where("tree <> ''")


class ModelStore:
    """Model tables and parameters under one folder; what is stored is read, what is not is built once and stored."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def load_or_build(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self._exists(f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def load_first(self, name: str, owners: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """The table of the first owner's folder that has it, else of this store, else built into this store; an owner's
        folder is never written to."""
        for root in owners:
            if self._exists(f"{root.rstrip('/')}/{name}/_SUCCESS"):
                return self.spark.read.parquet(f"{root.rstrip('/')}/{name}")
        return self.load_or_build(name, build)

    def save_params(self, name: str, params: dict) -> None:
        self.spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}.params")

    def load_params(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}.params").first()[0])


def write_report(df: DataFrame, path: str, title: str = "", limit: int = 1000) -> str:
    """A table as aligned text, written to one file through Spark; `limit` rows at most, as reports are for reading, and a
    last line that says so where rows are left out."""
    rows = [[str(x) for x in r] for r in df.limit(limit + 1).collect()]
    more, rows = len(rows) > limit, rows[:limit]
    widths = [max(len(c), *(len(r[k]) for r in rows)) if rows else len(c) for k, c in enumerate(df.columns)]
    lines = [title] if title else []
    lines += ["  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in [df.columns, *rows]]
    if more:
        lines.append(f"... the first {limit} rows only")
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return "\n".join(lines)
