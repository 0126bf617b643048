"""Quality by importance resampling of hashed n-grams.

Two generative models over hashed n-grams, words and pairs of words, each with the share of documents that hold
it: of target text (labelled good) and of raw text (the whole corpus).  Raw text is a mixture: a known part
of it is target, and the rest is what raw text holds beyond the target's share.  The rest is itself of many kinds, each of
which writes as the target does but for n-grams of its own; so an n-gram counts against a document by the log ratio of target
to rest, and one that the rest holds less often says nothing.  Only n-grams that labelled documents
tell apart beyond chance count, or else the longer a text, the likelier it has a few that only bad documents happen to hold.
The sum over the distinct n-grams of the whole document is its log ratio of target to rest, r, and its importance weight is
that of the mixture, log(target / raw) = log(sigmoid(r + prior) / share of target), where the prior makes the weights of
the labelled documents agree with their labels.  Documents are then drawn without replacement by Gumbel top-k: the k
largest of weight / temperature plus Gumbel noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staging, pack, slices, unpack
from .tokens import SHAPE_CLASSES, combine, distinct, mix, row_of, token_hashes

_REPEATS = mix(np.arange(3, 16, dtype=np.uint64))
_SLICE = 4096
_ID, _GOOD, _RATIO = "quillstream_id", "quillstream_good", "quillstream_ratio"
#: Below this a ratio is as good as none: the weight is lost in any noise.
_FLOOR = -200.0


@dataclass(frozen=True)
class ImportanceConfig:
    """bits: log2 of the hash buckets, of words and of pairs each.  smoothing: documents added to the target and the rest of
    a bucket, in proportion.  least_docs: bad documents that must hold a bucket for it to count.  apart, pairs_apart:
    standard deviations by which its bad documents must exceed their share, of words and of pairs of words, of which there are
    more to choose from.  least_ratio: log ratios nearer to 0 are 0.  max_labelled: about so many labelled documents, chosen by a hash of the id, make
    the target model and the prior; the raw model is of the whole corpus.  temperature: of the draw;
    k: documents drawn, or None for as many as are rather target than rest."""

    bits: int = 20
    smoothing: float = 0.1
    least_docs: int = 5
    apart: float = 5.0
    pairs_apart: float = 10.0
    least_ratio: float = 3.0
    max_labelled: int = 100_000
    temperature: float = 1.0
    k: int | None = None
    seed: int = 17


def features(column: pa.Array, config: ImportanceConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and pair bucket of every token of every text, and row offsets.

    Tokens are runs of letters and digits, and runs of other visible characters, A-Z lower-cased.
    A token like the one before counts as a special token instead: one for the first repetition
    in a row, one for the second, and so on to the twelfth, which stands for all later ones."""
    h, ptr = token_hashes(column, SHAPE_CLASSES)
    before = np.zeros_like(h)
    if len(h):
        begins = np.zeros(len(h), bool)
        begins[ptr[:-1][ptr[:-1] < len(h)]] = True
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | begins[1:]
        place = np.arange(len(h))
        run = np.minimum(place - np.maximum.accumulate(np.where(fresh, place, 0)), len(_REPEATS) - 1)
        h = np.where(run > 0, _REPEATS[run], h)
        before[1:] = h[:-1]
        before[begins] = 0
    shift = np.uint64(64 - config.bits)
    return (h >> shift).astype(np.int64), (combine(before, h) >> shift).astype(np.int64) + (1 << config.bits), ptr


def labelled_sample(labels: DataFrame, config: ImportanceConfig, id_col: str, quality_col: str, toxic_col: str) -> DataFrame:
    """(id, good): about max_labelled labelled documents at most; a null label makes a document neither good nor bad."""
    good = F.when((F.col(quality_col) == 1) & (F.coalesce(F.col(toxic_col), F.lit(0)) == 0), True).when(
        (F.col(quality_col) == 0) | (F.col(toxic_col) == 1), False
    )
    known = labels.select(F.col(id_col).cast("long").alias("id"), good.alias("good")).dropna().groupBy("id").agg(F.min("good").alias("good"))
    share = min(1.0, config.max_labelled / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("id", F.lit(config.seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def document_counts(rows: DataFrame, config: ImportanceConfig) -> np.ndarray:
    """How many documents hold each bucket, of all, of the good and of the bad, from rows (text, quillstream_good).

    A task adds up its own share of the corpus; what reaches the driver is bounded by the buckets."""
    size = 2 << config.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((3, size), np.uint32)
        held: list[np.ndarray] = []  # kind * size + bucket; kind: no label, good, bad

        def flush() -> None:
            kind, bucket = np.divmod(np.concatenate(held), size)
            held.clear()
            for k in (1, 2):
                totals[k] += np.bincount(bucket[kind == k], minlength=size).astype(np.uint32)
            totals[0] += np.bincount(bucket, minlength=size).astype(np.uint32)

        for whole in batches:
            for batch in slices(whole, "text"):
                doc, bucket = distinct_features(batch.column("text"), config)
                good = batch.column(_GOOD)
                kind = np.where(good.is_null(), 0, np.where(good.fill_null(False), 1, 2))[doc]
                held.append((kind * size + bucket).astype(np.int32))
                if sum(map(len, held)) > 1 << 21:
                    flush()
        if held:
            flush()
        if totals.any():
            rows = [(k * (size // _SLICE) + s, pack(totals[k, s * _SLICE : (s + 1) * _SLICE].astype(np.uint64))) for k in range(3) for s in range(size // _SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE, np.uint64)
        for x in group.column("counts").to_pylist():
            total += unpack(x)
        return pa.table({"part": group.column("part")[:1], "counts": pa.array([pack(total)], pa.binary())})

    schema = "part int, counts binary"
    found = np.zeros((3 * size // _SLICE, _SLICE))
    for r in rows.mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect():
        found[r.part] = unpack(r.counts)
    return found.reshape(3, size)


def log_ratios(counts: np.ndarray, n: int, n_good: int, n_bad: int, config: ImportanceConfig) -> np.ndarray:
    """The log ratio of target to rest of every bucket: 0 or less, and 0 where labels do not tell them apart.

    counts: documents that hold each bucket, of all n, of the good and of the bad."""
    raw, good, bad = counts
    if not n_good or not n_bad:
        return np.zeros(len(raw))
    share = n_good / (n_good + n_bad)
    target = good * (share * n / n_good)  # of the whole corpus, by the good that hold it
    other = np.maximum(raw - target, 0)
    ratio = np.log((target + config.smoothing * share) / (other + config.smoothing * (1 - share))) - math.log(share / (1 - share))
    known = good + bad
    apart = (bad - known * (1 - share)) / np.sqrt(np.maximum(known * share * (1 - share), 1e-9))
    need = np.repeat([config.apart, config.pairs_apart], len(raw) // 2)
    return np.where((apart >= need) & (bad >= config.least_docs) & (ratio <= -config.least_ratio), ratio, 0)


def fit_prior(cells: list[tuple[float, int, int]]) -> float:
    """The prior log odds of target, from (ratio, good, labelled): the sum of the posteriors is the number of good ones.
    Infinite where there are no bad ones, or no labels."""
    ratio, good, n = (np.array(x, float) for x in zip(*cells, strict=True)) if cells else (np.zeros(0),) * 3
    if good.sum() >= n.sum():
        return math.inf
    if not good.sum():
        return -math.inf
    low, high = -500.0, 500.0
    for _ in range(100):
        middle = (low + high) / 2
        more = (n / (1 + np.exp(-np.clip(ratio + middle, -700, 700)))).sum() < good.sum()
        low, high = (middle, high) if more else (low, middle)
    return (low + high) / 2


def distinct_features(column: pa.Array, config: ImportanceConfig, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct buckets of every text, or of those that are chosen (a flag a bucket)."""
    one, two, ptr = features(column, config)
    row, bucket = np.tile(row_of(ptr), 2), np.concatenate((one, two))
    if chosen is not None:
        row, bucket = row[chosen[bucket]], bucket[chosen[bucket]]
    held = distinct(row << (config.bits + 1) | bucket)
    return held >> (config.bits + 1), held & ((2 << config.bits) - 1)


def with_ratio(rows: DataFrame, ratios: np.ndarray, config: ImportanceConfig, text_col: str) -> DataFrame:
    """The same rows and quillstream_ratio, the sum of the ratios of the whole text's distinct n-grams, -200 at least."""
    at = np.flatnonzero(ratios)
    # 12 bytes for each bucket that tells target from rest; bounded by the buckets.
    shared = rows.sparkSession.sparkContext.broadcast((at.astype(np.int32), ratios[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(2 << config.bits)
        dense[shared.value[0]] = shared.value[1]
        chosen = dense < 0
        for whole in batches:
            for batch in slices(whole, text_col):
                row, bucket = distinct_features(batch.column(text_col), config, chosen)
                ratio = np.maximum(np.bincount(row, weights=dense[bucket], minlength=batch.num_rows), _FLOOR)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio)], names=[*batch.schema.names, _RATIO])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(_RATIO, T.DoubleType())]))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a double column without nulls, exactly.

    Each round counts 4,096 equal parts of the range left and keeps the part with the answer, until
    the part holds one value; the driver sees the counts only.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    left = rows.select(F.col(column).alias("x"))
    while low < high:
        step = (high - low) / 4096
        part = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(step)), F.lit(4095)) if step > 0 else F.lit(0)
        cells = left.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        for c in sorted(cells, key=lambda c: -c.part):
            if k <= c.n:
                low, high = c.a, c.b
                break
            k -= c.n
        if step == 0:
            break
    return high


@dataclass
class _Draw:
    """What a draw is decided by: the ratios of the buckets, the prior, the share of target, and the least key drawn."""

    ratios: np.ndarray
    prior: float
    share: float
    config: ImportanceConfig
    least: float = -math.inf

    def weight(self) -> Column:
        if not math.isfinite(self.prior):
            return F.lit(0.0)
        return -F.log1p(F.exp(-(F.col(_RATIO) + self.prior))) - math.log(self.share)

    def key(self, ident: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(ident, F.lit(self.config.seed + 1)), 12).cast("double") + 0.5) / float(1 << 52)
        return self.weight() / self.config.temperature - F.log(-F.log(uniform))


def _draw(docs: DataFrame, labels: DataFrame, config: ImportanceConfig, id_col: str, text_col: str, quality_col: str, toxic_col: str) -> tuple[DataFrame, _Draw]:
    """Rows (quillstream_id, quillstream_good, quillstream_ratio), written, and the draw."""
    staging = Staging(docs.sparkSession)
    # Bounded by max_labelled rows of 17 bytes, so it may be broadcast.
    sample = F.broadcast(labelled_sample(labels, config, id_col, quality_col, toxic_col).withColumnsRenamed({"id": _ID, "good": _GOOD}))
    rows = docs.select(F.col(id_col).cast("long").alias(_ID), F.col(text_col).cast("string").alias("text")).join(sample, _ID, "left")
    n, n_good, n_bad = rows.agg(F.count("*"), F.count(F.when(F.col(_GOOD), 1)), F.count(F.when(~F.col(_GOOD), 1))).first()
    counts = document_counts(rows.select("text", _GOOD), config) if n_good and n_bad else np.zeros((3, 2 << config.bits))
    ratios = log_ratios(counts, n, n_good, n_bad, config)
    out = staging.write(with_ratio(rows, ratios, config, "text").drop("text"))
    # Rounded to hundredths, so at most 20,001 rows.
    cells = out.where(F.col(_GOOD).isNotNull()).groupBy(F.round(_RATIO, 2).alias("r")).agg(F.count(F.when(F.col(_GOOD), 1)).alias("g"), F.count("*").alias("n")).collect()
    draw = _Draw(ratios, fit_prior([(c.r, c.g, c.n) for c in cells]), n_good / (n_good + n_bad) if n_good else 1.0, config)
    k = config.k
    if k is None:
        k = out.where(F.col(_RATIO) + draw.prior >= 0).count() if math.isfinite(draw.prior) else n
    draw.least = -math.inf if k >= n else math.inf if k <= 0 else kth_largest(out.select(draw.key(F.col(_ID)).alias("key")), "key", k)
    return out, draw


def resample(docs: DataFrame, labels: DataFrame, config: ImportanceConfig = ImportanceConfig(), id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row a document: id, weight (the logarithm of the importance weight), draw_key and selected.

    Defined cases: a null or empty text, or one without a token, has no n-gram and the weight of a text without
    evidence; texts of any length are weighed whole; null ids are weighed
    as others are and are never labelled; rows that repeat an id are weighed each by its own text and
    share their noise; equal keys at the boundary are all selected; labels without a document and
    null labels are not used, and without both good and bad labels all weights are 0 and all documents are selected;
    other columns are ignored; an empty table gives no rows.
    """
    out, draw = _draw(docs, labels, config, id_col, text_col, quality_col, toxic_col)
    key = draw.key(F.col(_ID))
    return out.select(F.col(_ID).alias(id_col), draw.weight().alias("weight"), key.alias("draw_key"), (key >= draw.least).alias("selected"))


def select_documents(docs: DataFrame, labels: DataFrame, config: ImportanceConfig = ImportanceConfig(), id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """The rows that resample() selects, with all their columns, whose names may be any that do not begin with quillstream_;
    defined cases as there.

    Their ratios are summed again, which costs less than to keep all texts beside the weights."""
    _, draw = _draw(docs, labels, config, id_col, text_col, quality_col, toxic_col)
    key = draw.key(F.col(id_col).cast("long"))
    return with_ratio(docs, draw.ratios, config, text_col).where(key >= draw.least).select(docs.columns)
