"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams of a language by rank.  A document is given the
language whose profile is least out of place: the sum, over the document's own most frequent
n-grams, of the difference in rank, or of the whole length of a profile where the n-gram is absent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: The answer for a text without letters.
UNDETERMINED = "und"

_SPACE = 32
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


@dataclass(frozen=True)
class ProfileConfig:
    """size: n-grams in a profile, of 1 to 3 letters, a word's edges counting as a blank.
    folds and test_fold: documents of that crc32 remainder of the id are never learned from."""

    size: int = 400
    folds: int = 4
    test_fold: int = 2


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the whole text, ascending, and their counts.  Key: 2 bits of n, then 20 bits a character."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    x = np.concatenate(([_SPACE], np.where(letter, points, _SPACE)[keep], [_SPACE])).astype(np.int64)
    one = x[x != _SPACE]
    two = (x[:-1] << 20 | x[1:])[(x[:-1] != _SPACE) | (x[1:] != _SPACE)]
    three = (x[:-2] << 40 | x[1:-1] << 20 | x[2:])[x[1:-1] != _SPACE]
    keys = np.sort(np.concatenate((one | 1 << 60, two | 2 << 60, three | 3 << 60)).view(np.uint64)) if len(one) else np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, best first; equal counts in the order of the keys."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """names: the languages in order.  grams: all keys of any profile, ascending.  ranks: one row a language."""

    names: list[str]
    size: int
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ranks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))

    @classmethod
    def of(cls, listed: dict[str, list[int]], size: int) -> Profiles:
        names = sorted(listed)
        grams = np.unique(np.array([g for n in names for g in listed[n]], np.int64).view(np.uint64))
        ranks = np.full((len(names), len(grams)), -1, np.int64)
        for row, n in enumerate(names):
            ranks[row, np.searchsorted(grams, np.array(listed[n], np.int64).view(np.uint64))] = np.arange(len(listed[n]))
        return cls(names, size, grams, ranks)

    def judge(self, text: str) -> tuple[str, float]:
        """The language and 1 - distance / largest distance; equal distances go to the first name."""
        own = ranked(*ngram_counts(text), self.size)
        if not len(own) or not self.names:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = self.grams[at] == own
        rank = self.ranks[:, at]
        away = np.where(there & (rank >= 0), np.minimum(np.abs(rank - np.arange(len(own))), self.size), self.size).sum(1)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def _fold(id_col: str, config: ProfileConfig):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(config.folds)), F.lit(config.test_fold))


def learn_profiles(docs: DataFrame, config: ProfileConfig = ProfileConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of every language value of the training documents.

    Counts are exact over all of them.  What reaches the driver are `size` keys a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                flat, n = np.concatenate(keys), np.concatenate(counts)
                grams, at = np.unique(flat, return_inverse=True)
                total = np.bincount(at, weights=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(total)], names=["lang", "gram", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    keys, counts = ngram_counts(text or "")
                    k, c = held.setdefault(lang, ([], []))
                    k.append(keys)
                    c.append(counts)
                    waiting += len(keys)
                    if waiting > 1 << 20:
                        yield from flush()
                        held, waiting = {}, 0
        yield from flush()

    known = docs.where((_fold(id_col, config) != config.test_fold) & F.col(lang_col).isNotNull())
    counted = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = totals.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= config.size)
    listed: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):
        listed.setdefault(r.lang, []).append(r.gram)
    return Profiles.of(listed, config.size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The same rows with lang_pred and score; the prediction reads nothing but the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            judged = [profiles.judge(t or "") for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    base = docs.drop("lang_pred", "score")
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def with_language(docs: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language at a score of `least` or more, with all their columns and no others.

    Defined cases: null texts and texts without a letter go; texts of any length are read whole, one at a time; repeated
    rows are judged alike; columns of any name pass unread; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            judged = (profiles.judge(t or "") for t in batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([name != UNDETERMINED and score >= least for name, score in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify_languages(docs: DataFrame, config: ProfileConfig = ProfileConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: id, held_out, lang_pred and score (0 to 1).

    Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text if
    nothing can be learned; a null id counts as held out; a null language is not learned from; equal
    distances go to the first language in the alphabet; repeated rows are judged alike, each on its
    own row; texts of any length are read whole, one at a time; other columns are ignored; an empty table gives no rows.
    """
    profiles = learn_profiles(docs, config, id_col, text_col, lang_col)
    held = (_fold(id_col, config) == config.test_fold).alias("held_out")
    return identify(docs.select(F.col(id_col), held, F.col(text_col).cast("string").alias("text")), profiles).select(id_col, "held_out", "lang_pred", "score")
