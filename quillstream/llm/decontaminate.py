"""Benchmark decontamination: a block-max BM25 index of the test items, asked by every passage.

Impacts are divided by the item's own full score, so that a score is the part of the item, by BM25
weight, that a passage holds, and one threshold fits items of all lengths.  Document frequencies and the mean length are
those of the whole benchmark, whatever the number of indexes it is cut into.  Items stand in blocks
of like length, short ones first, and items too long for a passage in indexes of longer passages.  A passage has a cursor in
the block postings of each of its terms.  Its pivot is the first block by which the largest impacts still ahead of the cursors,
summed in the order of their blocks, reach the threshold; cursors before it are moved to it, the block is scored if
its own largest impacts reach the threshold too, and a passage without a pivot is done.  Many passages take
each step at once, and share half-passages, so that the text is read once.  Retrieved items are verified on five-word shingles of
the whole document: both halves of the item, question and answer, must be found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, slices
from .tokens import LETTER_CLASSES, combine, distinct, token_hashes


@dataclass(frozen=True)
class LeakConfig:
    """half: tokens in half a passage; twice, four times and so on for longer items, so that a passage holds an
    item wherever it begins.  threshold: of the
    normalised BM25 score.  overlap: part of each half's shingles that must be in the document.
    max_items, max_bytes: of what is broadcast at once; larger benchmarks are asked in several passes.
    at_once: half-passages that go through an index together."""

    half: int = 64
    block: int = 4
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.5
    shingle: int = 5
    overlap: float = 0.8
    max_items: int = 4_000
    max_bytes: int = 8 << 20
    at_once: int = 4_096


@dataclass
class Statistics:
    """Of the whole benchmark: items with a word, their mean length, and in how many each term stands (terms ascending)."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, terms)]


def _tokens(texts: list[str | None]) -> list[np.ndarray]:
    hashes, ptr = token_hashes(pa.array([t or "" for t in texts], pa.large_string()), LETTER_CLASSES)
    return [hashes[a:b] for a, b in zip(ptr, ptr[1:], strict=False)]


def own_statistics(texts: list[str | None]) -> Statistics:
    """The statistics of items that are the whole benchmark."""
    tokens = [t for t in _tokens(texts) if len(t)]
    terms, df = np.unique(np.concatenate([np.unique(t) for t in tokens]) if tokens else np.zeros(0, np.uint64), return_counts=True)
    return Statistics(len(tokens), float(np.mean([len(t) for t in tokens])) if tokens else 1.0, terms, df)


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    if not 0 < n <= len(hashes):
        return hashes[:0]
    return combine(*(hashes[k : len(hashes) - n + 1 + k] for k in range(n)))


class BlockMaxIndex:
    def __init__(self, items: list[tuple], config: LeakConfig, statistics: Statistics, half: int):
        """items: (id, tokens), none empty and none of more tokens than half a passage."""
        items = sorted(items, key=lambda x: len(x[1]))
        self.config, self.half, self.ids = config, half, [x[0] for x in items]
        self.tokens = [x[1] for x in items]
        n = len(items)
        lengths = np.array([len(t) for t in self.tokens])
        term_of = [np.unique(t, return_counts=True) for t in self.tokens]
        self.terms, at = np.unique(np.concatenate([t for t, _ in term_of]), return_inverse=True)
        item = np.repeat(np.arange(n), [len(t) for t, _ in term_of]).astype(np.int64)
        tf = np.concatenate([c for _, c in term_of]).astype(float)
        df = statistics.of(self.terms)
        idf = np.log1p((statistics.n - df + 0.5) / (df + 0.5))
        norm = config.k1 * (1 - config.b + config.b * lengths / statistics.mean)
        impact = idf[at] * tf * (config.k1 + 1) / (tf + norm[item])
        impact /= np.bincount(item, weights=impact, minlength=n)[item]
        self.blocks = -(-n // config.block)
        block = item // config.block
        # Postings of blocks by term, with the largest impact in the block.
        key = at * self.blocks + block
        pairs, where = np.unique(key, return_inverse=True)
        largest = np.zeros(len(pairs))
        np.maximum.at(largest, where, impact)
        self.block_ptr = np.searchsorted(pairs // self.blocks, np.arange(len(self.terms) + 1))
        self.block_id, self.block_max = pairs % self.blocks, largest
        self.term_of = pairs // self.blocks
        self.key = pairs
        self.last = np.append(self.term_of[1:] != self.term_of[:-1], True)
        # The largest impact of the term in this block or a later one: running maxima from the end, terms kept apart.
        apart = 2.0 * self.term_of  # impacts are at most 1
        self.ahead = np.maximum.accumulate((largest - apart)[::-1])[::-1] + apart
        # Inside a block: its terms and a dense table of impacts.
        self.tables = []
        by_block = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[by_block], np.arange(self.blocks + 1))
        for k in range(self.blocks):
            mine = by_block[cuts[k] : cuts[k + 1]]
            terms, row = np.unique(at[mine], return_inverse=True)
            table = np.zeros((len(terms) + 1, min(config.block, n - k * config.block)))
            table[row, item[mine] - k * config.block] = impact[mine]
            self.tables.append((terms, table))
        self.parts = []
        for t in self.tokens:
            cut = (len(t) + 1) // 2
            self.parts.append([(min(config.shingle, len(p)), np.unique(_runs(p, min(config.shingle, len(p))))) for p in (t[:cut], t[cut:])])

    def candidates(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) of all pairs whose largest impacts reach the threshold, of distinct rows (passage, term)."""
        least = self.config.threshold - 1e-6
        at = self.block_ptr[term]
        passages, blocks = [passage[:0]], [at[:0]]
        while len(at):
            order = np.argsort(passage * self.blocks + self.block_id[at])
            passage, at = passage[order], at[order]
            start = np.flatnonzero(np.diff(passage, prepend=-1))
            size = np.diff(start, append=len(at))
            ahead = self.ahead[at]
            most = np.cumsum(ahead)
            enough = most - np.repeat(most[start] - ahead[start], size) >= least
            reached = np.add.reduceat(enough.astype(np.int64), start)
            pivot = self.block_id[at[np.minimum(start + size - reached, len(at) - 1)]]
            group = np.repeat(np.arange(len(start)), size)
            here = np.repeat(reached > 0, size)
            owner, passage, at, group = passage[start], passage[here], at[here], group[here]
            goal = pivot[group]
            behind = np.flatnonzero(self.block_id[at] < goal)
            term = self.term_of[at[behind]]
            at[behind] = moved = np.searchsorted(self.key, term * self.blocks + goal[behind])
            alive = np.ones(len(at), bool)
            alive[behind] = self.term_of[np.minimum(moved, len(self.key) - 1)] == term
            alive[behind[moved == len(self.key)]] = False
            passage, at, group, goal = passage[alive], at[alive], group[alive], goal[alive]
            on = self.block_id[at] == goal
            found = np.flatnonzero(np.bincount(group[on], weights=self.block_max[at[on]], minlength=len(owner)) >= least)
            passages.append(owner[found])
            blocks.append(pivot[found])
            alive = ~(on & self.last[at])
            passage, at = passage[alive], (at + on)[alive]
        return np.concatenate(passages), np.concatenate(blocks)

    def search(self, hashes: np.ndarray, ptr: np.ndarray) -> dict[tuple[int, int], float]:
        """(row, item) of every pair whose score in some passage reaches the threshold, and its best score."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == hashes)
        halves = -(-np.diff(ptr) // self.half)
        first = np.concatenate(([0], np.cumsum(halves)))
        row = np.searchsorted(ptr, known, side="right") - 1
        half = first[row] + (known - ptr[row]) // self.half
        term = at[known]
        owner = np.repeat(np.arange(len(halves)), halves)
        starts = np.searchsorted(half, np.arange(len(owner) + 1))
        best: dict[tuple[int, int], float] = {}
        step = self.config.at_once
        for a in range(0, len(owner), step):
            # Passages a to b; the last one's second half is half-passage b, if that is of the same text.
            b = min(a + step, len(owner))
            c = min(b + 1, len(owner))
            part = slice(starts[a], starts[c])
            # The last half of a longer text is part of the passage before.
            whole = owner[a:c] != owner[np.maximum(np.arange(a, c) - 1, 0)]
            whole[0] |= a == 0
            self._passages(term[part], half[part] - a, owner[a:c], b - a, whole, best)
        return best

    def _passages(self, term: np.ndarray, half: np.ndarray, owner: np.ndarray, n: int, opens: np.ndarray, best: dict[tuple[int, int], float]) -> None:
        """Adds the pairs of the first n of these half-passages, each with the next one of its text; opens: the first of a text."""
        follows = np.zeros(len(owner), np.int64)
        follows[:-1] = owner[1:] == owner[:-1]
        starts = np.searchsorted(half, np.arange(len(owner) + 1))
        asked = (follows > 0) | opens
        asked[n:] = False
        second = np.flatnonzero((half > 0) & (follows[np.maximum(half - 1, 0)] > 0))
        row = distinct(np.concatenate((half * len(self.terms) + term, (half[second] - 1) * len(self.terms) + term[second])))
        row = row[asked[row // len(self.terms)]]
        passages, blocks = self.candidates(row // len(self.terms), row % len(self.terms))
        for k in np.unique(blocks).tolist():
            passage = np.sort(passages[blocks == k])
            size = starts[passage + 1 + follows[passage]] - starts[passage]
            held = np.repeat(starts[passage] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            terms, table = self.tables[k]
            place = np.minimum(np.searchsorted(terms, term[held]), len(terms) - 1)
            there = terms[place] == term[held]
            pair = distinct(np.repeat(np.arange(len(passage)), size)[there] * len(table) + place[there])
            score = np.add.reduceat(
                np.concatenate((table[pair % len(table)], table[-1:])), np.minimum(np.searchsorted(pair // len(table), np.arange(len(passage))), len(pair))
            )
            score[~np.isin(np.arange(len(passage)), pair // len(table))] = 0
            for p, i in zip(*np.nonzero(score >= self.config.threshold), strict=True):
                found = (int(owner[passage[p]]), k * self.config.block + int(i))
                best[found] = max(best.get(found, 0.0), float(score[p, i]))


class Benchmark:
    """Indexes of some items: one for each length of passage."""

    def __init__(self, items: list[tuple], config: LeakConfig, statistics: Statistics):
        """items: (id, text).  An item without a word is never found."""
        self.config = config
        classes: dict[int, list[tuple]] = {}
        for (ident, _), tokens in zip(items, _tokens([t for _, t in items]), strict=True):
            if len(tokens):
                half = config.half
                while half < len(tokens):
                    half *= 2
                classes.setdefault(half, []).append((ident, tokens))
        self.indexes = [BlockMaxIndex(own, config, statistics, half) for half, own in sorted(classes.items())]

    def search(self, column: pa.Array) -> list[tuple]:
        """(row, item id, score, question overlap, answer overlap) of every verified pair."""
        hashes, ptr = token_hashes(column, LETTER_CLASSES)
        out, runs = [], {}
        for index in self.indexes if len(hashes) else ():
            for (r, i), score in sorted(index.search(hashes, ptr).items()):
                found = []
                for size, wanted in index.parts[i]:
                    if (r, size) not in runs:
                        runs[r, size] = _runs(hashes[ptr[r] : ptr[r + 1]], size) if size else hashes[:0]
                    found.append(float(np.isin(wanted, runs[r, size]).mean()) if len(wanted) else 1.0)
                if min(found) >= self.config.overlap:
                    out.append((r, index.ids[i], score, *found))
        return sorted(out, key=lambda x: x[0])


def benchmarks(items: DataFrame, config: LeakConfig, id_col: str, text_col: str) -> Iterator[Benchmark]:
    """The whole benchmark in indexes none larger than the bounds, which are proven before a part is collected; with the
    statistics of all."""
    chosen = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n, size = chosen.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-n // config.max_items), -(-(size or 0) // config.max_bytes))
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))
    if passes == 1:
        if found := order(chosen.collect()):
            yield Benchmark(found, config, own_statistics([t for _, t in found]))
        return

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tokens in zip(batch.column("part").to_pylist(), _tokens(batch.column("text").to_pylist()), strict=True):
                own = np.unique(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(own), pa.int32()), pa.array(own.view(np.int64)), pa.array(np.where(np.arange(len(own)), 0, len(tokens)))], names=["part", "term", "length"]
                )

    staging = Staging(items.sparkSession)
    parted = staging.write(chosen.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(passes)).cast("int")))
    held = staging.write(parted.mapInArrow(terms, "part int, term long, length long"))  # a length for each item, once
    total, full = held.agg(F.sum("length"), F.count(F.when(F.col("length") > 0, 1))).first()
    known = staging.write(held.select("part", "term").distinct().join(held.groupBy("term").agg(F.count("*").alias("df")), "term"))
    for k in range(passes):
        # At most one row for each token of the part.
        rows = known.where(F.col("part") == k).select("term", "df").collect()
        own = np.array([r.term for r in rows], np.int64).view(np.uint64)
        by = np.argsort(own)
        statistics = Statistics(full, total / max(full, 1), own[by], np.array([r.df for r in rows], np.int64)[by])
        yield Benchmark(order(parted.where(F.col("part") == k).select("id", "text").collect()), config, statistics)
    staging.drop(parted, held, known)


def find_leaks(docs: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig(), id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: id, item_id, score, question_overlap, answer_overlap.

    Words are runs of letters and digits, A-Z lower-cased, so punctuation and line ends do not hide a
    copy.  Defined cases: null, empty and blank texts hold nothing and are held by nothing; an item
    of one word has an empty answer, which is always found; null ids are carried; repeated documents
    or items give a row each; texts and items of any length are searched whole; other columns are ignored; an empty table on either side gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in benchmarks(items, config, item_id, item_text):
        out = out.union(source.mapInArrow(_finder(docs, index), schema))
    return out


def _finder(docs: DataFrame, index: Benchmark):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                if found := shared.value.search(batch.column("text")):
                    rows, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(rows)), pa.array(rest[0], pa.int64()), *(pa.array(x, pa.float64()) for x in rest[1:])],
                        names=["id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

    return run


def without_leaks(docs: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of documents that hold no item, with all their columns, of any names; defined cases as in find_leaks."""
    out = docs
    for index in benchmarks(items, config, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text_col):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[x[0] for x in shared.value.search(batch.column(text_col))]] = False
                    yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out
