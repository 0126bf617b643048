"""Counts of a training corpus for the n-grams that a text asks about, in one pass over the corpus.

Python cuts n-grams from Arrow batches and keeps those in the contexts asked for, as words are, beside the counts of all words; a word
met once brings its neighbours along.  All of it meets in one shuffle by the last word, where it is told which words are unknown;
n-grams in contexts with unknown words come from those neighbours.  The corpus itself is not shuffled or kept."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"
#: Words that are counted together before they are sent on.
CHUNK = 1 << 21
_ROWS = 1 << 16
#: `ctx` of rows that count words, and of those that count ends.
_WORD, _END = -1, -2


def context_ids(grams: Iterable[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """The contexts of n-grams (h{order-1}.., h1, word), shorter ones too, by number; the last word of a context is the nearest."""
    ids: dict[tuple[str, ...], int] = {}
    for g in grams:
        for k in range(len(g) - 1):
            ids.setdefault(g[k:-1], len(ids))
    return ids


def near_columns(order: int) -> list[str]:
    """The neighbours of a word that bear on n-grams with it in their context."""
    return [*(f"p{k}" for k in range(1, order - 1)), *(f"n{k}" for k in range(1, order))]


def _counter(ids: dict[tuple[str, ...], int], order: int):
    """The function for mapInArrow: rows (ctx, word, cnt, neighbours) of batches of one column, the words of a sentence."""
    asked = sorted({w for c in ids for w in c})
    at = {w: k for k, w in enumerate(asked)}
    first = np.full(len(asked) + 1, -1, np.int64)  # of each asked word, the last entry: any other
    steps = []  # of each longer length, sorted keys (number of the context less its first word, that word) and numbers
    for c, k in ids.items():
        if len(c) == 1:
            first[at[c[0]]] = k
    for n in range(2, order):
        pairs = sorted((ids[c[1:]] * (len(asked) + 1) + at[c[0]], k) for c, k in ids.items() if len(c) == n)
        steps.append((np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)))
    near = near_columns(order)

    def rows(word: pa.Array, ctx: np.ndarray | int, cnt: np.ndarray, beside: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        ctx = np.full(len(word), ctx) if isinstance(ctx, int) else ctx
        none = pa.nulls(len(word), pa.string())
        columns = [pa.array(ctx, pa.int32()), word, pa.array(cnt, pa.int64()), *(beside.get(c, none) for c in near)]
        whole = pa.RecordBatch.from_arrays(columns, ["ctx", "word", "cnt", *near])
        for k in range(0, len(word), _ROWS):
            yield whole.slice(k, _ROWS)

    def count(parts: list[pa.Array], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate(lengths).astype(np.int64)
        coded = pc.dictionary_encode(pa.chunked_array(parts, pa.string())).combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        d = len(coded.dictionary)
        names = pa.concat_arrays([coded.dictionary, pa.array([BEGIN, END])])
        begin, end = d, d + 1
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        stop = np.cumsum(sizes + 1) - 1
        start = np.repeat(stop - sizes, sizes + 1)
        last = np.repeat(stop, sizes + 1)
        w = np.empty(len(start), np.int64)
        is_end = np.zeros(len(w), bool)
        is_end[stop] = True
        w[is_end], w[~is_end] = end, codes
        place = np.arange(len(w))
        before = lambda k, i=place: np.where(i - k >= start[i], w[np.maximum(i - k, 0)], begin)
        # Words, and the neighbours of those met once.
        counts = np.bincount(codes, minlength=d)
        where = np.empty(d, np.int64)
        where[codes] = place[~is_end]
        once = counts == 1
        i = where[once]
        beside = {f"p{k}": names.take(pa.array(before(k, i))) for k in range(1, order - 1)}
        for k in range(1, order):
            inside = i + k <= last[i]
            beside[f"n{k}"] = names.take(pa.array(w[np.minimum(i + k, len(w) - 1)], mask=~inside))
        yield from rows(names.take(pa.array(np.flatnonzero(once))), _WORD, np.ones(len(i), np.int64), beside)
        yield from rows(names.take(pa.array(np.flatnonzero(~once))), _WORD, counts[~once], {})
        yield from rows(pa.array([END]), _END, np.array([len(sizes)]), {})
        # N-grams, of contexts ever longer.
        of = pc.index_in(names, pa.array(asked, pa.string())).fill_null(len(asked)).to_numpy(zero_copy_only=False).astype(np.int64)
        live = place
        ctx = first[of[before(1)]]
        for n in range(1, order):
            if n > 1:
                keys, numbers = steps[n - 2]
                want = ctx * (len(asked) + 1) + of[before(n, live)]
                hit = np.searchsorted(keys, want)
                found = np.zeros(len(want), bool) if not len(keys) else keys[np.minimum(hit, len(keys) - 1)] == want
                ctx = np.where(found, numbers[np.minimum(hit, len(keys) - 1)], -1) if len(keys) else np.full(len(want), -1)
            live, ctx = live[ctx >= 0], ctx[ctx >= 0]
            pairs, cnt = np.unique(ctx * (d + 2) + w[live], return_counts=True)
            yield from rows(names.take(pa.array(pairs % (d + 2))), pairs // (d + 2), cnt, {})

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lengths, n = [], [], 0
        for b in batches:
            lists = b.column(0)
            parts.append(lists.flatten().cast(pa.string()))
            lengths.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            n += len(parts[-1])
            if n >= CHUNK:
                yield from count(parts, lengths)
                parts, lengths, n = [], [], 0
        if lengths and sum(map(len, lengths)):
            yield from count(parts, lengths)

    return step


class AskedCounts:
    """`count`, `total` and `types` of closed n-grams and contexts, by tuples of words, for n-grams `grams` as a text writes them."""

    def __init__(self, rows: DataFrame, grams: set[tuple[str, ...]], order: int, threshold: int):
        assert threshold <= 1, "the neighbours of words met more often are not sent"
        self.grams, self.order, self.threshold = grams, order, threshold
        spark = rows.sparkSession
        ids, near = context_ids(grams), near_columns(order)
        kind = ", ".join(["ctx int, word string, cnt long", *(f"{c} string" for c in near)])
        met = rows.select("words").mapInArrow(_counter(ids, order), kind).repartition("word").groupBy("word", "ctx", *near).agg(F.sum("cnt").alias("cnt"))
        times = F.sum(F.when(F.col("ctx") == _WORD, F.col("cnt"))).over(W.partitionBy("word"))
        self._met = met.withColumn("rare", F.coalesce(times <= threshold, F.lit(False))).persist()
        of_words = self._met.where(F.col("ctx") == _WORD)
        self.vocab = of_words.groupBy("word").agg(F.sum("cnt").alias("cnt")).persist()
        asked = spark.createDataFrame([(w,) for w in sorted({w for g in grams for w in g})], "word string")
        known = self._met.where(~F.col("rare") & (F.col("ctx") == _WORD)).join(F.broadcast(asked), "word").groupBy("word").agg(F.sum("cnt").alias("cnt"))
        ones = {r.word: r.cnt for r in known.collect()}
        self.known = set(ones)
        n_words, n_rare = of_words.agg(F.coalesce(F.sum("cnt"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("rare"), F.col("cnt"))), F.lit(0))).first()
        n_known = self.vocab.where(F.col("cnt") > threshold).count()
        n_ends = self._met.where(F.col("ctx") == _END).agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
        self.n_all, self.v = (n_words + n_ends) or None, n_known + 2
        self.count: Counter[tuple[str, ...]] = Counter({(w,): c for w, c in ones.items()})
        self.count[UNKNOWN,], self.count[END,] = n_rare, n_ends
        self.total: Counter[tuple[str, ...]] = Counter()
        self.types: Counter[tuple[str, ...]] = Counter()
        closed = {self.close(g) for g in grams}
        contexts = {g[k:-1]: None for g in closed for k in range(order - 1)}
        wanted = {g[k:] for g in closed for k in range(order - 1)}
        plain = {c: ids[c] for c in contexts if UNKNOWN not in c and c in ids}
        last = F.when(F.col("rare"), F.lit(UNKNOWN)).otherwise(F.col("word"))
        self._add(self._met.where(F.col("ctx") >= 0).select("ctx", last.alias("word"), "rare", "cnt"), plain, wanted)
        odd = {c: k for k, c in enumerate(c for c in contexts if UNKNOWN in c)}
        if odd and n_rare:
            self._add(self._beside_rare(odd), odd, wanted)

    def close(self, gram: tuple[str, ...]) -> tuple[str, ...]:
        """An n-gram in the model's words."""
        return tuple(w if w in self.known or w in (BEGIN, END) else UNKNOWN for w in gram)

    def _add(self, followers: DataFrame, numbers: dict[tuple[str, ...], int], wanted: set[tuple[str, ...]]) -> None:
        """Takes up rows (ctx, word, rare, cnt), a row for each known word of a context; only sums leave the executors."""
        spark, names = followers.sparkSession, {k: c for c, k in numbers.items()}
        kept = spark.createDataFrame([(numbers[g[:-1]], g[-1], True) for g in wanted if g[:-1] in numbers], "ctx int, word string, kept boolean")
        live = spark.createDataFrame([(k,) for k in names], "ctx int")
        each = followers.join(F.broadcast(live), "ctx").join(F.broadcast(kept), ["ctx", "word"], "left")  # as few as the asked n-grams
        sums = each.groupBy("ctx", F.when(F.col("kept"), F.col("word")).alias("word")).agg(F.sum("cnt").alias("cnt"), F.count_if(~F.col("rare")).alias("types"), F.bool_or("rare").alias("rare"))
        has_rare = set()
        for r in sums.collect():
            c = names[r.ctx]
            self.total[c] += r.cnt
            self.types[c] += r.types
            if r.rare:
                has_rare.add(c)
            if r.word is not None:
                self.count[*c, r.word] += r.cnt
        for c in has_rare:
            self.types[c] += 1

    def _beside_rare(self, odd: dict[tuple[str, ...], int]) -> DataFrame:
        """(ctx, word, rare, cnt) of the n-grams with an unknown word in the context, each from the unknown word nearest to its end."""
        near = near_columns(self.order)
        rare = self._met.where(F.col("rare") & (F.col("ctx") == _WORD))
        marks, rows = rare.select("word"), rare.select(*near)
        for c in near:
            rows = rows.join(marks.select(F.col("word").alias(c), F.lit(True).alias("is_rare")), c, "left")
            rows = rows.withColumn(c, F.when(F.col("is_rare"), F.lit(UNKNOWN)).otherwise(F.col(c))).drop("is_rare")
        each = []
        for n in range(2, self.order + 1):
            for j in range(1, n):
                context = [*(F.col(f"p{i - j}") for i in range(n - 1, j, -1)), F.lit(UNKNOWN), *(F.col(f"n{j - i}") for i in range(j - 1, 0, -1))]
                between = F.forall(F.array(*context[n - j :]), lambda x: x != UNKNOWN) if j > 1 else F.lit(True)
                each.append(F.when(between & F.col(f"n{j}").isNotNull(), F.struct(F.array(*context).alias("context"), F.col(f"n{j}").alias("word"))))
        made = rows.select(F.explode(F.array(*each)).alias("x")).where("x is not null").select("x.*")
        numbers = rows.sparkSession.createDataFrame([(list(c), k) for c, k in odd.items()], "context array<string>, ctx int")
        made = made.join(F.broadcast(numbers), "context").groupBy("ctx", "word").agg(F.count("*").alias("cnt"))
        return made.select("ctx", "word", (F.col("word") == UNKNOWN).alias("rare"), "cnt")
