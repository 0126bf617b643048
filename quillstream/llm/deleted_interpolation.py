"""Language-model scores by deleted interpolation.

P(w | v) = l2[b] * c(v w)/c(v) + l1[b] * c(w)/N + l0[b] / (V + 1), where b is the bucket of the
context's frequency c(v).  The weights of each bucket come from expectation-maximisation on held-out
training documents, with counts of the other training documents; the final counts are those of all.

Documents are tokenised once into chunks of about a million tokens.  A chunk asks for its distinct
unigrams and bigrams only, packed in sorted blobs dealt out by key range; each range adds up its
counts and answers every chunk in the chunk's own order, so that answers need no keys.  A frequent
word is one entry a chunk and never a hot key.  The chunk table is bucketed by chunk, so the
answers move to the chunks and the chunks stay.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, pack, pack_sorted, ragged, slices, unpack, unpack_sorted
from .tokens import combine, distinct, mix, token_hashes

_END = mix(np.array([1], np.uint64))[0]
_BEGIN = mix(np.array([2], np.uint64))[0]
_SHORT = np.uint64(8)  # keys are the upper 56 bits of the hashes
_BITS = 56
_NONE = np.uint64(0)


@dataclass(frozen=True)
class InterpolationConfig:
    """folds: parts of the documents, by crc32 of the id.  test_fold is never learned from; em_fold
    is the held-out part of the training documents.  chunk and key_range: tokens in a chunk, and
    tokens for each range of keys.  steps: histogram steps an octave, for the weights only."""

    folds: int = 10
    test_fold: int = 0
    em_fold: int = 9
    chunk: int = 1 << 20
    key_range: int = 1 << 21
    add: float = 0.1
    steps: int = 4
    rounds: int = 60


_BUCKETS = 48


def _chunks(config: InterpolationConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def emit() -> pa.RecordBatch:
            tokens = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            ids = pa.concat_arrays([h[2] for h in held])
            fold = np.concatenate([h[3] for h in held])
            words, at = np.unique(tokens, return_inverse=True)
            name = int.from_bytes(os.urandom(8), "little") >> 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([name]), pa.array([len(tokens)]), ragged(ids, np.array([0, len(ids)])),
                    pa.array([pack(fold.astype(np.uint8))], pa.binary()), pa.array([pack(sizes.astype(np.uint32))], pa.binary()),
                    pa.array([pack_sorted(words)], pa.binary()), pa.array([pack(at.astype(np.uint32))], pa.binary()),
                ],
                names=["chunk", "n_tokens", "ids", "fold", "sizes", "words", "tokens"],
            )

        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, ptr = token_hashes(batch.column("text"))
                n = batch.num_rows
                out = np.empty(len(hashes) + n, np.uint64)
                ends = ptr[1:] + np.arange(n)
                is_end = np.zeros(len(out), bool)
                is_end[ends] = True
                out[is_end], out[~is_end] = _END, hashes
                held.append((out, np.diff(ptr) + 1, batch.column("id"), batch.column("fold").to_numpy()))
                total += len(out)
                if total >= config.chunk:
                    yield emit()
                    held, total = [], 0
        if held:
            yield emit()

    return run


_CHUNK = "chunk long, n_tokens long, ids array<long>, fold binary, sizes binary, words binary, tokens binary"


class _Chunk:
    """A chunk with its distinct keys: words and contexts, then bigrams."""

    def __init__(self, row: dict):
        self.fold, self.sizes = unpack(row["fold"]), unpack(row["sizes"]).astype(np.int64)
        words, at = unpack_sorted(row["words"]), unpack(row["tokens"]).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        tokens = words[at]
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first] = _BEGIN
        self.pairs = combine(before, tokens) >> _SHORT
        self.uni = distinct(np.append(words, _BEGIN) >> _SHORT)
        self.word = np.searchsorted(self.uni, words >> _SHORT)[at]
        self.begin = int(np.searchsorted(self.uni, _BEGIN >> _SHORT))
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.first] = self.begin
        self.token_fold = np.repeat(self.fold, self.sizes)

    def counted(self, config: InterpolationConfig) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Keys, counts in the larger part of the training documents, counts in the held-out part."""
        out = []
        learn, em = (self.fold != config.test_fold) & (self.fold != config.em_fold), self.fold == config.em_fold
        t_learn, t_em = np.repeat(learn, self.sizes), np.repeat(em, self.sizes)
        counts = [np.bincount(self.word[m], minlength=len(self.uni)) for m in (t_learn, t_em)]
        for c, m in zip(counts, (learn, em), strict=True):
            c[self.begin] = m.sum()
        out.append((self.uni, *counts))
        order = np.argsort(self.pairs, kind="stable")
        keys = self.pairs[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        out.append((keys[starts], *(np.add.reduceat(m[order].astype(np.int64), starts) for m in (t_learn, t_em))))
        return out


def _asked(config: InterpolationConfig, ranges: int):
    """Rows (part, kind, chunk, keys, learn, em): a chunk's keys of one kind in one range."""
    bounds = np.array([(k << _BITS) // ranges for k in range(ranges + 1)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, (keys, learn, em) in enumerate(_Chunk(row).counted(config)):
                    cuts = np.searchsorted(keys, bounds)
                    rows = [
                        (p, kind, row["chunk"], pack_sorted(keys[a:b]), pack(learn[a:b].astype(np.uint32)), pack(em[a:b].astype(np.uint32)))
                        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                        if a < b
                    ]
                    yield pa.RecordBatch.from_pylist([dict(zip(_ASKED.names, r, strict=True)) for r in rows], schema=_ASKED)

    return run


_ASKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("learn", pa.binary()), ("em", pa.binary())])


def _answer(group: pa.Table) -> pa.Table:
    """The counts of a key range over all chunks, in the order in which each chunk asked."""
    kind = group.column("kind")[0].as_py()
    keys = [unpack_sorted(x) for x in group.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts, place = np.flatnonzero(new), np.empty(len(flat), np.int64)
    place[order] = np.cumsum(new) - 1
    totals = [np.add.reduceat(np.concatenate([unpack(x) for x in group.column(c).to_pylist()])[order].astype(np.int64), starts) for c in ("learn", "em")]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    back = [[pack(t[place[a:b]].astype(np.uint64)) for a, b in zip(cuts, cuts[1:], strict=False)] for t in totals]
    n = len(keys)
    stats = np.zeros((4, n), np.int64)
    if kind == 0:
        real = ranked[starts] != (_BEGIN >> _SHORT)
        learn, em = (t[real] for t in totals)
        stats[:, 0] = learn.sum(), em.sum(), (learn > 0).sum(), (learn + em > 0).sum()
    return pa.table(
        {"chunk": group.column("chunk"), "kind": group.column("kind"), "part": group.column("part"), "learn": pa.array(back[0], pa.binary()), "em": pa.array(back[1], pa.binary())}
        | {c: pa.array(stats[k]) for k, c in enumerate(("n_learn", "n_em", "v_learn", "v_all"))}
    )


_ANSWER = "chunk long, kind int, part int, learn binary, em binary, n_learn long, n_em long, v_learn long, v_all long"


def _counts(row: dict) -> tuple[_Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk and, for its words and bigrams, counts in the larger part and in all training documents."""
    chunk = _Chunk(row)
    found = {}
    for kind in (0, 1):
        own = sorted((a for a in row["answers"] if a["kind"] == kind), key=lambda a: a["part"])
        found[kind] = [np.concatenate([unpack(a[c]) for a in own]).astype(np.int64) for c in ("learn", "em")]
    return chunk, found[0][0], found[0][0] + found[0][1], found[1][0], found[1][0] + found[1][1]


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, _BUCKETS - 1), 0)


def _parts(chunk: _Chunk, keep: np.ndarray, uni: np.ndarray, bi: np.ndarray, n: int, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bucket, bigram estimate and unigram estimate of the kept tokens."""
    context, c1 = uni[chunk.context[keep]], uni[chunk.word[keep]]
    c2 = bi[np.searchsorted(pairs, chunk.pairs[keep])]
    return _bucket(context), c2 / np.maximum(context, 1), c1 / max(n, 1)


def fit_weights(histogram: list[tuple[int, float, float, int]], rounds: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of every bucket, from (bucket, p2/p0, p1/p0, tokens).

    A bucket without held-out tokens takes the weights fitted to all; the uniform part never falls
    below 1e-6, so that every text keeps a finite score.
    """
    out = np.tile(np.array([0.3, 0.6, 0.1]), (_BUCKETS, 1))
    if histogram:
        b, r2, r1, n = (np.array(x, float) for x in zip(*histogram, strict=True))
        ratios = np.stack([r2, r1, np.ones_like(r1)])

        def climb(where: np.ndarray) -> np.ndarray:
            w = np.array([0.3, 0.6, 0.1])
            for _ in range(rounds):
                share = w[:, None] * ratios[:, where]
                w = (share / share.sum(0) * n[where]).sum(1) / n[where].sum()
            return w

        out[:] = climb(np.ones(len(b), bool))
        for k in range(_BUCKETS):
            if (b == k).any():
                out[k] = climb(b == k)
    out[0, 0] = 0
    out[:, 2] = np.maximum(out[:, 2], 1e-6)
    out[:, 1] = np.maximum(out[:, 1], 1e-6)
    return out / out.sum(1, keepdims=True)


def score_documents(docs: DataFrame, config: InterpolationConfig = InterpolationConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text, A-Z lower-cased, and one end.  base_score is the log10
    probability under the training unigrams with `add` added to each count and one unseen class;
    score is that of the interpolated model.  Defined cases: a null or empty text is one end token;
    a null id counts as held out; rows that repeat an id are scored and counted each by itself; a text of any length is
    one entry of a chunk and must fit in a task; counts are exact as long as no two words or bigrams share a 56-bit hash;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    staging = Staging(spark)
    fold = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(config.folds)), F.lit(config.test_fold)).cast("int")
    source = docs.select(F.col(id_col).cast("long").alias("id"), fold.alias("fold"), F.col(text_col).cast("string").alias("text"))
    name = f"quillstream_chunks_{uuid.uuid4().hex}"
    buckets = max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunked = source.mapInArrow(_chunks(config), _CHUNK).write.option("compression", "uncompressed").option("path", staging.path())
    chunked.bucketBy(buckets, "chunk").saveAsTable(name)  # the catalog knows the buckets; the rows are in the shared folder
    try:
        chunks = spark.table(name)
        tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
        ranges = max(1, -(-tokens // config.key_range))
        answers = staging.write(
            chunks.mapInArrow(_asked(config, ranges), "part int, kind int, chunk long, keys binary, learn binary, em binary")
            .groupBy("part", "kind").applyInArrow(_answer, _ANSWER)
        )
        n_learn, n_em, v_learn, v_all = (x or 0 for x in answers.agg(*(F.sum(c) for c in ("n_learn", "n_em", "v_learn", "v_all"))).first())
        joined = chunks.join(
            answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "learn", "em")).alias("answers")), "chunk"
        )
        scale, steps = v_learn + 1, config.steps
        schema = "bucket int, q2 int, q1 int, n long"

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    chunk, uni, _, bi, _ = _counts(row)
                    keep = np.flatnonzero(chunk.token_fold == config.em_fold)
                    if not len(keep):
                        continue
                    b, p2, p1 = _parts(chunk, keep, uni, bi, n_learn, distinct(chunk.pairs))
                    q2, q1 = (np.where(p > 0, np.round(steps * np.log2(np.maximum(p, 1e-18) * scale)) + 1000, 0) for p in (p2, p1))
                    cells, n = np.unique(np.stack([b, q2, q1]).astype(np.int32), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cells), pa.array(n)], names=["bucket", "q2", "q1", "n"])

        # At most one row for each bucket and pair of steps: bounded whatever the corpus.
        cells = joined.mapInArrow(histogram, schema).groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).collect()
        ratio = lambda q: 2.0 ** ((q - 1000) / steps) if q else 0.0
        weights = fit_weights([(r.bucket, ratio(r.q2), ratio(r.q1), r.n) for r in cells], config.rounds)
        n_all, add = n_learn + n_em, config.add

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    chunk, _, uni, _, bi = _counts(row)
                    every = slice(None)
                    b, p2, p1 = _parts(chunk, every, uni, bi, n_all, distinct(chunk.pairs))
                    w = weights[b]
                    logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v_all + 1))
                    c = uni[chunk.word]
                    base = np.log10((c + add) / (n_all + add * (v_all + 1)))
                    per = lambda x: np.add.reduceat(x, chunk.first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["ids"], pa.int64()), pa.array(chunk.fold == config.test_fold), pa.array(chunk.sizes),
                            pa.array(per((c > 0).astype(np.int64))), pa.array(np.full(len(chunk.sizes), n_all, np.int64)), pa.array(per(base)), pa.array(per(logs)),
                        ],
                        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

        result = staging.write(
            joined.mapInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        )
        staging.drop(answers)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        staging.forget(1)
    return result.withColumnRenamed("id", id_col)
