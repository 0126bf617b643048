"""Embedding near duplicates by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; the coordinate of
largest magnitude, with its sign, is one hash.  `width` hashes make a bucket code, and every vector
is entered under its own code and under the next best codes (multiprobe) of each table.  Buckets
propose, double-precision cosines confirm.  Vectors that share several buckets are counted in the
first of them, which the codes tell without emitting pairs; a bucket gives counts and a spanning
forest, never its pairs.  Equal vectors are merged before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, join_hot, ragged, ragged_parts, signed
from .components import connected_components
from .tokens import combine, mix


@dataclass(frozen=True)
class PolytopeConfig:
    """cosine: links at least this similar.  tables x probes codes a vector.  width: hashes in a
    code; None takes as many as make a code rarer than one vector, ceil(log n / log 2d)."""

    cosine: float = 0.98
    tables: int = 8
    probes: int = 3
    width: int | None = None
    block: int = 512
    seed: int = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of every row; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d) / math.sqrt(d)


def bucket_codes(x: np.ndarray, config: PolytopeConfig, width: int) -> np.ndarray:
    """Codes of unit vectors, one row a vector: tables x probes."""
    n, d = x.shape
    full = 1 << max(1, (d - 1).bit_length())
    rng = np.random.Generator(np.random.PCG64((config.seed, d)))
    padded = np.zeros((n, full))
    padded[:, :d] = x
    out = np.empty((n, config.tables * config.probes), np.uint64)
    for t in range(config.tables):
        best, second, gap = (np.empty((n, width), kind) for kind in (np.int64, np.int64, float))
        for k in range(width):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], full))
            size = np.abs(y)
            top = np.argpartition(size, -2, axis=1)[:, -2:]
            pair = np.take_along_axis(size, top, 1)
            swap = pair[:, 0] > pair[:, 1]
            first, other = np.where(swap, top[:, 0], top[:, 1]), np.where(swap, top[:, 1], top[:, 0])
            gap[:, k] = np.abs(pair[:, 1] - pair[:, 0])
            for to, at in ((best, first), (second, other)):
                to[:, k] = 2 * at + (np.take_along_axis(y, at[:, None], 1)[:, 0] < 0)
        order = np.argsort(gap, axis=1, kind="stable")
        for p in range(config.probes):
            # Probe p gives up the p-th least certain coordinate; past the last it repeats the code.
            code = best.copy()
            if 0 < p <= width:
                at = order[:, p - 1 : p]
                np.put_along_axis(code, at, np.take_along_axis(second, at, 1), 1)
            out[:, t * config.probes + p] = combine(mix(np.full(n, t, np.uint64)), *(code[:, k].astype(np.uint64) for k in range(width)))
    return out


def _unit(flat: np.ndarray, ptr: np.ndarray, rows: np.ndarray, d: int) -> np.ndarray:
    x = flat[ptr[rows][:, None] + np.arange(d)].astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            u = queue.pop()
            hit = np.flatnonzero(linked[u] & left)
            left[hit] = False
            edges += [(u, v) for v in hit.tolist()]
            queue += hit.tolist()
    return edges


def link_vectors(vectors: DataFrame, config: PolytopeConfig = PolytopeConfig(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """One row a vector: id, n_links, component_id and kept (the id is the smallest of its component).

    Two vectors are linked if their labels are equal and not null (any, without a label column) and
    their cosine is at least the threshold.  Defined cases: a null or zero vector, one with null or
    non-finite components, and a null id or label link with nothing; vectors of different lengths
    never link; rows that repeat an id are different vectors, each with the links and the component of its
    own, whose id is the smallest of any vector in it; other columns are ignored; a null id is kept and its component is
    null; an empty table gives no rows.
    """
    staging = Staging(vectors.sparkSession)
    value = F.col(vector_col).cast("array<double>")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    fine = F.coalesce(
        ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(value, lambda v: v != 0), F.lit(False)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.when(fine, value).alias("v"))
    usable = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    # A class of equal vectors has a number of its own, fixed once it is written; ids may repeat.
    classes = staging.write(
        rows.where(usable).groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id())
    )
    n = classes.count()
    longest = classes.agg(F.max(F.size("v"))).first()[0] or 2
    width = config.width or max(2, math.ceil(math.log(max(n, 2)) / math.log(2 * longest)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ptr = ragged_parts(batch.column("v"))
            dims = np.diff(ptr)
            codes = np.empty((batch.num_rows, config.tables * config.probes), np.uint64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                codes[at] = bucket_codes(_unit(flat, ptr, at, int(d)), config, width)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("label", "rep", "copies", "v")), ragged(signed(codes.ravel()), np.arange(len(codes) + 1) * codes.shape[1])],
                names=["label", "rep", "copies", "v", "codes"],
            )

    kept = staging.write(classes.mapInArrow(coded, "label string, rep long, copies long, v array<double>, codes array<long>"))
    entered = kept.select("label", "rep", F.size("v").alias("d"), F.explode(F.array_distinct("codes")).alias("code"))
    shared = (
        entered.groupBy("label", "d", "code").agg(F.count("*").alias("n")).where("n > 1")
        .select("label", "d", "code", F.ceil(F.col("n") / config.block).cast("int").alias("parts"))
    )
    dealt = (
        entered.join(shared, ["label", "d", "code"])
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .select("rep", "label", "d", "code", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("rep", "label", "d", "code", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part")
        .join(kept.select("rep", "copies", "v", "codes"), "rep")
    )

    def confirm(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rep, copies, part = (group.column(c).to_numpy() for c in ("rep", "copies", "part"))
        code, lo, hi = (group.column(c)[0].as_py() for c in ("code", "lo", "hi"))
        flat, ptr = ragged_parts(group.column("v"))
        unit = _unit(flat, ptr, np.arange(len(rep)), int(ptr[1]))
        similar = unit @ unit.T >= config.cosine
        np.fill_diagonal(similar, False)
        if lo != hi:  # pairs inside one part belong to the task of that part alone
            similar &= part[:, None] != part[None, :]
        edges = forest(similar)
        # A pair is counted under the smallest code that both have.
        codes = ragged_parts(group.column("codes"))[0].reshape(len(rep), -1)
        row, at = np.nonzero(codes < code)
        values, place, often = np.unique(codes[row, at], return_inverse=True, return_counts=True)
        has = np.zeros((len(rep), len(values)), np.float32)
        has[row, place] = 1
        has = has[:, often > 1]
        counted = similar & (has @ has.T == 0)
        links = counted @ copies
        some = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.array(np.concatenate((rep[some], rep[[e[0] for e in edges]] if edges else rep[:0]))),
                "b": pa.array([None] * len(some) + [int(rep[e[1]]) for e in edges], pa.int64()),
                "n": pa.array(np.concatenate((links[some], np.zeros(len(edges), np.int64))).astype(np.int64)),
            }
        )

    found = staging.write(dealt.groupBy("label", "d", "code", "lo", "hi").applyInArrow(confirm, "a long, b long, n long"))
    counts = found.groupBy("a").agg(F.sum("n").alias("others"))
    component = connected_components(found.where("b is not null"), staging)
    joined = (
        classes.join(counts, classes.rep == counts.a, "left")
        .join(component.withColumnRenamed("label", "root"), F.col("rep") == F.col("node"), "left")
        .select("label", "v", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_hot(joined, n, smallest, "root", F.xxhash64("v")).select("label", "v", "n_links", "component_id")
    grouped = rows.where(usable).join(named, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = staging.write(alone.union(grouped).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))
    staging.drop(classes, kept, found, component)
    return out
