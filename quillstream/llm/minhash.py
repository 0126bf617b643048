"""Near duplicates by min-max hashing.

Every permutation of the shingle hashes gives two signature values, the smallest and the largest,
so that half as many permutations as values are evaluated.  Bands of the signature make buckets.  A
bucket's sets are held against its first one by their whole signatures, of which one byte a value is
enough; where some are unlike it, the bucket is compared in blocks, again by signatures.  What is alike makes
clusters, and inside a cluster every link is confirmed on the full shingle sets: first in each block
and against a few pivots, then, for the sets that this leaves apart, against all blocks.  So a large
group of copies of one text is confirmed in a number of comparisons that grows with the group and not with its square.
Exact copies (equal sets) are merged before, so their number costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, Staging, bytes_column, join_hot, ragged, ragged_parts, signed, slices
from .components import connected_components
from .tokens import combine, distinct_by_row, mix, row_of, shingles, token_hashes


@dataclass(frozen=True)
class MinMaxConfig:
    """shingle: words in a shingle.  percent: similarity that links, in hundredths.
    bands x rows values make the signature, two for each permutation.
    At 0.85 a pair is missed by all bands with a chance of 8e-5 (20 bands of 6).
    slack: hundredths below `percent` that the share of equal signature values may fall for two sets to
    be confirmed in full; a pair at the threshold falls lower with a chance of 4e-7 (20 of 120 values).
    block, mass: sets and shingles in a block, about, so that a cluster of very long texts fits as well as one of very many.
    pivots: of a cluster of several blocks."""

    shingle: int = 3
    percent: int = 85
    bands: int = 20
    rows: int = 6
    slack: int = 20
    block: int = 512
    mass: int = 1 << 20
    pivots: int = 8
    seed: int = 11


def _set_hashes(sets: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every set; 0 where it is empty."""
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(salt)))))
        out.append(mix((sums[ptr[1:]] - sums[ptr[:-1]]) + np.diff(ptr).astype(np.uint64)))
    return out[0], out[1]


def band_keys(sets: np.ndarray, ptr: np.ndarray, config: MinMaxConfig) -> tuple[np.ndarray, np.ndarray]:
    """One key a band for every set, as rows, and a byte of every signature value; empty sets must not be among them."""
    n, values = len(ptr) - 1, config.bands * config.rows
    rng = np.random.Generator(np.random.PCG64(config.seed))
    factors = rng.integers(1, 2**63, (values + 1) // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    signature = np.empty((2 * len(factors), n), np.uint64)
    for k, f in enumerate(factors):
        x = sets * f
        np.minimum.reduceat(x, ptr[:-1], out=signature[2 * k])
        np.maximum.reduceat(x, ptr[:-1], out=signature[2 * k + 1])
    signature = signature[:values]
    keys = np.empty((n, config.bands), np.uint64)
    for band in range(config.bands):
        part = signature[band * config.rows : (band + 1) * config.rows]
        keys[:, band] = combine(np.full(n, band, np.uint64), *part)
    return keys, np.ascontiguousarray((mix(signature) >> np.uint64(56)).astype(np.uint8).T)


def _sets(column: pa.Array, config: MinMaxConfig) -> tuple[np.ndarray, np.ndarray]:
    return distinct_by_row(*shingles(*token_hashes(column), config.shingle))


def sketches(docs: DataFrame, config: MinMaxConfig, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n_shingles, h1, h2, keys, marks): set size, the set's identity, its band keys and the bytes of its
    signature (both empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, ptr = _sets(batch.column("text"), config)
                h1, h2 = _set_hashes(sets, ptr)
                full = np.flatnonzero(np.diff(ptr) > 0)
                keys, counts, marks = np.zeros(0, np.uint64), np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
                if len(full):
                    tight = np.concatenate(([0], np.cumsum(np.diff(ptr)[full])))
                    keys, rows = band_keys(sets, tight, config)
                    counts[full] = config.bands
                    for k, row in zip(full.tolist(), rows, strict=True):
                        marks[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("text_hash"), pa.array(np.diff(ptr)), signed(h1), signed(h2),
                        ragged(signed(keys.ravel()), np.concatenate(([0], np.cumsum(counts)))), bytes_column(marks),
                    ],
                    names=["id", "text_hash", "n_shingles", "h1", "h2", "keys", "marks"],
                )

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, text_hash long, n_shingles long, h1 long, h2 long, keys array<long>, marks binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _marks(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.stack([np.frombuffer(x, np.uint8) for x in column.to_pylist()])


def candidates(classes: DataFrame, config: MinMaxConfig, staging: Staging) -> DataFrame:
    """(a, b): edges that join all sets (node, keys, marks) that share a band and whose signatures are alike, directly or by way
    of others."""
    need = config.bands * config.rows * (config.percent - config.slack) / 100
    bands = classes.select("node", F.explode("keys").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    star = staging.write(bands.join(hubs, "key").where("node <> hub").select("key", "node", "hub", "n"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alike = (_marks(batch.column("x")) == _marks(batch.column("y"))).sum(1) >= need
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub"), pa.array(alike)], names=["node", "hub", "alike"])

    pairs = star.select("node", "hub").distinct().join(classes.select("node", F.col("marks").alias("x")), "node")
    marked = join_hot(pairs, star.count(), classes.select(F.col("node").alias("hub"), F.col("marks").alias("y")), "hub", F.col("node"))
    judged = staging.write(marked.select("node", "hub", "x", "y").mapInArrow(compare, "node long, hub long, alike boolean"))
    close = judged.where("alike").select(F.col("node").alias("a"), F.col("hub").alias("b"))

    # Buckets with a set unlike the first; of buckets with the same members one is enough.
    mixed = star.where("n > 2").join(judged.where("not alike"), ["node", "hub"], "left_semi").select("key").distinct()
    member = star.join(mixed, "key").select("key", "node", "hub", "n")
    alone = member.groupBy("key", "hub", "n").agg(F.bit_xor(F.xxhash64("node")).alias("whole")).groupBy("hub", "n", "whole").agg(F.min("key").alias("key")).select("key")
    member = member.join(alone, "key")
    member = member.select("key", "node", "n").union(member.select("key", F.col("hub").alias("node"), "n").distinct())
    parts = F.ceil(F.col("n") / (4 * config.block)).cast("int")
    dealt = (
        member.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .select("key", "node", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node")
        .join(classes.select("node", "marks"), "node")
    )

    def search(group: pa.Table) -> pa.Table:
        # In order, so that buckets of the same sets give the same edges.
        node, first = np.unique(group.column("node").to_numpy(), return_index=True)
        marks = _marks(group.column("marks"))[first]
        left, a, b = np.ones(len(node), bool), [], []
        for root in range(len(node)):
            queue = [root] if left[root] else []
            left[root] = False
            while queue:
                u = queue.pop()
                rest = np.flatnonzero(left)
                hit = rest[(marks[rest] == marks[u]).sum(1) >= need]
                left[hit] = False
                a += [node[u]] * len(hit)
                b += node[hit].tolist()
                queue += hit.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return close.union(dealt.groupBy("key", "lo", "hi").applyInArrow(search, "a long, b long"))


def linked(sets: np.ndarray, ptr: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of sets whose similarity is at least `percent` hundredths.

    Search from a set compares it in full with every set not reached yet, so that each pair
    between different trees is tested, and pairs inside a tree only as far as needed."""
    _, local = np.unique(sets, return_inverse=True)
    sizes = np.diff(ptr)
    present = np.zeros(int(local.max()) + 1 if len(local) else 1, np.int64)
    left = np.ones(len(sizes), bool)
    edges: list[tuple[int, int]] = []
    for root in range(len(sizes)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            a, rest = sizes[u], np.flatnonzero(left)
            rest = rest[(100 * np.minimum(a, sizes[rest]) >= percent * np.maximum(a, sizes[rest]))]
            if not len(rest):
                continue
            own = local[ptr[u] : ptr[u + 1]]
            present[own] = 1
            if len(rest) * 4 > len(sizes):
                common = np.add.reduceat(present[local], ptr[:-1])[rest]
            else:
                common = np.array([present[local[ptr[v] : ptr[v + 1]]].sum() for v in rest])
            present[own] = 0
            hit = rest[100 * common >= percent * (a + sizes[rest] - common)]
            left[hit] = False
            edges += [(u, v) for v in hit.tolist()]
            queue += hit.tolist()
    return edges


def _links(member: DataFrame, docs: DataFrame, config: MinMaxConfig, id_col: str, text_col: str, staging: Staging) -> DataFrame:
    """(a, b): a spanning forest of the confirmed links in every place, from rows (label, node, rep, h1, h2, places)."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, ptr = _sets(batch.column("text"), config)
                h1, h2 = _set_hashes(sets, ptr)
                same = (h1.view(np.int64) == batch.column("h1").to_numpy()) & (h2.view(np.int64) == batch.column("h2").to_numpy())
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "node", "places")), ragged(signed(sets), ptr)], names=["label", "node", "places", "shingles"])
                yield out.filter(pa.array(same))

    def confirm(group: pa.Table) -> pa.Table:
        node, first = np.unique(group.column("node").to_numpy(), return_index=True)
        flat, ptr = ragged_parts(group.column("shingles").take(pa.array(first)))
        pairs = linked(flat.view(np.uint64), ptr, config.percent)
        a, b = (node[[p[k] for p in pairs]] if pairs else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    # Few texts are asked for: the others are left out before the join.
    asked = staging.write(member.select("label", "node", "h1", "h2", "places", F.col("rep.id").alias("id"), F.col("rep.text_hash").alias("text_hash")))
    texts = BitFilter(staging, asked, "id", "text_hash").rows(_texts(docs, id_col, text_col), "id", "text_hash")
    full = asked.join(texts, ["id", "text_hash"]).select("label", "node", "h1", "h2", "places", "text")
    sets = full.mapInArrow(shingled, f"label long, node long, places {_PLACES}, shingles array<long>")
    return sets.select("label", "node", "shingles", F.explode("places").alias("at")).select("label", "at.r", "at.p", "node", "shingles").groupBy("label", "r", "p").applyInArrow(confirm, "a long, b long")


_PLACES = "array<struct<r:int,p:int>>"


def _place(parts: Column, make) -> Column:
    return F.transform(F.sequence(F.lit(0), parts - 1), make)


def confirmed_components(member: DataFrame, docs: DataFrame, config: MinMaxConfig, id_col: str, text_col: str, staging: Staging) -> DataFrame:
    """(node, label): components of the confirmed links between members (label, node, rep, h1, h2, n_shingles) of a cluster."""
    at = lambda r, p: F.struct(r.cast("int").alias("r"), p.cast("int").alias("p"))
    parts = F.ceil(F.greatest(F.count("*") / config.block, F.sum("n_shingles") / config.mass)).cast("int")
    sizes = member.groupBy("label").agg(parts.alias("parts"))
    member = join_hot(member, member.count(), sizes, "label", F.col("node"))
    member = staging.write(member.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    several = member.where("parts > 1")
    pivot = several.groupBy("label", F.pmod(F.xxhash64("h1"), F.lit(config.pivots)).alias("k")).agg(F.min("node").alias("node")).select("node", F.lit(True).alias("is_pivot"))
    zero = F.lit(0)
    places = F.when(F.col("is_pivot"), _place(F.col("parts"), lambda p: at(zero, p))).otherwise(F.array(at(zero, F.col("part"))))
    first = _links(member.join(pivot, "node", "left").withColumn("places", places), docs, config, id_col, text_col, staging)
    found = connected_components(first, staging)
    # Clusters of several blocks that are not one component yet: what is outside of the largest one meets all blocks.
    apart = several.join(found.withColumnRenamed("label", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = apart.groupBy("label", "component").agg(F.count("*").alias("n"))
    largest = counted.groupBy("label").agg(F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n")).where("components > 1")
    largest = largest.select("label", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / config.block).cast("int").alias("rests"))
    if largest.isEmpty():
        staging.drop(member)
        return found
    apart = apart.join(largest, "label").withColumn("rest", F.pmod(F.xxhash64("node", zero), F.col("rests")).cast("int"))
    own = _place(F.col("rests"), lambda r: at(r, F.col("part")))
    places = F.when(F.col("component") == F.col("main"), own).otherwise(F.concat(own, _place(F.col("parts"), lambda p: at(F.col("rest"), p))))
    more = _links(apart.withColumn("places", places), docs, config, id_col, text_col, staging)
    out = connected_components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), staging)
    staging.drop(member, found)
    return out


def _judged(docs: DataFrame, config: MinMaxConfig, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, stays) of every row, written: `stays` for the rows of empty sets and null ids, and
    for that (id, text) of each component which sorts first."""
    staging = Staging(docs.sparkSession)
    rows = staging.write(sketches(docs, config, id_col, text_col))
    whole = rows.where("n_shingles > 0 and id is not null")
    classes = staging.write(
        whole.groupBy("h1", "h2").agg(F.min(F.struct("id", "text_hash")).alias("rep"), *(F.any_value(c).alias(c) for c in ("n_shingles", "keys", "marks")))
        .withColumn("node", F.monotonically_increasing_id())
    )
    clusters = connected_components(candidates(classes, config, staging), staging)
    member = classes.select("node", "rep", "h1", "h2", "n_shingles").join(clusters, "node")
    final = confirmed_components(member, docs, config, id_col, text_col, staging)
    rooted = classes.select("h1", "h2", "rep", "node").join(final, "node", "left").withColumn("root", F.coalesce("label", "node"))
    n = rows.count()
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("chosen"))
    named = join_hot(rooted, n, smallest, "root", F.col("h1")).select("h1", "h2", "chosen")
    alone = rows.where("n_shingles = 0 or id is null").select("id", "text_hash", "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("stays"))
    grouped = join_hot(whole.select("id", "text_hash", "n_shingles", "h1", "h2"), n, named, ["h1", "h2"], F.col("id")).select(
        "id", "text_hash", "n_shingles", F.col("chosen.id").alias("component_id"), (F.struct("id", "text_hash") == F.col("chosen")).alias("stays")
    )
    out = staging.write(alone.union(grouped))
    staging.drop(rows, classes, clusters, final)
    return out


def near_duplicates(docs: DataFrame, config: MinMaxConfig = MinMaxConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id and kept (the id is the smallest of its component).

    Words are runs of anything but blanks, A-Z lower-cased; a document's set are its distinct
    shingles; fewer words than a shingle make one shingle.  Defined cases: null, empty and blank
    texts have an empty set and link with nothing; a null id is never linked, its component is
    null and it is kept; rows that repeat an id are documents of their own, each in the component of its own
    text; a text of any length has its whole set, and two sets of a link must fit in a task; other columns are
    ignored; an empty table gives no rows.
    """
    judged = _judged(docs, config, id_col, text_col)
    return judged.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, config: MinMaxConfig = MinMaxConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near_duplicates(), that of the smallest id, with all its columns.

    Rows are dropped by id and text, so that of two rows of an id only the one that is a copy goes.  Defined
    cases: rows of null ids and of texts without a word stay, but of rows that repeat id and text one stays; extra
    columns may have any name that does not begin with quillstream_; an empty table gives no rows.
    """
    staging, by = Staging(docs.sparkSession), ["quillstream_id", "quillstream_text"]
    judged = _judged(docs, config, id_col, text_col).withColumnsRenamed({"id": "quillstream_id", "text_hash": "quillstream_text"})
    named = docs.withColumn(by[0], F.col(id_col).cast("long")).withColumn(by[1], F.xxhash64(F.col(text_col).cast("string")))
    dropped = judged.where("not stays").select(*by, F.lit(False).alias("quillstream_once"))
    repeated = judged.where("stays and quillstream_id is not null").groupBy(by).count().where("count > 1").select(*by, F.lit(True).alias("quillstream_once"))
    told = staging.write(dropped.distinct().union(repeated))
    # Rows of which nothing is told are not moved.
    bits = BitFilter(staging, told, *by)
    kept = bits.rows(named, *by, found=False)
    asked = bits.rows(named, *by).join(told, by, "left")
    kept = kept.unionByName(asked.where("quillstream_once is null").drop("quillstream_once"))
    if not repeated.isEmpty():
        kept = kept.unionByName(asked.where("quillstream_once").drop("quillstream_once").dropDuplicates(by))
    return kept.select(docs.columns)
