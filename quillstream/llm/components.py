"""Connected components of an edge table, as joins and aggregates over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, Staging, join_hot


def connected_components(edges: DataFrame, staging: Staging, a: str = "a", b: str = "b", hot: int = HOT) -> DataFrame:
    """(node, label) for every node of an edge, label being the smallest node reachable.

    Each round hangs every node on its smallest neighbour, if that is smaller, follows the chains to their roots by
    doubling, and puts roots for nodes in the edges; edges inside a tree fall away, so that a round has few of the
    edges of the one before.  Nothing but counts reaches the driver.  A node of very many edges, and a label
    of very many nodes, are dealt out (join_hot).  An edge with a null end is ignored; a loop makes its node a
    component of its own; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    pairs = staging.write(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    node = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    labels, n_nodes = None, 0
    left = pairs.where("a < b")
    while n_left := left.count():
        roots = _roots(left, staging, hot)
        if labels is None:
            new = node.join(roots.withColumnRenamed("up", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        else:
            at = roots.select(F.col("node").alias("label"), "up")
            new = join_hot(labels, n_nodes, at, "label", F.col("node"), "left", hot).select("node", F.coalesce("up", "label").alias("label"))
        new = staging.write(new)
        for end, other in (("a", "b"), ("b", "a")):
            at = roots.select(F.col("node").alias(end), "up")
            left = join_hot(left, n_left, at, end, F.col(other), "left", hot).withColumn(end, F.coalesce("up", end)).select("a", "b")
        left = staging.write(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        staging.drop(roots, *([labels] if labels is not None else []))
        labels, n_nodes = new, n_nodes or new.count()
    if labels is None:
        labels = staging.write(node.select("node", F.col("node").alias("label")))
    staging.drop(pairs)
    return labels


def _roots(edges: DataFrame, staging: Staging, hot: int) -> DataFrame:
    """(node, up) for every node that has a smaller neighbour: the root of its tree, if each such node hangs on the smallest."""
    up = staging.write(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
    n = up.count()
    while True:
        above = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
        new = join_hot(up.select("node", "up"), n, above, "up", F.col("node"), "left", hot)
        new = staging.write(new.select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        staging.drop(up)
        up = new
        if new.where("moved").isEmpty():
            return up
