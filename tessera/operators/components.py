"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Every step is a partially aggregated ``min`` per node and a join of the edge list with those minima. The minima are
written out first, so that the join has plain exchanges on both sides and adaptive execution can split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import Workspace, fine_tasks


def _stars(given: DataFrame, work: Workspace) -> DataFrame:
    """given (a, b) with a >= b, distinct -> each node that isn't a root with its root."""
    now, seen = given.where("a <> b"), None
    while not given.isEmpty():  # rounds grow with the logarithm of the longest path; each brings labels nearer, so there is an end
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "large")
        large = work.save(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        least2 = work.save(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        small = large.join(least2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = work.save(small.unionByName(least2.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        work.drop(least, large, least2, *([now] if seen is not None else []))
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if mark == seen:
            break
        seen = mark
    return now


def connected_components(edges: DataFrame, work: Workspace | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """edges (src, dst) of one orderable type -> (node, component), component being the smallest node reachable.

    Edges with a null end are ignored; a self-loop makes its node appear as a component of its own; repeated edges
    count once. A node without any edge has no row. An empty edge list gives an empty table.
    """
    work = work or Workspace(edges.sparkSession, "components")
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    given = work.save(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    with fine_tasks(edges.sparkSession, 2 * given.count()):
        now = _stars(given, work)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    loops = given.where("a = b").select(F.col("a").alias("node")).join(now.select(F.col("a").alias("node")), "node", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.unionByName(loops.select("node", F.col("node").alias("component"))).distinct())
