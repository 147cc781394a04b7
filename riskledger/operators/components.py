"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Edges that a task of a round takes, some 1 MB.
EDGES = 50_000


def _tasks(edges: DataFrame, n: int) -> int:
    """Tasks for ``n`` edges: one per ``EDGES``, one per core at least."""
    return max(edges.sparkSession.sparkContext.defaultParallelism, -(-n // EDGES))


def connected(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges``: columns a, b (long). Returns node, component (the smallest node that can be
    reached), one row per node that has an edge. Each round halves the distances; every round
    is checkpointed, so lost executors cost one round at most. Null ends and loops are ignored. Few
    edges are written by few tasks, whatever the number of shuffle partitions: each task of each shuffle
    of each round leaves files of its own.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = _mark(now)
    while mark[0]:
        few = _tasks(now, mark[0])
        now = now.coalesce(few)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").coalesce(few).distinct().coalesce(few)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b")))
        now = checkpointed(small.where("a > b").coalesce(few).distinct().coalesce(few))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    least = now.groupBy("b").agg(F.lit(1).alias("one")).select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(least)


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a sum over their hashes: equal for equal sets."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))).alias("s")).first()
    return row["n"], row["s"] or 0
