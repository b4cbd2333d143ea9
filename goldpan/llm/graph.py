"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node each node with an edge can reach, itself included.

    Edges are undirected; repeated ones, loops and rows with a null end do nothing. Every round
    is checkpointed in the shared folder, so a lost executor costs one round at most, and only a
    row count and a checksum reach the driver. Minima are pre-aggregated before each shuffle, and
    the joins have the plain edge table on their large side, which Spark can split at a hot node.
    """
    shared_dir(edges.sparkSession)  # sets the folder of checkpoints
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = now.checkpoint()
    before, after = None, _signature(now)
    while before != after:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = low.select("a", F.col("m").alias("b")).unionAll(moved).distinct().checkpoint()
        before, after = after, _signature(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
