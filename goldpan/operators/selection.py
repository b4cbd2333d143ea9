"""Choosing a run or a checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _best(runs: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Arg-max as an aggregate: every task keeps one row, nothing is sorted."""
    row = F.struct(*runs.columns)
    return runs.groupBy(*keys).agg(F.max_by(row, order).alias("_best")).select("_best.*")


def best_greedy_run(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Most correct, then most executable, then earliest."""
    return _best(
        runs, keys, F.struct("correct_count", "executable_rate", (-F.col("step")).alias("early"))
    )


def best_vote_run(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """As ``best_greedy_run`` on the vote, with the greedy count as a further key."""
    return _best(
        runs,
        keys,
        F.struct(
            "correct_count", "executable_rate", "greedy_correct", (-F.col("step")).alias("early")
        ),
    )


def checkpoints_by_step(paths: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First path per step; a final checkpoint never replaces a numbered one."""
    return paths.groupBy(*keys, "step").agg(
        F.min_by("path", F.struct("is_final", "path")).alias("path")
    )


def latest_checkpoint(paths: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return paths.groupBy(*keys).agg(
        F.max("step").alias("step"), F.max_by("path", F.struct("step", "path")).alias("path")
    )


def best_so_far(log: DataFrame, keys: Sequence[str], order: str, loss: str = "loss") -> DataFrame:
    """Mark evaluations that beat every earlier one of the same run.

    A run's evaluation log has one row per evaluation, so the window is short.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(loss).over(before)
    return log.withColumn("is_best", best.isNull() | (F.col(loss) < best))
