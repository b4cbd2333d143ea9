"""Sharding, resuming and seeding of long batches."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .ranks import with_position


def stride_shard(df: DataFrame, workers: int, index: str = "source_index") -> DataFrame:
    """Add the worker (``shard``) and its own counter; rows r, r + w, ... go to worker r."""
    return df.withColumn("shard", F.pmod(F.col(index), F.lit(workers))).withColumn(
        "shard_position", F.expr(f"`{index}` div {workers}")
    )


def merge_issues(expected: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Ids that are missing from, repeated in, or unknown to a merged result."""
    counts = merged.groupBy(key).agg(F.count("*").alias("rows"))
    return (
        expected.select(key, F.lit(1).alias("_known"))
        .join(counts, key, "full_outer")
        .select(
            key,
            F.when(F.col("rows").isNull(), "missing")
            .when(F.col("_known").isNull(), "unexpected")
            .when(F.col("rows") > 1, "duplicate")
            .alias("issue"),
        )
        .where(F.col("issue").isNotNull())
    )


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows still to process."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def prefix_violations(todo: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """Rows skipped before the last finished one: finished work must be a prefix."""
    ids = done.select(key).distinct()
    finished = todo.join(ids, key, "left_semi")
    last = finished.agg(F.max(order).alias("_last")).scalar()
    return todo.where(F.col(order) <= last).join(ids, key, "left_anti")


def prefix_gaps(todo: DataFrame, done: DataFrame, position: str) -> DataFrame:
    """``prefix_violations`` of work that is known by an integer position, as (position).

    Both sides shrink to bitmaps of 32,768 positions before the shuffle, so neither is joined row
    by row. Null positions are no work; repeated ones count once.
    """
    tagged = todo.select(F.col(position).alias("id"), F.lit(True).alias("_todo")).unionByName(
        done.select(F.col(position).alias("id"), F.lit(False).alias("_todo"))
    )
    words = bitmaps.words(
        bitmaps.build(tagged, "id", {"todo": F.col("_todo"), "done": ~F.col("_todo")}), ["todo", "done"]
    )
    met = bitmaps.ids(F.col("todo").bitwiseAND(F.col("done")))
    last = words.agg(F.max(F.array_max(met))).scalar()
    open_ = bitmaps.ids(F.col("todo").bitwiseAND(F.bitwise_not("done")))
    return words.select(F.explode(open_).alias(position)).where(F.col(position) <= last)


# --- a seeded order without a sort --------------------------------------------------------------

#: Rounds of the permutation; the prime below which its digests are taken.
ROUNDS = 6
PRIME = 2**31 - 1


def permutation_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below ``PRIME`` for each round."""
    draw = random.Random(seed)
    return [(draw.randrange(1, PRIME), draw.randrange(PRIME), draw.randrange(PRIME)) for _ in range(ROUNDS)]


def box(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square that holds 0..n-1."""
    a = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def _scrambled(x: int, n: int, seed: int) -> int:
    a, b = box(n)
    sides, parts = (a, b), [x % a, x // a]
    for turn, (k1, k2, k3) in enumerate(permutation_keys(seed)):
        h = (parts[1 - turn % 2] * k1 + k2) % PRIME
        parts[turn % 2] = (parts[turn % 2] + (h * h + k3) % PRIME) % sides[turn % 2]
    return parts[1] * a + parts[0]


def permuted(df: DataFrame, index: str, n: int, seed: int, name: str = "position") -> DataFrame:
    """Add the place of ``index`` (0..n-1) in a permutation of 0..n-1 that ``seed`` fixes.

    The numbers below a * b, the smallest near-square that holds n, are pairs of a left and a right
    part. Each round adds a digest of one part to the other, which can be undone and so loses no
    number. A result of n or more is put in again until it is below n; there are fewer than
    sqrt(n) + 1 such numbers, whose ends are worked out beforehand and joined as a small table.
    ``df`` has no columns _l, _r and _h.
    """
    a, b = box(n)
    out = df.withColumns({"_l": F.col(index) % a, "_r": F.expr(f"`{index}` div {a}")})
    for turn, (k1, k2, k3) in enumerate(permutation_keys(seed)):
        moved, other, side = ("_l", "_r", a) if turn % 2 == 0 else ("_r", "_l", b)
        out = out.withColumn("_h", (F.col(other).cast("bigint") * k1 + k2) % PRIME)
        out = out.withColumn(moved, (F.col(moved) + (F.col("_h") * F.col("_h") + k3) % PRIME) % side)
    ends = []
    for start in range(n, a * b):
        x = _scrambled(start, n, seed)
        while x >= n and x != start:
            x = _scrambled(x, n, seed)
        if x < n:  # else nothing below n leads here
            ends.append((start, x))
    small = df.sparkSession.createDataFrame(ends, "_x bigint, _end bigint")
    out = out.withColumn("_x", (F.col("_r") * a + F.col("_l")).cast("bigint"))
    return out.join(F.broadcast(small), "_x", "left").withColumn(name, F.coalesce("_end", "_x")).drop(
        "_l", "_r", "_h", "_x", "_end"
    )


def seeded_order(ids: DataFrame, key: str, seed: int, world: int = 1) -> DataFrame:
    """Deterministic shuffle of unique integer ids: position, id, and the repeated last row that
    evens a batch.

    Contiguous ids are placed row by row, without a sort; others are numbered in order first. The
    contract is determinism, not one permutation.
    """
    low, high, n = ids.agg(F.min(key), F.max(key), F.count("*")).first()
    if n and high - low + 1 == n:
        indexed = ids.select(key, (F.col(key) - F.lit(low)).alias("_index"))
    else:
        indexed = with_position(ids.select(key), F.col(key), name="_index")
    placed = permuted(indexed, "_index", n, seed).select("position", key)
    again = F.array(F.lit(False), F.lit(True)) if n % world else F.array(F.lit(False))
    copies = F.when(F.col("position") == n - 1, again).otherwise(F.array(F.lit(False)))
    return placed.withColumn("repeated", F.explode(copies)).withColumn(
        "position", F.col("position") + F.col("repeated").cast("bigint")
    )


def pair_assignment(ordered: DataFrame, world: int, position: str = "position") -> DataFrame:
    """Record = cursor * world + rank."""
    return ordered.withColumns(
        {
            "cursor": F.expr(f"`{position}` div {world}"),
            "rank": F.pmod(F.col(position), F.lit(world)),
        }
    )


def sample_cap(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First ``n`` rows in order; Spark keeps n rows per task."""
    return df.orderBy(*order).limit(n)


def before_checkpoint(
    log: DataFrame, saved: DataFrame, keys: Sequence[str], cursor: str, saved_cursor: str
) -> DataFrame:
    """Log rows that a saved state has already seen."""
    return (
        log.join(saved, list(keys))
        .where(F.col(cursor) < F.col(saved_cursor))
        .drop(saved_cursor)
    )
