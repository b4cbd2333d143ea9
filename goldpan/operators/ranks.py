"""Global positions, exact order statistics and bounded picks without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


#: From this rank on Spark no longer limits groups before a window (its default).
GROUP_LIMIT = 1000


def _partition_and_slot(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-sort, number rows inside each partition, and cut the lineage.

    The checkpoint fixes the partitioning, so later passes see the same numbers even if an
    executor is lost. Sampling by the range sort keeps partitions even for repeated keys as
    long as ``order`` is a total order.
    """
    slot = F.monotonically_increasing_id()
    return cut(df.sort(*order).withColumn("_slot", slot))


def _partition_of(slot: Column) -> Column:
    return F.shiftright(slot, 33)


def with_running_total(
    df: DataFrame, order: Sequence[Column], weight: Column | None = None, name: str = "before"
) -> DataFrame:
    """Add the total weight of all rows that sort before each row (exclusive)."""
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    placed = _partition_and_slot(df.withColumn("_weight", weight), order).withColumn(
        "_part", _partition_of(F.col("_slot"))
    )
    # One row per partition: its size does not grow with the data but with the task count.
    totals = placed.groupBy("_part").agg(F.sum("_weight").alias("_total"))
    offsets = totals.select(
        "_part",
        (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_offset"),
    )
    inside = F.sum("_weight").over(Window.partitionBy("_part").orderBy("_slot"))
    return (
        placed.withColumn("_inside", inside - F.col("_weight"))
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_slot", "_weight", "_inside", "_offset")
    )


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the 0-based position in a total order."""
    placed = _partition_and_slot(df, order).withColumn("_part", _partition_of(F.col("_slot")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    offsets = sizes.select(
        "_part",
        (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_offset"),
    )
    local = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_part", "_slot", "_offset")
    )


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank",
    salts: int = 256,
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``; exact, and safe for a hot group.

    A row that is among the first ``n`` of its group is among the first ``n`` of any part
    of it, so groups are split by a hash of the row first and merged at most
    ``salts * n`` rows at a time.
    """
    split = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    parts = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", split)
        .withColumn("_part_rank", F.row_number().over(parts))
        .where(F.col("_part_rank") <= n)
        .drop("_salt", "_part_rank")
        .withColumn(name, F.row_number().over(whole))
        .where(F.col(name) <= n)
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """As ``first_per_group``; for small ``n`` Spark itself limits each group before the shuffle."""
    if n >= GROUP_LIMIT:
        return first_per_group(df, keys, order, n, name)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= n)


def histogram(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows (keys, measure, value, n): one row per distinct value of each measure."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("measure"), F.col(m).cast("bigint").alias("value"))
                for m in measures
            ]
        )
    )
    return (
        df.select(*keys, pairs.alias("_pair"))
        .select(*keys, "_pair.measure", "_pair.value")
        .groupBy(*keys, "measure", "value")
        .agg(F.count("*").alias("n"))
    )


def nearest_rank(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], percentiles: Sequence[int]
) -> DataFrame:
    """Nearest-rank percentiles, minimum, maximum and total of integer measures.

    Works on the histogram, whose size is bounded by the number of distinct lengths, so no
    task ever holds a whole split.
    """
    groups = [*keys, "measure"]
    running = Window.partitionBy(*groups).orderBy("value")
    counts = histogram(df, keys, measures)
    sizes = counts.groupBy(*groups).agg(F.sum("n").alias("_size"))
    ranked = counts.withColumn("_upto", F.sum("n").over(running)).join(sizes, groups)

    def pick(p: int) -> Column:
        rank = F.expr(f"(_size * {p} + 99) div 100")
        return F.min(F.when(F.col("_upto") >= rank, F.col("value"))).alias(f"p{p}")

    return ranked.groupBy(*groups).agg(
        F.max("_size").alias("sample_count"),
        F.min("value").alias("min"),
        *[pick(p) for p in percentiles],
        F.max("value").alias("max"),
        F.sum(F.col("value") * F.col("n")).alias("total"),
    )


def values_at(df: DataFrame, value: str, percentiles: Sequence[int]) -> DataFrame:
    """One row p<percentile>...: the values at index round(p/100 * (n-1)) of the sorted
    column, ties rounded to even. Works on distinct values and their running counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    placed = with_running_total(counts, [F.col(value)], F.col("_n"))
    total = placed.agg(F.sum("_n")).scalar()

    def pick(p: int) -> Column:
        at = F.bround(F.lit(p / 100.0) * (total - 1), 0)
        hit = (at >= F.col("before")) & (at < F.col("before") + F.col("_n"))
        return F.max(F.when(hit, F.col(value))).alias(f"p{p}")

    return placed.agg(*[pick(p) for p in percentiles])
