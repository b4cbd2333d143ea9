"""Token-length statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import nearest_rank, top_per_group

# Must equal the reference for matching results.
PERCENTILES = [50, 90, 95, 99]
MAX_LENGTHS = [4096, 8192, 12288, 16384]


def word_count(text: Column) -> Column:
    """Default token counter: runs of letters and digits."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).cast("bigint")


def token_counts(
    records: DataFrame, prompt: Column, completion: Column,
    counter: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """Add prompt, completion and total counts; ``counter`` may be a pandas UDF."""
    return records.withColumn("prompt_tokens", counter(prompt)).withColumn(
        "completion_tokens", counter(completion)
    ).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def length_distribution(
    lengths: DataFrame, keys: Sequence[str] = ("split",),
    measures: Sequence[str] = ("prompt_tokens", "completion_tokens", "total_tokens"),
) -> DataFrame:
    return nearest_rank(lengths, keys, measures, PERCENTILES)


def split_statistics(
    lengths: DataFrame, keys: Sequence[str] = ("split",), limits: Sequence[int] = MAX_LENGTHS
) -> DataFrame:
    """Length distribution per measure plus the counts of over-long records."""
    over = lengths.groupBy(*keys).agg(
        *[F.count_if(F.col("total_tokens") > n).alias(f"over_{n}") for n in limits]
    )
    return length_distribution(lengths, keys).drop("min", "total").join(over, list(keys))


def longest(lengths: DataFrame, keys: Sequence[str] = ("split",), n: int = 10) -> DataFrame:
    """The ``n`` longest records per split, input order breaking ties."""
    return top_per_group(
        lengths, keys, [F.col("total_tokens").desc(), F.col("source_index")], n
    )


def truncation(
    lengths: DataFrame, limits: Sequence[int], keys: Sequence[str] = ("split",)
) -> DataFrame:
    """What keeping only the first L tokens would lose, for every L in ``limits``.

    Records are first reduced to distinct (prompt, completion) length pairs, so the fan-out
    over ``limits`` happens on that histogram and not on the records.
    """
    pairs = lengths.groupBy(*keys, "prompt_tokens", "completion_tokens").agg(
        F.count("*").alias("_n")
    )
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    kept = F.least(
        F.greatest(F.lit(0), F.least(total, F.col("max_length")) - F.col("prompt_tokens")),
        F.col("completion_tokens"),
    )
    spread = pairs.withColumn(
        "max_length", F.explode(F.array(*[F.lit(n).cast("bigint") for n in limits]))
    ).withColumn("_kept", kept)

    def count(where: Column) -> Column:
        return F.sum(F.when(where, F.col("_n")).otherwise(0))

    retained = F.sum(F.col("_kept") * F.col("_n"))
    return spread.groupBy("max_length", *keys).agg(
        count(total > F.col("max_length")).alias("truncated_sample_count"),
        count(F.col("prompt_tokens") > F.col("max_length")).alias("prompt_truncated_count"),
        count(F.col("_kept") < F.col("completion_tokens")).alias("completion_truncated_count"),
        count(F.col("_kept") == 0).alias("zero_supervised_token_count"),
        retained.alias("retained_supervised_tokens"),
        F.round(retained / F.sum(F.col("completion_tokens") * F.col("_n")), 6).alias(
            "retained_supervised_token_rate"
        ),
    )


def retained_distribution(
    lengths: DataFrame, limits: Sequence[int], keys: Sequence[str] = ("split",)
) -> DataFrame:
    """Distribution of the supervised tokens kept at each limit."""
    kept = [
        F.least(
            F.greatest(
                F.lit(0),
                F.least(F.col("total_tokens"), F.lit(n)) - F.col("prompt_tokens"),
            ),
            F.col("completion_tokens"),
        ).alias(str(n))
        for n in limits
    ]
    wide = lengths.select(*keys, *kept)
    return nearest_rank(wide, keys, [str(n) for n in limits], PERCENTILES)


def minimum_safe_length(report: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per risk metric: the smallest length at which every split is free of it."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("risk")) for m in metrics])
    )
    risks = report.select("max_length", cells.alias("_c")).select("max_length", "_c.*")
    worst = risks.groupBy("metric", "max_length").agg(F.max("risk").alias("risk"))
    return worst.groupBy("metric").agg(
        F.min(F.when(F.col("risk") == 0, F.col("max_length"))).alias("minimum_safe_length")
    )


def longest_record(lengths: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Count and longest record per split; the first one wins a tie."""
    order = F.struct("total_tokens", (-F.col("source_index")).alias("first"))
    return lengths.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        F.max_by("sample_id", order).alias("longest_sample_id"),
        F.max("total_tokens").alias("max_sequence_length"),
        F.max_by("completion_tokens", order).alias("longest_sample_supervised_tokens"),
    )


def within_context(
    lengths: DataFrame, context: int, new_tokens: int
) -> tuple[DataFrame, DataFrame]:
    """Split records into those that fit the context and those that do not."""
    fits = F.col("prompt_tokens") + new_tokens <= context
    return lengths.where(fits), lengths.where(~fits)


def monotonic_violations(distribution: DataFrame) -> DataFrame:
    """Distributions whose percentiles are negative or decrease."""
    points = F.array(*[F.col(f"p{p}") for p in PERCENTILES], F.col("max"))
    return distribution.where((F.array_sort(points) != points) | (F.array_min(points) < 0))


def padding_statistics(
    rows: DataFrame, batch: Column, length: str, prompt: str, supervised: str
) -> DataFrame:
    """Per batch: padded length and sequence, prompt, supervised and masked totals."""
    padded = F.max(length)
    return rows.groupBy(batch.alias("batch")).agg(
        F.count("*").alias("batch_size"),
        padded.cast("bigint").alias("padded_length"),
        F.sum(length).cast("bigint").alias("sequence_tokens"),
        F.sum(prompt).cast("bigint").alias("prompt_tokens"),
        F.sum(supervised).cast("bigint").alias("supervised_tokens"),
        (padded * F.count("*") - F.sum(F.col(length) - F.col(prompt))).cast("bigint").alias(
            "masked_tokens"
        ),
    )
