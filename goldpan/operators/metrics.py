"""Accuracy, transition, latency and loss reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percentage
from .ranks import values_at

DIFFICULTIES = ["simple", "moderate", "challenging"]


def _ex(where: Column | None = None) -> Column:
    correct = F.col("official_ex") == 1
    if where is None:
        return percentage(F.count_if(correct), F.count("*"))
    return percentage(F.count_if(correct & where), F.count_if(where))


def evaluation_metrics(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Overall and per-difficulty accuracy, executable and compliance rates, error counts."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("total"),
        _ex().alias("overall_ex"),
        *[_ex(F.col("difficulty") == d).alias(f"{d}_ex") for d in DIFFICULTIES],
        percentage(F.count_if(F.col("status") == "success"), F.count("*")).alias("executable_rate"),
        percentage(F.count_if("format_compliance"), F.count("*")).alias("format_compliance_rate"),
        F.count_if(F.col("status") == "timeout").alias("timeout_count"),
        *[
            F.count_if(F.col("error_type") == e).alias(f"{e}_count")
            for e in ("syntax_error", "missing_table", "missing_column")
        ],
    )


def system_metrics(scored: DataFrame) -> DataFrame:
    """Per system, overall (difficulty 'all') and by difficulty, in one rollup."""
    level = F.when(F.grouping("difficulty") == 1, F.lit("all")).otherwise(F.col("difficulty"))
    return (
        scored.rollup("system", "difficulty")
        .agg(
            F.grouping("system").alias("_total"),
            level.alias("level"),
            F.count("*").alias("sample_count"),
            F.sum("official_ex").cast("bigint").alias("correct_count"),
            _ex().alias("official_ex"),
            percentage(F.count_if(F.col("status") == "success"), F.count("*")).alias(
                "executable_rate"
            ),
            percentage(F.count_if("format_compliance"), F.count("*")).alias(
                "format_compliance_rate"
            ),
            F.count_if(F.col("gold_status") != "success").alias("gold_failure_count"),
        )
        .where(F.col("_total") == 0)
        .drop("_total", "difficulty")
        .withColumnRenamed("level", "difficulty")
    )


def validation_metrics(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("sample_count"),
        _ex().alias("official_ex"),
        percentage(F.count_if(F.col("status") == "success"), F.count("*")).alias("executable_rate"),
        percentage(F.count_if("format_compliance"), F.count("*")).alias("format_compliance_rate"),
        F.count_if(F.col("gold_status") != "success").alias("gold_failure_count"),
        F.count_if(F.col("status") == "timeout").alias("prediction_timeout_count"),
    )


def transitions(rows: DataFrame, first: str, second: str, keys: Sequence[str]) -> DataFrame:
    """How answers change between two systems that scored the same samples, from the rows
    (system, keys, official_ex) of both: a sample's two answers meet in one grouping. Samples that
    one system has not scored are left out; a system scores a sample once."""
    pairs = rows.where(F.col("system").isin(first, second)).groupBy(*keys).agg(
        F.max(F.when(F.col("system") == first, F.col("official_ex"))).alias("_a"),
        F.max(F.when(F.col("system") == second, F.col("official_ex"))).alias("_b"),
    )
    gain = F.sum("_b") - F.sum("_a")
    return pairs.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).agg(
        F.count("*").alias("sample_count"),
        F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("wrong_to_right"),
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("right_to_wrong"),
        gain.cast("bigint").alias("correct_gain"),
        F.round(
            percentage(F.sum("_b"), F.count("*")) - percentage(F.sum("_a"), F.count("*")), 2
        ).alias("ex_gain_points"),
    )


def compact_metrics(runs: DataFrame) -> DataFrame:
    """Fill a missing correct count from the rate and round the rates."""
    derived = F.bround(F.col("official_ex") * F.col("sample_count") / 100.0, 0).cast("bigint")
    return runs.withColumn("correct_count", F.coalesce("correct_count", derived)).withColumns(
        {c: F.round(c, 2) for c in ("official_ex", "executable_rate")}
    )


def stage_gains(stages: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Gain of each stage over the one before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    return stages.withColumns(
        {
            "correct_gain": F.col("correct_count") - F.lag("correct_count").over(w),
            "ex_gain_points": F.round(F.col("official_ex") - F.lag("official_ex").over(w), 2),
        }
    )


def latency_report(requests: DataFrame, elapsed_seconds: float) -> DataFrame:
    """Counts, throughput, latency percentiles and mean stage times of the successes."""
    ok = F.col("status") == "success"
    base = requests.agg(
        F.count("*").alias("request_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("error_count"),
        F.round(F.count("*") / F.lit(elapsed_seconds), 6).alias("qps"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("generation_ms"))), F.lit(0.0)), 6).alias(
            "mean_generation_ms"
        ),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("execution_ms"))), F.lit(0.0)), 6).alias(
            "mean_execution_ms"
        ),
    )
    picked = values_at(requests, "total_ms", (50, 95, 99)).select(F.struct("*")).scalar()
    return base.withColumns(
        {
            f"latency_p{p}_ms": F.coalesce(picked[f"p{p}"], F.lit(0.0))
            for p in (50, 95, 99)
        }
    )


def request_rollup(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per request: stage time, output tokens, candidate and executable counts."""
    return candidates.groupBy(*keys).agg(
        F.count("*").alias("candidate_count"),
        F.count_if(F.col("status") == "success").alias("executable_count"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("output_tokens"),
        F.round(F.sum("elapsed_ms"), 3).alias("execution_ms"),
    )


def weighted_loss(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Token-weighted mean loss and its perplexity."""
    tokens = F.sum("supervised_tokens")
    loss = F.sum(F.col("loss") * F.col("supervised_tokens")) / tokens
    return log.groupBy(*keys).agg(
        tokens.alias("supervised_tokens"),
        F.round(loss, 8).alias("validation_loss"),
        F.round(F.exp(loss), 6).alias("perplexity"),
    )


def training_windows(log: DataFrame, keys: Sequence[str], every: int) -> DataFrame:
    """Token-weighted loss and input-token rate for every ``every`` steps."""
    tokens = F.sum("supervised_tokens")
    window = F.floor((F.col("step") - 1) / every).cast("bigint")
    return (
        log.groupBy(*keys, window.alias("window"))
        .agg(
            F.max("step").alias("global_step"),
            F.round(F.sum(F.col("loss") * F.col("supervised_tokens")) / tokens, 8).alias(
                "train_loss"
            ),
            tokens.alias("supervised_tokens"),
            F.round(F.sum("input_tokens") / F.sum("elapsed_seconds"), 6).alias("tokens_per_second"),
        )
        .where(F.col("supervised_tokens") > 0)
    )


def merged_log(shards: Sequence[DataFrame], *order: str) -> DataFrame:
    merged = shards[0]
    for shard in shards[1:]:
        merged = merged.unionByName(shard)
    return merged.orderBy(*order)
