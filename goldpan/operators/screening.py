"""Which prompts carry a training signal: group outcomes, buckets and advantages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percentage

VARIANCE_TOLERANCE = 1e-12
ADVANTAGE_EPSILON = 1e-4


def _gold_reason() -> Column:
    return F.when(F.col("gold_status") != "success", F.concat(F.lit("gold_"), "gold_status")).when(
        F.col("gold_empty"), F.lit("empty_gold_result")
    )


def screen_prompts(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per prompt with pass counts, score range and the reason it is kept.

    Needs gold_status, gold_empty, truncated, official_ex and screening_score.
    """
    valid = ~F.col("truncated")
    score = F.when(valid, F.col("screening_score"))
    grouped = scored.groupBy(*keys).agg(
        F.max(_gold_reason()).alias("exclusion_reason"),
        F.count_if(valid).alias("valid_candidate_count"),
        F.count_if(~valid).alias("truncated_candidate_count"),
        F.count_if(valid & (F.col("official_ex") == 1)).alias("_exact"),
        F.min(score).alias("_low"),
        F.max(score).alias("_high"),
    )
    scorable = F.col("exclusion_reason").isNull()
    exact, n = F.col("_exact"), F.col("valid_candidate_count")
    spread = F.col("_high") - F.col("_low") > VARIANCE_TOLERANCE
    reason = (
        F.when(~scorable, F.lit(None).cast("string"))
        .when((exact > 0) & (exact < n), "exact_mixed")
        .when((exact == 0) & (n >= 2) & spread, "zero_exact_partial_variance")
    )
    return grouped.select(
        *keys,
        scorable.alias("scorable"),
        "exclusion_reason",
        "valid_candidate_count",
        "truncated_candidate_count",
        F.when(scorable, exact).otherwise(F.lit(0)).cast("bigint").alias("exact_pass_count"),
        F.when(scorable, F.col("_low")).alias("screening_score_min"),
        F.when(scorable, F.col("_high")).alias("screening_score_max"),
        reason.alias("selection_reason"),
    )


def pass_buckets(scored: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Prompts per pass count, 0..size, empty buckets included."""
    passes = scored.groupBy(*keys).agg(F.sum("official_ex").alias("pass_count"))
    counted = passes.groupBy("pass_count").agg(F.count("*").alias("prompts"))
    spark = scored.sparkSession
    return (
        spark.range(size + 1)
        .select(F.col("id").alias("pass_count"))
        .join(counted, "pass_count", "full_outer")
        .select("pass_count", F.coalesce("prompts", F.lit(0)).cast("bigint").alias("prompts"))
    )


def mixed_prompts(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prompts that neither always pass nor always fail."""
    return (
        scored.groupBy(*keys)
        .agg(F.sum("official_ex").alias("pass_count"), F.count("*").alias("candidate_count"))
        .where((F.col("pass_count") > 0) & (F.col("pass_count") < F.col("candidate_count")))
    )


#: Metrics of the summary that stand there without any row too.
PROMPT_TOTALS = [
    "eligible_prompt_count", "scorable_prompt_count", "unscorable_prompt_count", "valid_candidate_count",
    "truncated_candidate_count", "selected_prompt_count", "selection_rate",
]
CANDIDATE_TOTALS = ["generated_candidate_count", "format_compliance_rate"]


def screening_summary(scored: DataFrame, screened: DataFrame) -> DataFrame:
    """Long report (metric, key, value): counts, rates and buckets.

    Every row names the cells it adds to; prompts and candidates are read once each and summed
    inside the tasks.
    """
    selected = F.col("selection_reason").isNotNull()
    judged = ~F.col("truncated") & _gold_reason().isNull()

    def cell(metric: str, amount: Column, key: Column | None = None, when: Column | None = None) -> Column:
        made = F.struct(
            F.lit(metric).alias("metric"), (F.lit("") if key is None else key.cast("string")).alias("key"),
            F.coalesce(amount.cast("double"), F.lit(0.0)).alias("amount"), F.lit(1).alias("rows"),
        )
        return made if when is None else F.when(when, made)

    one = F.lit(1)
    of_prompt = [
        cell("eligible_prompt_count", one),
        cell("scorable_prompt_count", F.col("scorable").cast("int")),
        cell("unscorable_prompt_count", (~F.col("scorable")).cast("int")),
        cell("valid_candidate_count", F.col("valid_candidate_count")),
        cell("truncated_candidate_count", F.col("truncated_candidate_count")),
        cell("selected_prompt_count", selected.cast("int")),
        cell("selection_rate", selected.cast("int")),
        cell("selection_reason", one, F.col("selection_reason"), selected),
        cell("gold_exclusion_reason", one, F.col("exclusion_reason"), ~F.col("scorable")),
        cell("exact_pass_count", one, F.col("exact_pass_count"), F.col("scorable")),
        cell("valid_candidate_count", one, F.col("valid_candidate_count"), F.col("scorable")),
    ]
    of_candidate = [
        cell("generated_candidate_count", one),
        cell("format_compliance_rate", F.col("format_compliance").cast("int")),
        cell("extraction_status", one, F.col("extraction_status")),
        cell("execution_status", one, F.col("status"), judged),
    ]

    def cells(frame: DataFrame, made: list[Column]) -> DataFrame:
        return frame.select(F.inline(F.filter(F.array(*made), lambda c: c.isNotNull())))

    zeros = scored.sparkSession.createDataFrame(
        [(m, "", 0.0, 0) for m in PROMPT_TOTALS + CANDIDATE_TOTALS], "metric string, key string, amount double, rows int"
    )
    sums = (
        cells(screened, of_prompt).unionByName(cells(scored, of_candidate)).unionByName(zeros)
        .groupBy("metric", "key").agg(F.sum("amount").alias("amount"), F.sum("rows").alias("rows"))
    )
    rate = F.endswith("metric", F.lit("_rate")) & (F.col("key") == "")
    return sums.select(
        "metric", "key",
        F.when(rate, percentage(F.col("amount"), F.col("rows"))).otherwise(F.col("amount")).alias("value"),
    )


def selected_records(screened: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Train records whose prompt was kept."""
    kept = screened.where(F.col("selection_reason").isNotNull())
    return records.join(kept.select(*keys, "selection_reason", "exact_pass_count"), list(keys))


def group_type(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """insufficient_valid / all_wrong / all_correct / mixed per prompt."""
    valid = ~F.col("truncated")
    counts = scored.groupBy(*keys).agg(
        F.count("*").alias("candidate_count"),
        F.count_if(valid).alias("valid_count"),
        F.count_if(valid & (F.col("official_ex") == 1)).alias("exact_count"),
        F.count_if("truncated").alias("truncated_count"),
    )
    kind = (
        F.when(F.col("valid_count") < 2, "insufficient_valid")
        .when(F.col("exact_count") == 0, "all_wrong")
        .when(F.col("exact_count") == F.col("valid_count"), "all_correct")
        .otherwise("mixed")
    )
    return counts.withColumn("group_type", kind)


def group_advantage(
    rewards: DataFrame,
    keys: Sequence[str],
    reward: str = "reward",
    epsilon: float = ADVANTAGE_EPSILON,
) -> DataFrame:
    """(reward - group mean) / (group sample deviation + epsilon); groups of one are dropped.

    Group moments are joined back rather than windowed: the moments reduce before the
    shuffle and an adaptive join can split a hot group.
    """
    value = F.col(reward).cast("double")
    moments = (
        rewards.groupBy(*keys)
        .agg(
            F.avg(value).alias("_mean"),
            F.stddev_samp(value).alias("_deviation"),
            F.count("*").alias("_n"),
        )
        .where(F.col("_n") >= 2)
    )
    return (
        rewards.join(moments, list(keys))
        .withColumn("advantage", (value - F.col("_mean")) / (F.col("_deviation") + epsilon))
        .drop("_mean", "_deviation", "_n")
    )


def valid_group_advantage(
    scored: DataFrame, keys: Sequence[str], epsilon: float = ADVANTAGE_EPSILON
) -> DataFrame:
    """Advantages over the valid candidates of mixed groups; 0 everywhere else."""
    valid = ~F.col("truncated")
    reward = F.when(valid, F.col("official_ex").cast("double"))
    stats = scored.groupBy(*keys).agg(
        F.count_if(valid).alias("_valid"),
        F.sum(reward).alias("_exact"),
        F.avg(reward).alias("_mean"),
        F.stddev_samp(reward).alias("_deviation"),
    )
    mixed = (F.col("_valid") >= 2) & (F.col("_exact") > 0) & (F.col("_exact") < F.col("_valid"))
    value = (reward - F.col("_mean")) / (F.col("_deviation") + epsilon)
    return (
        scored.join(stats, list(keys))
        .withColumn("advantage", F.when(mixed & valid, value).otherwise(F.lit(0.0)))
        .drop("_valid", "_exact", "_mean", "_deviation")
    )


def signal_accounting(groups: DataFrame, pair: Column, world: int) -> DataFrame:
    """Signal-free groups, skipped pairs and completions over a whole run.

    A pair of groups shares one update; it is skipped when no group of it has a signal.
    """
    signal = (F.col("group_type") == "mixed").cast("int")
    pairs = groups.groupBy(pair.alias("pair")).agg(
        F.sum(1 - signal).alias("zero"),
        F.max(signal).alias("any_signal"),
        F.sum("candidate_count").alias("completions"),
        F.sum("truncated_count").alias("truncated"),
    )
    zero = F.sum("zero")
    return pairs.agg(
        F.count("*").alias("processed_pairs"),
        zero.alias("zero_signal_groups"),
        percentage(zero, F.count("*") * world).alias("zero_signal_rate"),
        F.count_if(F.col("any_signal") == 0).alias("skipped_pairs"),
        F.sum("completions").alias("completions"),
        F.sum("truncated").alias("truncated_completions"),
    )


def group_counters(groups: DataFrame) -> DataFrame:
    """One row: processed groups by type and truncated completions."""
    kinds = ["mixed", "all_wrong", "all_correct", "insufficient_valid"]
    return groups.agg(
        F.count("*").alias("processed"),
        *[F.count_if(F.col("group_type") == k).alias(k) for k in kinds],
        F.sum("truncated_count").alias("truncated"),
    )
