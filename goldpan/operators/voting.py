"""Choosing one candidate per sample by the result it produced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO_LOGPROB = float("-inf")


def _tier() -> Column:
    """2: returned rows, 1: ran but returned none, 0: did not run."""
    ok = F.col("status") == "success"
    return F.when(ok & ~F.col("empty_result"), 2).when(ok, 1).otherwise(0)


def _clusters(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (sample, tier, result). Plain aggregates, so Spark reduces every
    cluster before the shuffle; a sample holding a third of all candidates is only as
    large as its number of different results."""
    lp = F.col("mean_logprob")
    finite = lp.isNotNull() & ~F.isnan(lp) & (F.abs(lp) < F.lit(float("inf")))
    best = F.struct(
        F.col("is_greedy").cast("int").alias("greedy"),
        F.when(finite, lp).otherwise(F.lit(_NO_LOGPROB)).alias("logprob"),
        (-F.col("candidate_index")).alias("minus_index"),
    )
    size = F.count("*")
    tier = _tier()
    return candidates.groupBy(
        *keys,
        tier.alias("tier"),
        F.when(tier == 2, F.coalesce("result_key", F.lit(""))).otherwise("").alias("cluster"),
    ).agg(
        size.alias("size"),
        F.when(F.count_if(finite) == size, F.round(F.sum(F.when(finite, lp)) / size, 12))
        .otherwise(F.lit(_NO_LOGPROB))
        .alias("logprob"),
        F.min("candidate_index").alias("first_index"),
        F.min(F.when(F.col("is_greedy"), F.col("candidate_index"))).alias("greedy_index"),
        F.max(best).alias("best"),
    )


def _baseline() -> Column:
    """Index of the first greedy candidate, or of the first one when none is greedy."""
    return F.coalesce(F.min("_any_greedy"), F.min("_any_first")).alias("baseline_index")


def result_vote(
    candidates: DataFrame, keys: Sequence[str], minimum_support: int = 2,
    with_baseline: bool = False,
) -> DataFrame:
    """One row per sample: chosen index, support, cluster and executable counts, reason.

    Needs status, empty_result, result_key, mean_logprob, is_greedy, candidate_index.
    Candidates that returned rows vote; when there are none, the ones that ran do. A
    unique largest cluster with enough support wins; otherwise the greedy candidate keeps
    its cluster where it can, and the mean log-probability decides the rest. Mean
    log-probabilities are compared to 12 places so that the summation order of a
    distributed sum cannot change a decision. ``with_baseline`` adds the index of the first
    greedy candidate (of the first candidate when there is none).
    """
    by_size = (
        _clusters(candidates, keys)
        .groupBy(*keys, "tier", "size")
        .agg(
            F.count("*").alias("ties"),
            F.max(
                F.struct(
                    "logprob", (-F.col("first_index")).alias("minus_first"), "best"
                )
            ).alias("leader"),
            F.min(
                F.when(
                    F.col("greedy_index").isNotNull(), F.struct("greedy_index", "size", "best")
                )
            ).alias("greedy"),
            F.min("greedy_index").alias("_any_greedy"),
            F.min("first_index").alias("_any_first"),
        )
    )
    per_tier = by_size.groupBy(*keys, "tier").agg(
        F.max(F.struct("size", "ties", "leader")).alias("top"),
        F.min("greedy").alias("greedy"),
        F.sum("ties").alias("cluster_count"),
        F.sum(F.col("size") * F.col("ties")).alias("members"),
        F.min("_any_greedy").alias("_any_greedy"),
        F.min("_any_first").alias("_any_first"),
    )
    voters = per_tier.groupBy(*keys).agg(
        F.max(F.struct("tier", "top", "greedy", "cluster_count")).alias("v"),
        F.coalesce(F.sum(F.when(F.col("tier") > 0, F.col("members"))), F.lit(0)).alias(
            "executable_count"
        ),
        _baseline(),
    )
    top, greedy = F.col("v.top"), F.col("v.greedy")
    enough = top["size"] >= minimum_support
    reason = (
        F.when(F.col("v.tier") == 0, "no_executable_candidate")
        .when(enough & (top["ties"] == 1), "unique_result_majority")
        .when(enough & (greedy["size"] == top["size"]), "tied_majority_kept_greedy")
        .when(enough, "tied_majority_log_prob")
        .when(greedy.isNotNull(), "kept_greedy_without_majority")
        .otherwise("log_prob_fallback")
    )
    takes_greedy = F.col("reason").isin(
        "tied_majority_kept_greedy", "kept_greedy_without_majority"
    )
    none = F.col("reason") == "no_executable_candidate"
    chosen = F.when(takes_greedy, greedy["best"]).otherwise(top["leader"]["best"])
    support = F.when(takes_greedy, greedy["size"]).otherwise(top["size"])
    # The greedy voter sits in the unique top cluster exactly when that cluster's best
    # member is a greedy candidate and no other cluster holds the first greedy voter.
    outside = greedy.isNull() | (greedy["size"] != top["size"])
    used = F.when(F.col("reason") == "unique_result_majority", outside).otherwise(
        F.col("reason") == "tied_majority_log_prob"
    )
    return voters.withColumn("reason", reason).select(
        *keys,
        F.when(~none, -chosen["minus_index"]).alias("chosen_index"),
        F.when(none, 0).otherwise(support).cast("bigint").alias("support"),
        F.when(none, 0).otherwise(F.col("v.cluster_count")).cast("bigint").alias("cluster_count"),
        "executable_count",
        used.alias("used_vote"),
        "reason",
        *(["baseline_index"] if with_baseline else []),
    )


def cluster_support(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates with the size of their voting cluster; 0 for those that do not vote.

    Sizes are joined back instead of taken from a window, so Spark can split a hot sample.
    """
    tiered = candidates.withColumn("_tier", _tier()).withColumn(
        "_cluster",
        F.when(F.col("_tier") == 2, F.coalesce("result_key", F.lit(""))).otherwise(""),
    )
    sizes = tiered.groupBy(*keys, "_tier", "_cluster").agg(F.count("*").alias("_size"))
    voting = sizes.groupBy(*keys).agg(F.max("_tier").alias("_voting_tier"))
    known = sizes.join(voting, list(keys))
    joined = tiered.join(known, [*keys, "_tier", "_cluster"])
    votes = (F.col("_tier") > 0) & (F.col("_tier") == F.col("_voting_tier"))
    return joined.withColumn(
        "cluster_support", F.when(votes, F.col("_size")).otherwise(F.lit(0)).cast("bigint")
    ).drop("_tier", "_cluster", "_size", "_voting_tier")


def candidate_view(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flat per-candidate projection with support and the selected flag."""
    chosen = result_vote(candidates, keys).select(*keys, "chosen_index")
    return (
        cluster_support(candidates, keys)
        .join(chosen, list(keys))
        .select(
            *keys,
            "candidate_index",
            "kind",
            "predicted_sql",
            "extraction_status",
            "format_compliance",
            "completion_tokens",
            "mean_logprob",
            F.col("status").alias("execution_status"),
            "row_count",
            "column_count",
            "empty_result",
            F.col("elapsed_ms").alias("execution_elapsed_ms"),
            "error_type",
            F.coalesce(F.col("candidate_index") == F.col("chosen_index"), F.lit(False)).alias(
                "selected"
            ),
            "cluster_support",
        )
    )


def pass_k_rows(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two rows per sample: the greedy candidate and the voted one (system = greedy / vote).

    The greedy candidate stands in when nothing could be executed; a sample without one
    uses its first candidate.
    """
    both = result_vote(scored, keys, with_baseline=True)
    picks = both.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.lit("greedy").alias("system"),
                    F.col("baseline_index").alias("candidate_index"),
                    F.lit(None).cast("string").alias("vote_reason"),
                ),
                F.struct(
                    F.lit("vote").alias("system"),
                    F.coalesce("chosen_index", "baseline_index").alias("candidate_index"),
                    F.col("reason").alias("vote_reason"),
                ),
            )
        ),
    )
    return scored.join(picks, [*keys, "candidate_index"])
