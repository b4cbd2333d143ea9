"""Run selection, metrics and token statistics (families H14 onwards and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import percentage
from ..operators import metrics, selection, tokens
from . import inputs
from .inputs import CANDIDATES, GOLD, LENGTHS, REQUESTS, RUNS, SCORED, with_
from .registry import Tables, query
from .scoring import PASS_K_SQL, SCORED_SQL, pass_k

_RUN = ["run"]

# ---- H: runs --------------------------------------------------------------------------


@query(
    "h14_best_greedy_run",
    with_(RUNS)
    + """SELECT run, step, correct_count, executable_rate FROM (SELECT *, row_number() OVER (
  PARTITION BY run ORDER BY correct_count DESC, executable_rate DESC, step) AS rn FROM runs)
WHERE rn = 1""",
)
def _(t: Tables):
    return selection.best_greedy_run(inputs.runs(t), _RUN).select(
        "run", "step", "correct_count", "executable_rate"
    )


@query(
    "h15_best_vote_run",
    with_(RUNS)
    + """SELECT run, step, correct_count, executable_rate, greedy_correct FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY correct_count DESC, executable_rate DESC,
  greedy_correct DESC, step) AS rn FROM runs) WHERE rn = 1""",
)
def _(t: Tables):
    return selection.best_vote_run(inputs.runs(t), _RUN).select(
        "run", "step", "correct_count", "executable_rate", "greedy_correct"
    )


_PATHS = (
    "CAST(o_custkey % 7 AS BIGINT) AS run",
    "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS step",
    "concat('step_', CAST(o_orderkey AS STRING)) AS path",
    "o_orderstatus = 'P' AS is_final",
)


@query(
    "h16_checkpoints_by_step",
    f"""WITH paths AS (SELECT {', '.join(_PATHS)} FROM orders)
SELECT run, step, path FROM (SELECT *, row_number() OVER (PARTITION BY run, step
  ORDER BY is_final, path) AS rn FROM paths) WHERE rn = 1""",
)
def _(t: Tables):
    return selection.checkpoints_by_step(t.orders.selectExpr(*_PATHS), _RUN)


@query(
    "h16_latest_checkpoint",
    f"""WITH paths AS (SELECT {', '.join(_PATHS)} FROM orders)
SELECT run, step, path FROM (SELECT *, row_number() OVER (PARTITION BY run
  ORDER BY step DESC, path DESC) AS rn FROM paths) WHERE rn = 1""",
)
def _(t: Tables):
    return selection.latest_checkpoint(t.orders.selectExpr(*_PATHS), _RUN)


@query(
    "h18_best_so_far",
    with_(RUNS)
    + """SELECT run, step, loss, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY step
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM runs""",
)
def _(t: Tables):
    return selection.best_so_far(inputs.runs(t), _RUN, "step").select(
        "run", "step", "loss", "is_best"
    )


# ---- I: metrics -----------------------------------------------------------------------


@query(
    "i01_percentage",
    with_(CANDIDATES)
    + """SELECT source_index, CASE WHEN count(*) FILTER (NOT truncated) = 0 THEN 0.0 ELSE
  round(100.0 * count(*) FILTER (NOT truncated AND status = 'success')
    / count(*) FILTER (NOT truncated), 2) END AS executable_rate
FROM candidates GROUP BY source_index""",
)
def _(t: Tables):
    valid = ~F.col("truncated")
    ok = valid & (F.col("status") == "success")
    return inputs.candidates(t).groupBy("source_index").agg(
        percentage(F.count_if(ok), F.count_if(valid)).alias("executable_rate")
    )


_EX_SQL = "round(100.0 * count(*) FILTER (official_ex = 1{w}) / count(*) FILTER ({c}), 2)"


def _ex_sql(where: str | None) -> str:
    return _EX_SQL.format(w=f" AND {where}" if where else "", c=where or "true")


@query(
    "i02_evaluation_metrics",
    SCORED_SQL
    + f"""SELECT count(*) AS total, {_ex_sql(None)} AS overall_ex,
  {_ex_sql("difficulty = 'simple'")} AS simple_ex,
  {_ex_sql("difficulty = 'moderate'")} AS moderate_ex,
  {_ex_sql("difficulty = 'challenging'")} AS challenging_ex,
  round(100.0 * count(*) FILTER (status = 'success') / count(*), 2) AS executable_rate,
  round(100.0 * count(*) FILTER (format_compliance) / count(*), 2) AS format_compliance_rate,
  count(*) FILTER (status = 'timeout') AS timeout_count,
  count(*) FILTER (error_type = 'syntax_error') AS syntax_error_count,
  count(*) FILTER (error_type = 'missing_table') AS missing_table_count,
  count(*) FILTER (error_type = 'missing_column') AS missing_column_count FROM scored""",
)
def _(t: Tables):
    return metrics.evaluation_metrics(inputs.scored(t))


@query(
    "i03_system_metrics",
    PASS_K_SQL
    + """SELECT system, coalesce(difficulty, 'all') AS difficulty, count(*) AS sample_count,
  CAST(sum(official_ex) AS BIGINT) AS correct_count,
  round(100.0 * sum(official_ex) / count(*), 2) AS official_ex,
  round(100.0 * count(*) FILTER (status = 'success') / count(*), 2) AS executable_rate,
  round(100.0 * count(*) FILTER (format_compliance) / count(*), 2) AS format_compliance_rate,
  count(*) FILTER (gold_status <> 'success') AS gold_failure_count
FROM passk GROUP BY GROUPING SETS ((system), (system, difficulty))""",
)
def _(t: Tables):
    return metrics.system_metrics(pass_k(t))


@query(
    "i04_validation_metrics",
    SCORED_SQL
    + """SELECT count(*) AS sample_count, round(100.0 * sum(official_ex) / count(*), 2) AS official_ex,
  round(100.0 * count(*) FILTER (status = 'success') / count(*), 2) AS executable_rate,
  round(100.0 * count(*) FILTER (format_compliance) / count(*), 2) AS format_compliance_rate,
  count(*) FILTER (gold_status <> 'success') AS gold_failure_count,
  count(*) FILTER (status = 'timeout') AS prediction_timeout_count FROM scored""",
)
def _(t: Tables):
    return metrics.validation_metrics(inputs.scored(t))


@query(
    "i05_transitions",
    PASS_K_SQL
    + """SELECT count(*) AS sample_count,
  count(*) FILTER (a.official_ex = 0 AND b.official_ex = 1) AS wrong_to_right,
  count(*) FILTER (a.official_ex = 1 AND b.official_ex = 0) AS right_to_wrong,
  CAST(sum(b.official_ex) - sum(a.official_ex) AS BIGINT) AS correct_gain,
  round(round(100.0 * sum(b.official_ex) / count(*), 2)
    - round(100.0 * sum(a.official_ex) / count(*), 2), 2) AS ex_gain_points
FROM passk a JOIN passk b ON a.source_index = b.source_index
WHERE a.system = 'greedy' AND b.system = 'vote'""",
)
def _(t: Tables):
    return metrics.transitions(pass_k(t), "greedy", "vote", ["source_index"])


_RATED = "round(100.0 * correct_count / sample_count, 3)"


@query(
    "i06_compact_metrics",
    with_(RUNS)
    + f"""SELECT run, step, sample_count, CASE WHEN step % 2 = 0 THEN correct_count ELSE
  CAST(round_even({_RATED} * sample_count / 100.0, 0) AS BIGINT) END AS correct_count,
  round({_RATED}, 2) AS official_ex, round(executable_rate, 2) AS executable_rate FROM runs""",
)
def _(t: Tables):
    runs = (
        inputs.runs(t)
        .withColumn("official_ex", F.round(F.lit(100.0) * F.col("correct_count") / F.col("sample_count"), 3))
        .withColumn("correct_count", F.when(F.col("step") % 2 == 0, F.col("correct_count")))
    )
    return metrics.compact_metrics(runs).select(
        "run", "step", "sample_count", "correct_count", "official_ex", "executable_rate"
    )


@query(
    "i07_stage_gains",
    with_(RUNS)
    + """SELECT run, step, correct_count - lag(correct_count) OVER w AS correct_gain,
  round(round(100.0 * correct_count / sample_count, 2)
    - lag(round(100.0 * correct_count / sample_count, 2)) OVER w, 2) AS ex_gain_points
FROM runs WINDOW w AS (PARTITION BY run ORDER BY step)""",
)
def _(t: Tables):
    stages = inputs.runs(t).withColumn(
        "official_ex", percentage(F.col("correct_count"), F.col("sample_count"))
    )
    return metrics.stage_gains(stages, _RUN, "step").select(
        "run", "step", "correct_gain", "ex_gain_points"
    )


_POINTS = (50, 90, 95, 99)
_LONG = """long_ AS (SELECT split, 'prompt_tokens' AS measure, prompt_tokens AS value FROM lengths
  UNION ALL SELECT split, 'completion_tokens', completion_tokens FROM lengths
  UNION ALL SELECT split, 'total_tokens', total_tokens FROM lengths)"""
_DISC = ", ".join(
    f"quantile_disc(value, {p / 100}) AS p{p}" for p in _POINTS
)


@query(
    "i08_nearest_rank",
    with_(LENGTHS)
    + """SELECT split, """
    + ", ".join(f"quantile_disc(total_tokens, {p / 100}) AS p{p}" for p in _POINTS)
    + " FROM lengths GROUP BY split",
)
def _(t: Tables):
    return tokens.length_distribution(inputs.lengths(t), measures=["total_tokens"]).select(
        "split", *[f"p{p}" for p in _POINTS]
    )


@query(
    "i09_length_distribution",
    with_(LENGTHS, _LONG)
    + f"""SELECT split, measure, count(*) AS sample_count, min(value) AS min, {_DISC},
  max(value) AS max, CAST(sum(value) AS BIGINT) AS total FROM long_ GROUP BY split, measure""",
)
def _(t: Tables):
    return tokens.length_distribution(inputs.lengths(t))


@query(
    "i10_split_statistics",
    with_(LENGTHS, _LONG)
    + f""", over_ AS (SELECT split, count(*) FILTER (total_tokens > 4096) AS over_4096,
    count(*) FILTER (total_tokens > 8192) AS over_8192,
    count(*) FILTER (total_tokens > 12288) AS over_12288,
    count(*) FILTER (total_tokens > 16384) AS over_16384 FROM lengths GROUP BY split)
SELECT l.split, measure, count(*) AS sample_count, {_DISC}, max(value) AS max,
  any_value(over_4096) AS over_4096, any_value(over_8192) AS over_8192,
  any_value(over_12288) AS over_12288, any_value(over_16384) AS over_16384
FROM long_ l JOIN over_ o ON l.split = o.split GROUP BY l.split, measure""",
)
def _(t: Tables):
    return tokens.split_statistics(inputs.lengths(t))


@query(
    "i11_longest_samples",
    with_(LENGTHS)
    + """SELECT split, rank, sample_id, db_id, prompt_tokens, completion_tokens, total_tokens FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY total_tokens DESC, source_index)
  AS INTEGER) AS rank FROM lengths) WHERE rank <= 10""",
)
def _(t: Tables):
    return tokens.longest(inputs.lengths(t)).select(
        "split", "rank", "sample_id", "db_id", "prompt_tokens", "completion_tokens", "total_tokens"
    )


_LIMITS = [64, 256, 1024, 4096]
_KEPT = "least(greatest(0, least(total_tokens, L) - prompt_tokens), completion_tokens)"
_TRUNC = f"""cut AS (SELECT lengths.*, CAST(L AS BIGINT) AS max_length, {_KEPT} AS kept
  FROM lengths, (SELECT unnest([64, 256, 1024, 4096]) AS L)),
trunc_ AS (SELECT max_length, split,
    count(*) FILTER (total_tokens > max_length) AS truncated_sample_count,
    count(*) FILTER (prompt_tokens > max_length) AS prompt_truncated_count,
    count(*) FILTER (kept < completion_tokens) AS completion_truncated_count,
    count(*) FILTER (kept = 0) AS zero_supervised_token_count,
    CAST(sum(kept) AS BIGINT) AS retained_supervised_tokens,
    round(CAST(sum(kept) AS DOUBLE) / sum(completion_tokens), 6) AS retained_supervised_token_rate
  FROM cut GROUP BY max_length, split)"""


@query("i12_truncation", with_(LENGTHS, _TRUNC) + "SELECT * FROM trunc_")
def _(t: Tables):
    return tokens.truncation(inputs.lengths(t), _LIMITS)


@query(
    "i12_retained_distribution",
    with_(LENGTHS, _TRUNC)
    + f"""SELECT split, CAST(max_length AS STRING) AS measure, count(*) AS sample_count,
  min(value) AS min, {_DISC}, max(value) AS max, CAST(sum(value) AS BIGINT) AS total
FROM (SELECT *, CAST(kept AS BIGINT) AS value FROM cut) GROUP BY split, max_length""",
)
def _(t: Tables):
    return tokens.retained_distribution(inputs.lengths(t), _LIMITS)


_RISKS = ["truncated_sample_count", "prompt_truncated_count", "zero_supervised_token_count"]
_ALL_LIMITS = [64, 256, 1024, 4096, 16384, 65536]


@query(
    "i13_minimum_safe_length",
    with_(LENGTHS, _TRUNC.replace("[64, 256, 1024, 4096]", str(_ALL_LIMITS)))
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, min(max_length) FILTER (risk = 0) AS minimum_safe_length FROM "
        f"(SELECT max_length, max({m}) AS risk FROM trunc_ GROUP BY 1)"
        for m in _RISKS
    ),
)
def _(t: Tables):
    return tokens.minimum_safe_length(tokens.truncation(inputs.lengths(t), _ALL_LIMITS), _RISKS)


@query(
    "i14_longest_record",
    with_(LENGTHS)
    + """SELECT split, count(*) OVER (PARTITION BY split) AS sample_count,
  sample_id AS longest_sample_id, total_tokens AS max_sequence_length,
  completion_tokens AS longest_sample_supervised_tokens FROM lengths
QUALIFY row_number() OVER (PARTITION BY split ORDER BY total_tokens DESC, source_index) = 1""",
)
def _(t: Tables):
    return tokens.longest_record(inputs.lengths(t))


@query(
    "i15_latency_report",
    with_(REQUESTS)
    + """, ordered AS (SELECT *, row_number() OVER (ORDER BY total_ms) - 1 AS pos FROM requests),
n AS (SELECT count(*) AS n FROM requests)
SELECT count(*) AS request_count, count(*) FILTER (status = 'success') AS success_count,
  count(*) FILTER (status <> 'success') AS error_count, round(count(*) / 3600.0, 6) AS qps,
  round(avg(generation_ms) FILTER (status = 'success'), 6) AS mean_generation_ms,
  round(avg(execution_ms) FILTER (status = 'success'), 6) AS mean_execution_ms,
  max(total_ms) FILTER (pos = (SELECT round_even(0.5 * (n - 1), 0) FROM n)) AS latency_p50_ms,
  max(total_ms) FILTER (pos = (SELECT round_even(0.95 * (n - 1), 0) FROM n)) AS latency_p95_ms,
  max(total_ms) FILTER (pos = (SELECT round_even(0.99 * (n - 1), 0) FROM n)) AS latency_p99_ms
FROM ordered""",
)
def _(t: Tables):
    return metrics.latency_report(inputs.requests(t), 3600.0)


@query(
    "i16_request_rollup",
    with_(CANDIDATES)
    + """SELECT source_index, count(*) AS candidate_count,
  count(*) FILTER (status = 'success') AS executable_count,
  CAST(sum(completion_tokens) AS BIGINT) AS output_tokens,
  round(sum(elapsed_ms), 3) AS execution_ms FROM candidates GROUP BY source_index""",
)
def _(t: Tables):
    return metrics.request_rollup(inputs.candidates(t), ["source_index"])


@query(
    "i17_weighted_loss",
    with_(RUNS)
    + """SELECT run, CAST(sum(supervised_tokens) AS BIGINT) AS supervised_tokens,
  round(sum(loss * supervised_tokens) / sum(supervised_tokens), 8) AS validation_loss,
  round(exp(sum(loss * supervised_tokens) / sum(supervised_tokens)), 6) AS perplexity
FROM runs GROUP BY run""",
)
def _(t: Tables):
    return metrics.weighted_loss(inputs.runs(t), _RUN)


@query(
    "i18_training_windows",
    with_(RUNS)
    + """SELECT run, CAST(floor((step - 1) / 6) AS BIGINT) AS window, max(step) AS global_step,
  round(sum(loss * supervised_tokens) / sum(supervised_tokens), 8) AS train_loss,
  CAST(sum(supervised_tokens) AS BIGINT) AS supervised_tokens,
  round(sum(supervised_tokens * 3) / CAST(sum(sample_count) AS DOUBLE), 6) AS tokens_per_second
FROM runs GROUP BY 1, 2""",
)
def _(t: Tables):
    log = inputs.runs(t).withColumn("input_tokens", F.col("supervised_tokens") * 3).withColumn(
        "elapsed_seconds", F.col("sample_count")
    )
    return metrics.training_windows(log, _RUN, 6)


@query(
    "i19_log_merge",
    """SELECT event_id AS cursor, user_id % 4 AS rank, event_type, value FROM events
ORDER BY cursor, rank""",
)
def _(t: Tables):
    log = t.events.selectExpr("event_id AS cursor", "user_id % 4 AS rank", "event_type", "value")
    shards = [log.where(F.col("rank") == r) for r in range(4)]
    return metrics.merged_log(shards, "cursor", "rank")


@query(
    "i20_log_truncation",
    with_(RUNS)
    + """SELECT run, step, loss FROM runs r WHERE step < (SELECT max(step) FROM runs x
  WHERE x.run = r.run) - 12""",
)
def _(t: Tables):
    from ..operators import batch

    runs = inputs.runs(t).select("run", "step", "loss")
    saved = runs.groupBy("run").agg((F.max("step") - 12).alias("saved_step"))
    return batch.before_checkpoint(runs, saved, ["run"], "step", "saved_step")
