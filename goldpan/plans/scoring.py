"""Result comparison, voting and group screening (families G and H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, screening, voting
from ..functions.numbers import set_f1
from . import inputs
from .inputs import CANDIDATES, GOLD, SAMPLES, SCORED, with_
from .registry import Tables, query

SAMPLE = ["source_index"]

# ---- G: row sets of neighbouring customers -------------------------------------------

_CELLS = "o_orderstatus AS a, substr(o_orderpriority, 1, 1) = '1' AS b"
_PAIRS = f"""p AS (SELECT o_custkey AS pair, {_CELLS} FROM orders),
g AS (SELECT o_custkey - 1 AS pair, {_CELLS} FROM orders),
dp AS (SELECT DISTINCT * FROM p), dg AS (SELECT DISTINCT * FROM g),
rows_ AS (SELECT coalesce(dp.pair, dg.pair) AS pair, dp.pair IS NOT NULL AS in_p,
                 dg.pair IS NOT NULL AS in_g
          FROM dp FULL JOIN dg ON dp.pair = dg.pair AND dp.a = dg.a AND dp.b = dg.b),
asked AS (SELECT c_custkey AS pair FROM customer UNION SELECT c_custkey - 1 FROM customer),
counts AS (SELECT pair, count(*) FILTER (in_p) AS np, count(*) FILTER (in_g) AS ng,
                  count(*) FILTER (in_p AND in_g) AS nc, count(*) FILTER (in_p OR in_g) AS nu
           FROM asked LEFT JOIN rows_ USING (pair) GROUP BY pair)"""


def _pair_counts(t: Tables):
    predicted = t.orders.selectExpr("o_custkey AS pair", *_CELLS.split(", ", 1))
    gold = t.orders.selectExpr("o_custkey - 1 AS pair", *_CELLS.split(", ", 1))
    asked = t.customer.selectExpr("c_custkey AS pair")
    asked = asked.unionAll(t.customer.selectExpr("c_custkey - 1 AS pair"))
    return scoring.compare_row_sets(predicted, gold, ["pair"], ["a", "b"], asked)


@query(
    "g01_execution_match",
    with_(_PAIRS) + "SELECT pair, CAST(nc = nu AS INTEGER) AS official_ex FROM counts",
)
def _(t: Tables):
    counts = _pair_counts(t)
    return counts.select("pair", scoring.execution_match(counts).alias("official_ex"))


@query(
    "g02_set_f1",
    with_(_PAIRS)
    + """SELECT pair, round(CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 OR nc = 0
    THEN 0.0 ELSE 2.0 * nc / (np + ng) END, 6) AS f1 FROM counts""",
)
def _(t: Tables):
    f1 = set_f1(F.col("common_rows"), F.col("predicted_rows"), F.col("gold_rows"))
    return _pair_counts(t).select("pair", F.round(f1, 6).alias("f1"))


_ACCESS = (
    "o_orderkey AS source_index",
    "concat(o_orderstatus, ',Orders,', o_orderpriority, ',ORDERS') AS predicted_names",
    "concat(lower(o_orderstatus), ',orders,', CASE WHEN o_orderkey % 2 = 0 THEN '1-URGENT' "
    "ELSE 'customer' END) AS gold_names"
)


@query(
    "g03_access_sets",
    f"""WITH a AS (SELECT {', '.join(_ACCESS)} FROM orders)
SELECT source_index,
  array_to_string(list_sort(list_distinct(string_split(lower(predicted_names), ','))), ',')
    AS predicted_set,
  array_to_string(list_sort(list_distinct(string_split(lower(gold_names), ','))), ',') AS gold_set,
  round(2.0 * len(list_intersect(list_distinct(string_split(lower(predicted_names), ',')),
                                 list_distinct(string_split(lower(gold_names), ','))))
    / (len(list_distinct(string_split(lower(predicted_names), ',')))
       + len(list_distinct(string_split(lower(gold_names), ',')))), 6) AS f1
FROM a""",
)
def _(t: Tables):
    rows = t.orders.selectExpr(*_ACCESS).select(
        "source_index",
        F.split("predicted_names", ",").alias("predicted"),
        F.split("gold_names", ",").alias("gold"),
    )
    return scoring.with_access_f1(rows, "predicted", "gold", "f1").select(
        "source_index",
        F.array_join(F.array_sort("predicted"), ",").alias("predicted_set"),
        F.array_join(F.array_sort("gold"), ",").alias("gold_set"),
        F.round("f1", 6).alias("f1"),
    )


@query(
    "g04_result_jaccard",
    with_(_PAIRS)
    + "SELECT pair, round(CASE WHEN nu = 0 THEN 1.0 ELSE nc / nu END, 6) AS result_jaccard FROM counts",
)
def _(t: Tables):
    return _pair_counts(t).select("pair", F.round(scoring.result_jaccard(), 6).alias("result_jaccard"))


@query(
    "g05_partial_score",
    with_(_PAIRS)
    + """, sizes AS (SELECT c.*,
    (SELECT count(*) FROM p WHERE p.pair = c.pair) AS rp,
    (SELECT count(*) FROM g WHERE g.pair = c.pair) AS rg,
    pair % 5 <> 0 AS ok, 2 + pair % 2 AS pc, 2 + pair % 3 AS gc FROM counts c),
  base AS (SELECT *, CAST(nc = nu AS INTEGER) AS ex,
    CASE WHEN pair % 2 = 0 THEN 1.0 ELSE 2.0 / 3.0 END AS tf,
    CASE WHEN pair % 3 = 0 THEN 0.5 ELSE 0.8 END AS cf,
    CASE WHEN pc <> gc THEN 0.0 WHEN nu = 0 THEN 1.0 ELSE CAST(nc AS DOUBLE) / nu END AS jac FROM sizes)
SELECT pair, ok AS executable,
  CASE WHEN ok THEN ex ELSE 0 END AS official_ex,
  round(CASE WHEN NOT ok THEN 0.0 WHEN ex = 1 THEN 1.0 ELSE least(0.55,
    0.1 + 0.1 * tf + 0.15 * cf + 0.05 * CAST(pc = gc AS INTEGER)
    + 0.05 * CAST(rp = rg AS INTEGER) + 0.15 * jac) END, 8) AS screening_score,
  CASE WHEN ok AND pc = gc THEN 1 ELSE 0 END AS column_count_match,
  CASE WHEN ok AND rp = rg THEN 1 ELSE 0 END AS row_count_match,
  round(CASE WHEN ok THEN jac ELSE 0.0 END, 8) AS result_jaccard
FROM base""",
)
def _(t: Tables):
    rows = _pair_counts(t).select(
        "pair",
        F.expr("CASE WHEN pair % 5 <> 0 THEN 'success' ELSE 'timeout' END").alias("status"),
        F.expr("2 + pair % 2").alias("column_count"),
        F.expr("2 + pair % 3").alias("gold_column_count"),
        F.col("predicted_row_count").alias("row_count"),
        F.col("gold_row_count").alias("gold_row_count"),
        scoring.execution_match(None).alias("official_ex"),
        F.expr("CASE WHEN pair % 2 = 0 THEN 1D ELSE 2D / 3D END").alias("table_f1"),
        F.expr("CASE WHEN pair % 3 = 0 THEN 0.5D ELSE 0.8D END").alias("column_f1"),
        scoring.result_jaccard().alias("result_jaccard"),
    )
    return scoring.partial_score(rows).select(
        "pair",
        (F.col("status") == "success").alias("executable"),
        "official_ex",
        "screening_score",
        "column_count_match",
        "row_count_match",
        "result_jaccard",
    )


@query(
    "g06_prediction_scoring",
    with_(CANDIDATES, GOLD)
    + """SELECT c.source_index, c.candidate_index, g.db_id, g.difficulty, c.extraction_status,
  c.format_compliance, c.status AS prediction_status, g.gold_status, g.gold_elapsed_ms,
  CASE WHEN c.status = 'success' AND g.gold_status = 'success' AND c.result_key = g.gold_key
       THEN 1 ELSE 0 END AS official_ex, c.elapsed_ms, c.error_type
FROM candidates c JOIN gold g ON c.source_index = g.source_index""",
)
def _(t: Tables):
    gold = inputs.gold(t).select(
        "source_index", "db_id", "difficulty", "gold_status", "gold_elapsed_ms", "gold_key"
    )
    return scoring.score_predictions(gold, inputs.candidates(t), SAMPLE).select(
        "source_index", "candidate_index", "db_id", "difficulty", "extraction_status",
        "format_compliance", F.col("status").alias("prediction_status"), "gold_status",
        "gold_elapsed_ms", "official_ex", "elapsed_ms", "error_type",
    )


_VOTE = """ok AS (SELECT * FROM candidates WHERE status = 'success'),
tiers AS (SELECT source_index, bool_or(NOT empty_result) AS has_rows, count(*) AS executable
          FROM ok GROUP BY source_index),
voters AS (SELECT o.*, CASE WHEN t.has_rows THEN o.result_key ELSE '' END AS ck, t.executable
           FROM ok o JOIN tiers t ON o.source_index = t.source_index
           WHERE t.has_rows = NOT o.empty_result),
clusters AS (SELECT source_index, ck, count(*) AS size, min(candidate_index) AS first_index,
    CASE WHEN count(mean_logprob) = count(*) THEN round(sum(mean_logprob) / count(*), 12)
         ELSE CAST('-infinity' AS DOUBLE) END AS lp FROM voters GROUP BY source_index, ck),
sized AS (SELECT *, max(size) OVER (PARTITION BY source_index) AS largest,
    count(*) OVER (PARTITION BY source_index) AS cluster_count FROM clusters),
leaders AS (SELECT *, count(*) OVER (PARTITION BY source_index) AS ties,
    row_number() OVER (PARTITION BY source_index ORDER BY lp DESC, first_index) AS rn
    FROM sized WHERE size = largest),
greedy AS (SELECT v.source_index, v.ck, s.size FROM
    (SELECT source_index, min(candidate_index) AS gi FROM voters WHERE is_greedy GROUP BY 1) m
    JOIN voters v ON v.source_index = m.source_index AND v.candidate_index = m.gi
    JOIN sized s ON s.source_index = v.source_index AND s.ck = v.ck),
decided AS (SELECT l.source_index, l.cluster_count, l.largest,
    CASE WHEN l.largest >= 2 AND l.ties = 1 THEN 'unique_result_majority'
         WHEN l.largest >= 2 AND g.size = l.largest THEN 'tied_majority_kept_greedy'
         WHEN l.largest >= 2 THEN 'tied_majority_log_prob'
         WHEN g.ck IS NOT NULL THEN 'kept_greedy_without_majority'
         ELSE 'log_prob_fallback' END AS reason, l.ck AS top_ck, g.ck AS greedy_ck
    FROM leaders l LEFT JOIN greedy g ON g.source_index = l.source_index WHERE l.rn = 1),
picked AS (SELECT *, CASE WHEN reason IN ('tied_majority_kept_greedy',
    'kept_greedy_without_majority') THEN greedy_ck ELSE top_ck END AS ck FROM decided),
winners AS (SELECT p.*, v.candidate_index, v.executable,
    count(*) OVER (PARTITION BY p.source_index) AS support,
    row_number() OVER (PARTITION BY p.source_index ORDER BY v.is_greedy DESC,
      coalesce(v.mean_logprob, CAST('-infinity' AS DOUBLE)) DESC, v.candidate_index) AS wrn
    FROM picked p JOIN voters v ON v.source_index = p.source_index AND v.ck = p.ck),
vote AS (SELECT s.source_index, w.candidate_index AS chosen_index,
    coalesce(w.support, 0) AS support, coalesce(w.cluster_count, 0) AS cluster_count,
    coalesce(w.executable, 0) AS executable_count,
    coalesce(CASE WHEN w.reason = 'unique_result_majority' THEN w.greedy_ck IS DISTINCT FROM w.ck
         ELSE w.reason = 'tied_majority_log_prob' END, false) AS used_vote,
    coalesce(w.reason, 'no_executable_candidate') AS reason
    FROM (SELECT DISTINCT source_index FROM candidates) s
    LEFT JOIN winners w ON w.source_index = s.source_index AND w.wrn = 1)"""
_SUPPORT = """support AS (SELECT c.source_index, c.candidate_index, coalesce(v.n, 0) AS cluster_support
  FROM candidates c LEFT JOIN (SELECT source_index, candidate_index,
    count(*) OVER (PARTITION BY source_index, ck) AS n FROM voters) v
  ON v.source_index = c.source_index AND v.candidate_index = c.candidate_index)"""


@query("h01_result_vote", with_(CANDIDATES, _VOTE) + "SELECT * FROM vote")
def result_vote(t: Tables):
    return voting.result_vote(inputs.candidates(t), SAMPLE)


@query("h02_cluster_support", with_(CANDIDATES, _VOTE, _SUPPORT) + "SELECT * FROM support")
def _(t: Tables):
    return voting.cluster_support(inputs.candidates(t), SAMPLE).select(
        "source_index", "candidate_index", "cluster_support"
    )


@query(
    "h03_candidate_view",
    with_(CANDIDATES, _VOTE, _SUPPORT)
    + """SELECT c.source_index, c.candidate_index, c.kind, c.predicted_sql, c.extraction_status,
  c.format_compliance, c.completion_tokens, c.mean_logprob, c.status AS execution_status,
  c.row_count, c.column_count, c.empty_result, c.elapsed_ms AS execution_elapsed_ms, c.error_type,
  coalesce(c.candidate_index = v.chosen_index, false) AS selected, s.cluster_support
FROM candidates c JOIN support s ON s.source_index = c.source_index
  AND s.candidate_index = c.candidate_index
JOIN vote v ON v.source_index = c.source_index""",
)
def _(t: Tables):
    return voting.candidate_view(inputs.candidates(t), SAMPLE)


#: Greedy and voted rows; needs CANDIDATES, GOLD, SCORED and _VOTE before it.
PASS_K = """base AS (SELECT source_index, coalesce(min(candidate_index) FILTER (is_greedy),
    min(candidate_index)) AS fi FROM scored GROUP BY source_index),
picks AS (SELECT b.source_index, 'greedy' AS system, b.fi AS candidate_index,
            NULL AS vote_reason FROM base b
          UNION ALL SELECT b.source_index, 'vote', coalesce(v.chosen_index, b.fi), v.reason
          FROM base b JOIN vote v ON v.source_index = b.source_index),
passk AS (SELECT s.*, p.system, p.vote_reason FROM scored s JOIN picks p
          ON p.source_index = s.source_index AND p.candidate_index = s.candidate_index)"""
PASS_K_SQL = with_(CANDIDATES, GOLD, SCORED, _VOTE, PASS_K)


def pass_k(t: Tables):
    return voting.pass_k_rows(inputs.scored(t), SAMPLE)


@query(
    "g07_pass_k_scoring",
    PASS_K_SQL + "SELECT source_index, system, candidate_index, vote_reason, official_ex FROM passk",
)
def _(t: Tables):
    return pass_k(t).select(
        "source_index", "system", "candidate_index", "vote_reason", "official_ex"
    )


# ---- H: screening ---------------------------------------------------------------------

SCORED_SQL = with_(CANDIDATES, GOLD, SCORED)
_SCREEN = """screened AS (SELECT source_index, reason IS NULL AS scorable,
    reason AS exclusion_reason, valid AS valid_candidate_count,
    cut AS truncated_candidate_count,
    CASE WHEN reason IS NULL THEN exact ELSE 0 END AS exact_pass_count,
    CASE WHEN reason IS NULL THEN low END AS screening_score_min,
    CASE WHEN reason IS NULL THEN high END AS screening_score_max,
    CASE WHEN reason IS NOT NULL THEN NULL WHEN exact > 0 AND exact < valid THEN 'exact_mixed'
         WHEN exact = 0 AND valid >= 2 AND high - low > 1e-12 THEN 'zero_exact_partial_variance'
         END AS selection_reason
  FROM (SELECT source_index,
      max(CASE WHEN gold_status <> 'success' THEN concat('gold_', gold_status)
               WHEN gold_empty THEN 'empty_gold_result' END) AS reason,
      count(*) FILTER (NOT truncated) AS valid, count(*) FILTER (truncated) AS cut,
      count(*) FILTER (NOT truncated AND official_ex = 1) AS exact,
      min(screening_score) FILTER (NOT truncated) AS low,
      max(screening_score) FILTER (NOT truncated) AS high
    FROM scored GROUP BY source_index))"""


@query(
    "h04_prompt_screening",
    with_(CANDIDATES, GOLD, SCORED, _SCREEN)
    + """SELECT source_index, scorable, exclusion_reason, valid_candidate_count,
  truncated_candidate_count, exact_pass_count, round(screening_score_min, 6) AS screening_score_min,
  round(screening_score_max, 6) AS screening_score_max, selection_reason FROM screened""",
)
def _(t: Tables):
    return screening.screen_prompts(inputs.scored(t), SAMPLE).withColumns(
        {c: F.round(c, 6) for c in ("screening_score_min", "screening_score_max")}
    )


@query(
    "h05_pass_count_screening",
    SCORED_SQL
    + """, passes AS (SELECT source_index, sum(official_ex) AS pass_count FROM scored GROUP BY 1)
SELECT CAST(k.pass_count AS BIGINT) AS pass_count, count(p.source_index) AS prompts
FROM (SELECT unnest(range(5)) AS pass_count UNION SELECT pass_count FROM passes) k
LEFT JOIN passes p ON p.pass_count = k.pass_count GROUP BY 1""",
)
def _(t: Tables):
    return screening.pass_buckets(inputs.scored(t), SAMPLE, 4)


@query(
    "h05_mixed_prompts",
    SCORED_SQL
    + """SELECT source_index, CAST(sum(official_ex) AS BIGINT) AS pass_count,
  count(*) AS candidate_count FROM scored
GROUP BY source_index HAVING sum(official_ex) > 0 AND sum(official_ex) < count(*)""",
)
def _(t: Tables):
    return screening.mixed_prompts(inputs.scored(t), SAMPLE)


@query(
    "h06_screening_summary",
    with_(CANDIDATES, GOLD, SCORED, _SCREEN)
    + """, judged AS (SELECT * FROM scored WHERE NOT truncated AND gold_status = 'success'
    AND NOT gold_empty)
SELECT metric, key, CAST(value AS DOUBLE) AS value FROM (
SELECT 'eligible_prompt_count' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM screened
UNION ALL SELECT 'scorable_prompt_count', '', count(*) FILTER (scorable) FROM screened
UNION ALL SELECT 'unscorable_prompt_count', '', count(*) FILTER (NOT scorable) FROM screened
UNION ALL SELECT 'valid_candidate_count', '', sum(valid_candidate_count) FROM screened
UNION ALL SELECT 'truncated_candidate_count', '', sum(truncated_candidate_count) FROM screened
UNION ALL SELECT 'selected_prompt_count', '', count(selection_reason) FROM screened
UNION ALL SELECT 'selection_rate', '', round(100.0 * count(selection_reason) / count(*), 2) FROM screened
UNION ALL SELECT 'generated_candidate_count', '', count(*) FROM scored
UNION ALL SELECT 'format_compliance_rate', '',
  round(100.0 * count(*) FILTER (format_compliance) / count(*), 2) FROM scored
UNION ALL SELECT 'selection_reason', selection_reason, count(*) FROM screened
  WHERE selection_reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'gold_exclusion_reason', exclusion_reason, count(*) FROM screened
  WHERE NOT scorable GROUP BY 2
UNION ALL SELECT 'exact_pass_count', CAST(exact_pass_count AS STRING), count(*) FROM screened
  WHERE scorable GROUP BY 2
UNION ALL SELECT 'valid_candidate_count', CAST(valid_candidate_count AS STRING), count(*)
  FROM screened WHERE scorable GROUP BY 2
UNION ALL SELECT 'extraction_status', extraction_status, count(*) FROM scored GROUP BY 2
UNION ALL SELECT 'execution_status', status, count(*) FROM judged GROUP BY 2)""",
)
def _(t: Tables):
    scored = inputs.scored(t)
    return screening.screening_summary(scored, screening.screen_prompts(scored, SAMPLE))


@query(
    "h07_selected_records",
    with_(SAMPLES, CANDIDATES, GOLD, SCORED, _SCREEN)
    + """SELECT s.source_index, s.sample_id, s.db_id, s.question, x.selection_reason, x.exact_pass_count
FROM samples s JOIN screened x ON x.source_index = s.source_index
WHERE x.selection_reason IS NOT NULL""",
)
def _(t: Tables):
    records = inputs.samples(t).select("source_index", "sample_id", "db_id", "question")
    screened = screening.screen_prompts(inputs.scored(t), SAMPLE)
    return screening.selected_records(screened, records, SAMPLE)


_GROUPS = """groups_ AS (SELECT source_index, candidate_count, valid_count, exact_count, truncated_count,
    CASE WHEN valid_count < 2 THEN 'insufficient_valid' WHEN exact_count = 0 THEN 'all_wrong'
         WHEN exact_count = valid_count THEN 'all_correct' ELSE 'mixed' END AS group_type
  FROM (SELECT source_index, count(*) AS candidate_count,
      count(*) FILTER (NOT truncated) AS valid_count,
      count(*) FILTER (NOT truncated AND official_ex = 1) AS exact_count,
      count(*) FILTER (truncated) AS truncated_count FROM scored GROUP BY source_index))"""


@query("h08_group_type", with_(CANDIDATES, GOLD, SCORED, _GROUPS) + "SELECT * FROM groups_")
def _(t: Tables):
    return screening.group_type(inputs.scored(t), SAMPLE)


@query(
    "h09_group_advantage",
    SCORED_SQL
    + """SELECT source_index, candidate_index, round(advantage, 6) AS advantage FROM (
  SELECT source_index, candidate_index, count(*) OVER w AS n,
    (screening_score - avg(screening_score) OVER w)
      / (stddev_samp(screening_score) OVER w + 1e-4) AS advantage
  FROM scored WINDOW w AS (PARTITION BY source_index)) WHERE n >= 2""",
)
def _(t: Tables):
    return screening.group_advantage(inputs.scored(t), SAMPLE, "screening_score").select(
        "source_index", "candidate_index", F.round("advantage", 6).alias("advantage")
    )


@query(
    "h10_valid_group_advantage",
    SCORED_SQL
    + """SELECT source_index, candidate_index, round(CASE WHEN truncated OR nv < 2 OR ne = 0 OR ne = nv
    THEN 0.0 ELSE (official_ex - m) / (sd + 1e-4) END, 6) AS advantage FROM (
  SELECT source_index, candidate_index, truncated, official_ex,
    count(*) FILTER (NOT truncated) OVER w AS nv,
    sum(official_ex) FILTER (NOT truncated) OVER w AS ne,
    avg(official_ex) FILTER (NOT truncated) OVER w AS m,
    stddev_samp(official_ex) FILTER (NOT truncated) OVER w AS sd
  FROM scored WINDOW w AS (PARTITION BY source_index))""",
)
def _(t: Tables):
    return screening.valid_group_advantage(inputs.scored(t), SAMPLE).select(
        "source_index", "candidate_index", F.round("advantage", 6).alias("advantage")
    )


@query(
    "h11_signal_accounting",
    with_(CANDIDATES, GOLD, SCORED, _GROUPS)
    + """, pairs AS (SELECT source_index // 2 AS pair, count(*) FILTER (group_type <> 'mixed') AS z,
    bool_or(group_type = 'mixed') AS s, sum(candidate_count) AS n, sum(truncated_count) AS tr
  FROM groups_ GROUP BY 1)
SELECT count(*) AS processed_pairs, CAST(sum(z) AS BIGINT) AS zero_signal_groups,
  round(100.0 * sum(z) / (count(*) * 2), 2) AS zero_signal_rate,
  count(*) FILTER (NOT s) AS skipped_pairs, CAST(sum(n) AS BIGINT) AS completions,
  CAST(sum(tr) AS BIGINT) AS truncated_completions FROM pairs""",
)
def _(t: Tables):
    groups = screening.group_type(inputs.scored(t), SAMPLE)
    return screening.signal_accounting(groups, F.expr("source_index div 2"), 2)


@query(
    "h12_group_counters",
    with_(CANDIDATES, GOLD, SCORED, _GROUPS)
    + """SELECT count(*) AS processed, count(*) FILTER (group_type = 'mixed') AS mixed,
  count(*) FILTER (group_type = 'all_wrong') AS all_wrong,
  count(*) FILTER (group_type = 'all_correct') AS all_correct,
  count(*) FILTER (group_type = 'insufficient_valid') AS insufficient_valid,
  CAST(sum(truncated_count) AS BIGINT) AS truncated FROM groups_""",
)
def _(t: Tables):
    return screening.group_counters(screening.group_type(inputs.scored(t), SAMPLE))
