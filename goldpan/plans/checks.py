"""Constraint checks (family C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import constraints as c
from ..operators import datasets, tokens
from . import inputs
from .inputs import CANDIDATES, GOLD, LENGTHS, RAW, SAMPLES, with_
from .registry import Tables, query
from .texts import PLAIN_SQL


@query(
    "c01_row_counts",
    with_(SAMPLES)
    + """SELECT coalesce(a.split, e.split) AS split, coalesce(e.expected, 0) AS expected,
  coalesce(a.actual, 0) AS actual, coalesce(e.expected, 0) = coalesce(a.actual, 0) AS passed
FROM (SELECT split, count(*) AS actual FROM samples GROUP BY split) a
FULL JOIN (SELECT * FROM (VALUES ('train', CAST(6013 AS BIGINT)), ('validation', 588),
  ('dev', 1534)) v(split, expected)) e ON a.split = e.split""",
)
def _(t: Tables):
    expected = {"train": 6013, "validation": 588, "dev": 1534}
    return c.row_counts(inputs.samples(t), "split", expected)


@query(
    "c02_unique_key",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(t: Tables):
    return c.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "c03_contiguous_range",
    """WITH n AS (SELECT CAST(max(o_orderkey) AS BIGINT) AS n FROM orders),
ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem),
want AS (SELECT unnest(range((SELECT n FROM n))) AS id)
SELECT coalesce(w.id, i.id) AS id, CASE WHEN i.id IS NULL THEN 'missing' ELSE 'unexpected' END AS issue
FROM want w FULL JOIN ids i ON w.id = i.id WHERE w.id IS NULL OR i.id IS NULL""",
)
def _(t: Tables):
    n = t.orders.agg(F.max("o_orderkey")).first()[0]
    return c.contiguous_range(t.lineitem, "l_orderkey", n)


@query(
    "c04_positional_order",
    """SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (
  ORDER BY o_custkey, o_orderkey) - 1 AS position FROM orders) WHERE position <> o_orderkey""",
)
def _(t: Tables):
    keys = t.orders.select("o_orderkey", "o_custkey")
    return c.positional_order(keys, "o_orderkey", F.col("o_custkey"), F.col("o_orderkey")).select(
        "o_orderkey", "position"
    )


_RULES = ["question_not_blank", "evidence_not_blank", "known_question", "known_difficulty", "index_not_negative"]


@query(
    "c05_values_and_enums",
    with_(SAMPLES)
    + """, bad AS (
SELECT 'question_not_blank' AS rule FROM samples WHERE trim(question) = ''
UNION ALL SELECT 'evidence_not_blank' FROM samples WHERE trim(evidence) = ''
UNION ALL SELECT 'known_question' FROM samples WHERE question NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
UNION ALL SELECT 'known_difficulty' FROM samples WHERE difficulty NOT IN ('simple', 'moderate', 'challenging')
UNION ALL SELECT 'index_not_negative' FROM samples WHERE source_index < 0)
SELECT r.rule, count(b.rule) AS violations, count(b.rule) = 0 AS passed FROM (VALUES """
    + ", ".join(f"('{r}')" for r in _RULES)
    + ") r(rule) LEFT JOIN bad b ON b.rule = r.rule GROUP BY r.rule",
)
def _(t: Tables):
    rules = {
        "question_not_blank": c.not_blank(F.col("question")),
        "evidence_not_blank": c.not_blank(F.col("evidence")),
        "known_question": c.one_of(F.col("question"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]),
        "known_difficulty": c.one_of(F.col("difficulty"), ["simple", "moderate", "challenging"]),
        "index_not_negative": F.col("source_index") >= 0,
    }
    return c.passed(c.check_rows(inputs.samples(t), "sample_id", rules), list(rules))


_PROPS = (
    "CASE event_type WHEN 'click' THEN concat('{\"k\":', CAST(user_id AS STRING), ',\"x\":1}') "
    "WHEN 'view' THEN '{}' ELSE props END"
)


_RAW_EVENT = (
    "CASE event_type WHEN 'click' THEN concat('{\"k\":true,\"m\":{\"v\":', CAST(event_id AS STRING), '}}') "
    "WHEN 'view' THEN concat('{\"k\":', CAST(event_id AS STRING), '.0,\"m\":{\"v\":\"', CAST(event_id AS STRING), '\"}}') "
    "WHEN 'purchase' THEN concat('{\"k\":\"', CAST(event_id AS STRING), '\"}') "
    "WHEN 'error' THEN '{\"k\":null,\"m\":[1]}' ELSE props END"
)


def _json_type_sql(path: str) -> str:
    return f"""CASE json_type(raw, '{path}') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer'
  WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null'
  WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'missing' END"""


_TYPES = {"$.k": "integer", "$.m.v": "integer"}


@query(
    "c05_record_types",
    f"WITH raws AS (SELECT event_id, {_RAW_EVENT} AS raw FROM events) SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT event_id, '{p}' AS path, '{e}' AS expected, {_json_type_sql(p)} AS found FROM raws"
        for p, e in _TYPES.items()
    )
    + ") WHERE found <> expected",
)
def _(t: Tables):
    raws = t.events.selectExpr("event_id", f"{_RAW_EVENT} AS raw")
    return c.record_types(raws, "event_id", F.col("raw"), _TYPES)


@query(
    "c06_field_set",
    f"""WITH e AS (SELECT event_id, json_keys({_PROPS}) AS ks FROM events)
SELECT event_id, CASE WHEN list_contains(ks, 'k') THEN '' ELSE 'k' END AS missing,
  array_to_string(list_sort(list_filter(ks, lambda x: x <> 'k')), ',') AS extra FROM e
WHERE NOT list_contains(ks, 'k') OR len(list_filter(ks, lambda x: x <> 'k')) > 0""",
)
def _(t: Tables):
    return c.field_set(t.events, "event_id", F.expr(_PROPS), ["k"])


@query(
    "c07_reference_match",
    """WITH pred AS (SELECT l_orderkey AS k, 'db_' || CAST(l_partkey % 3 AS STRING) AS db_id FROM lineitem),
gold AS (SELECT o_orderkey + 100 AS k, 'db_' || CAST(o_custkey % 3 AS STRING) AS db_id FROM orders)
SELECT p.k, CASE WHEN g.k IS NULL THEN 'unknown_id' ELSE 'field_mismatch' END AS issue
FROM pred p LEFT JOIN gold g ON g.k = p.k WHERE g.k IS NULL OR g.db_id <> p.db_id
UNION ALL SELECT k, 'missing_prediction' FROM gold WHERE k NOT IN (SELECT k FROM pred)""",
)
def _(t: Tables):
    predictions = t.lineitem.selectExpr("l_orderkey AS k", "concat('db_', l_partkey % 3) AS db_id")
    annotations = t.orders.selectExpr("o_orderkey + 100 AS k", "concat('db_', o_custkey % 3) AS db_id")
    return c.reference_match(predictions, annotations, "k", "db_id")


@query(
    "c08_cross_field_consistency",
    with_(RAW, PLAIN_SQL)
    + """, claimed AS (SELECT source_index, extraction_status, conv_id % 7 IN (1, 2) AS format_compliance,
    CASE WHEN turn = 0 THEN '' ELSE predicted_sql END AS predicted_sql FROM plain)
SELECT 'compliance_matches_status' AS rule, CAST(source_index AS STRING) AS key FROM claimed
WHERE format_compliance <> (extraction_status = 'sql_fence')
UNION ALL SELECT 'failed_has_no_sql', CAST(source_index AS STRING) FROM claimed
WHERE (extraction_status = 'failed') <> (trim(predicted_sql) = '')""",
)
def _(t: Tables):
    found = text.extract_sql(F.col("raw_output"))
    claimed = inputs.raw_outputs(t).select(
        "source_index",
        found["extraction_status"].alias("extraction_status"),
        F.expr("conv_id % 7 IN (1, 2)").alias("format_compliance"),
        F.when(F.col("turn") == 0, "").otherwise(found["predicted_sql"]).alias("predicted_sql"),
    )
    return c.check_rows(claimed, "source_index", c.extraction_consistency())


@query(
    "c09_rederivation",
    with_(RAW, PLAIN_SQL)
    + """SELECT 'predicted_sql' AS rule, CAST(source_index AS STRING) AS key FROM plain
WHERE predicted_sql <> CASE WHEN turn % 4 = 1 THEN gold_sql ELSE predicted_sql END""",
)
def _(t: Tables):
    again = text.extract_sql(F.col("raw_output"))["predicted_sql"]
    stored = inputs.raw_outputs(t).withColumn(
        "predicted_sql", F.when(F.col("turn") % 4 == 1, F.col("gold_sql")).otherwise(again)
    )
    return c.rederived(stored, "source_index", {"predicted_sql": again})


_SHAPE = {
    "known_status": "status NOT IN ('success', 'timeout', 'execution_error', 'unsafe_sql', 'row_limit')",
    "row_count_not_negative": "row_count < 0",
    "column_count_not_negative": "column_count < 0",
    "elapsed_is_finite": "elapsed_ms < 0",
    "success_has_no_error": "status = 'success' AND error_type IS NOT NULL",
    "failure_has_error": "status <> 'success' AND error_type IS NULL",
    "empty_flag_agrees": "status = 'success' AND empty_result <> (row_count = 0)",
    "failure_has_zero_shape": "status NOT IN ('success', 'row_limit') AND (row_count <> 0 OR column_count <> 0)",
}


@query(
    "c10_execution_shape",
    with_(CANDIDATES)
    + " UNION ALL ".join(
        f"SELECT '{r}' AS rule, count(*) FILTER ({w}) AS violations, "
        f"count(*) FILTER ({w}) = 0 AS passed FROM candidates"
        for r, w in _SHAPE.items()
    ),
)
def _(t: Tables):
    rules = c.execution_shape()
    return c.passed(c.check_rows(inputs.candidates(t), "candidate_index", rules), list(rules))


# Every seventh order has its gold statement in the evidence, as a careless annotator would leave it.
_LEAKY = "CASE WHEN source_index % 7 = 0 THEN concat('try ', gold_sql, ' first') ELSE evidence END AS evidence"


@query(
    "c11_leakage",
    with_(SAMPLES)
    + f"""SELECT 'benchmark' AS kind, CAST(doc_id AS STRING) AS record, CAST(item_id AS STRING) AS passage
  FROM documents, benchmark WHERE trim(benchmark.text) <> '' AND contains(documents.text, benchmark.text)
UNION ALL SELECT 'gold', sample_id, sample_id FROM (SELECT sample_id, gold_sql, question, {_LEAKY} FROM samples)
  WHERE contains(concat(question, chr(10), evidence), gold_sql)""",
)
def _(t: Tables):
    planted = c.contained_passages(t.documents, "doc_id", t.benchmark, "item_id").select(
        F.lit("benchmark").alias("kind"), F.col("doc_id").cast("string").alias("record"),
        F.col("item_id").cast("string").alias("passage"),
    )
    samples = inputs.samples(t).selectExpr("sample_id", "gold_sql", "question", _LEAKY)
    prompt = F.element_at(
        datasets.build_prompt(datasets.user_content(F.lit("TABLE t"), F.col("question"), F.col("evidence"))), 2
    )["content"]
    own = c.leaks(samples, "sample_id", prompt, F.col("gold_sql")).select(
        F.lit("gold").alias("kind"), F.col("sample_id").alias("record"), F.col("sample_id").alias("passage")
    )
    return planted.unionByName(own)


_WRAPS = {
    "opens_with_fence": "NOT starts_with(raw_output, concat('```sql', chr(10)))",
    "closes_with_fence": "NOT ends_with(raw_output, concat(chr(10), '```'))",
    "one_fence_pair": "len(regexp_extract_all(raw_output, '```')) <> 2",
    "inner_equals_gold": "substr(raw_output, 8, greatest(length(raw_output) - 11, 0)) <> gold_sql",
}


@query(
    "c12_completion_wrapping",
    with_(RAW)
    + " UNION ALL ".join(
        f"SELECT '{r}' AS rule, CAST(source_index AS STRING) AS key FROM raw_outputs WHERE {w}"
        for r, w in _WRAPS.items()
    ),
)
def _(t: Tables):
    rules = c.wrapping_rules(F.col("raw_output"), F.col("gold_sql"))
    return c.check_rows(inputs.raw_outputs(t), "source_index", rules)


_MESSAGES = """msgs AS (SELECT conv_id, list(role ORDER BY turn) AS roles,
  bool_and(trim(text) <> '') AS filled FROM conversations GROUP BY conv_id)"""
_MESSAGE_RULES = {
    "system_first": "roles[1] <> 'system'",
    "assistant_last": "roles[-1] <> 'assistant'",
    "user_before_assistant": "coalesce(roles[-2] <> 'user', true)",
    "one_assistant": "len(list_filter(roles, lambda r: r = 'assistant')) <> 1",
    "no_blank_content": "NOT filled",
}


@query(
    "c13_message_shape",
    with_(_MESSAGES)
    + " UNION ALL ".join(
        f"SELECT '{r}' AS rule, CAST(conv_id AS STRING) AS key FROM msgs WHERE {w}"
        for r, w in _MESSAGE_RULES.items()
    ),
)
def _(t: Tables):
    return c.message_shape(t.conversations, "conv_id", "turn", "role", "text")


@query(
    "c14_split_share",
    with_(SAMPLES)
    + """SELECT count(*) AS rows, count(*) FILTER (split = 'validation') AS inside,
  round(count(*) FILTER (split = 'validation') / count(*), 6) AS share,
  count(*) FILTER (split = 'validation') / count(*) BETWEEN 0.08 AND 0.12 AS passed FROM samples""",
)
def _(t: Tables):
    return c.split_share(inputs.samples(t), F.col("split") == "validation", 0.08, 0.12)


@query(
    "c15_gold_agreement",
    with_(SAMPLES, GOLD)
    + """, report AS (SELECT sample_id, CASE WHEN source_index % 5 = 0 THEN 'SELECT 0' ELSE gold_sql END
    AS gold_sql, CASE WHEN source_index % 7 = 0 THEN 'db_x' ELSE db_id END AS db_id FROM gold
    WHERE gold_status = 'success')
SELECT s.sample_id, CASE WHEN r.gold_sql IS NULL THEN 'missing_report'
  WHEN r.gold_sql <> s.gold_sql THEN 'gold_sql_mismatch' ELSE 'db_id_mismatch' END AS issue
FROM samples s LEFT JOIN report r ON r.sample_id = s.sample_id
WHERE r.gold_sql IS NULL OR r.gold_sql <> s.gold_sql OR r.db_id <> s.db_id""",
)
def _(t: Tables):
    report = inputs.gold(t).where("gold_status = 'success'").selectExpr(
        "sample_id",
        "CASE WHEN source_index % 5 = 0 THEN 'SELECT 0' ELSE gold_sql END AS gold_sql",
        "CASE WHEN source_index % 7 = 0 THEN 'db_x' ELSE db_id END AS db_id",
    )
    return c.gold_agreement(inputs.samples(t), report, "sample_id")


@query(
    "c16_monotonic_distribution",
    with_(LENGTHS)
    + """, d AS (SELECT db_id, quantile_disc(total_tokens, 0.5) AS p50,
    quantile_disc(total_tokens, 0.9) AS p90, quantile_disc(total_tokens, 0.95) AS p95,
    quantile_disc(total_tokens, 0.99) AS p99, max(total_tokens) - CASE WHEN count(*) % 2 = 0
    THEN 1 ELSE 0 END AS max FROM lengths GROUP BY db_id)
SELECT * FROM d WHERE NOT (p50 <= p90 AND p90 <= p95 AND p95 <= p99 AND p99 <= max)""",
)
def _(t: Tables):
    table = tokens.length_distribution(inputs.lengths(t), ["db_id"], ["total_tokens"])
    damaged = table.withColumn("max", F.col("max") - F.expr("if(sample_count % 2 = 0, 1, 0)"))
    return tokens.monotonic_violations(damaged).select("db_id", "p50", "p90", "p95", "p99", "max")


_REQ = (
    "conv_id * 1000 + turn AS request_id",
    "CASE WHEN role = 'system' THEN '  ' ELSE concat(' ', role, ' ') END AS db_id",
    "CASE WHEN turn % 5 = 4 THEN concat(chr(10), ' ') ELSE concat(text, ' ') END AS question",
    "CASE WHEN turn % 2 = 0 THEN NULL ELSE role END AS evidence",
)


@query(
    "c18_request_validation",
    f"""WITH r AS (SELECT {', '.join(_REQ)} FROM conversations),
s AS (SELECT request_id, regexp_replace(db_id, '^\\s+|\\s+$', '', 'g') AS db_id,
  regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS question,
  coalesce(trim(evidence), '') AS evidence FROM r)
SELECT * FROM s WHERE db_id <> '' AND question <> ''""",
)
def _(t: Tables):
    rows = t.conversations.selectExpr(*_REQ)
    return c.valid_requests(rows, "db_id", "question", "evidence")[0]
