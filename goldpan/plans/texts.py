"""Extraction, prompts, datasets and token arrays (family F and text helpers)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import datasets, tokens
from . import inputs
from .inputs import LENGTHS, RAW, SAMPLES, with_
from .registry import Tables, query

_STRIP = r"regexp_replace({}, '\A\s+|\s+\z', '', 'g')"
_FENCED = r"(?is)\A```sql[ \t]*\r?\n(.*?)\r?\n```\z"
_GENERIC = r"(?s)\A```[ \t]*\r?\n(.*?)\r?\n```\z"
_BODY = _STRIP.format("body")

#: Plain extraction of raw_outputs; needs RAW.
PLAIN_SQL = rf"""plain_ AS (SELECT *, {_STRIP.format('raw_output')} AS s FROM raw_outputs),
plain_body AS (SELECT *, CASE WHEN regexp_matches(s, '{_FENCED}') THEN 'sql_fence'
    WHEN regexp_matches(s, '{_GENERIC}') THEN 'generic_fence'
    WHEN regexp_matches(s, '(?i)\A(SELECT|WITH)\b') THEN 'raw_sql' ELSE 'failed' END AS form,
    CASE WHEN regexp_matches(s, '{_FENCED}') THEN regexp_extract(s, '{_FENCED}', 1)
    WHEN regexp_matches(s, '{_GENERIC}') THEN regexp_extract(s, '{_GENERIC}', 1) ELSE s END AS body
  FROM plain_),
plain_ok AS (SELECT *, form = 'raw_sql' OR (form LIKE '%fence' AND NOT contains(body, '```')
    AND {_BODY} <> '') AS ok FROM plain_body),
plain AS (SELECT source_index, conv_id, turn, gold_sql, raw_output,
    CASE WHEN ok THEN {_BODY} ELSE '' END AS predicted_sql,
    CASE WHEN ok THEN form ELSE 'failed' END AS extraction_status,
    ok AND form = 'sql_fence' AS format_compliance FROM plain_ok)"""


@query(
    "b23_one_line_and_quote",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS line_digest,
  '"' || replace(source || '"' || lang, '"', '""') || '"' AS quoted FROM documents""",
)
def _(t: Tables):
    name = F.concat("source", F.lit('"'), "lang")
    return t.documents.select(
        "doc_id",
        F.md5(text.one_line(F.col("text"))).alias("line_digest"),
        text.quote_identifier(name).alias("quoted"),
    )


_EXTRACT_COLUMNS = "source_index, predicted_sql, extraction_status, format_compliance"


@query("f01_extract_sql", with_(RAW, PLAIN_SQL) + f"SELECT {_EXTRACT_COLUMNS} FROM plain")
def _(t: Tables):
    return inputs.raw_outputs(t).select(
        "source_index", text.extract_sql(F.col("raw_output")).alias("x")
    ).select("source_index", "x.predicted_sql", "x.extraction_status", "x.format_compliance")


_THINK = (
    r"(?is)\A<think>\s*(.*?)\s*</think>\s*```sql[ \t]*\r?\n(.*?)\r?\n?```[ \t]*\z"
)
_FENCED2 = r"(?is)\A```sql[ \t]*\r?\n(.*?)\r?\n?```[ \t]*\z"
_GENERIC2 = r"(?s)\A```[ \t]*\r?\n(.*?)\r?\n?```[ \t]*\z"


def _group(pattern: str, n: int) -> str:
    return _STRIP.format(f"regexp_extract(s, '{pattern}', {n})")


REASONING_SQL = rf"""thought AS (SELECT *, {_STRIP.format('raw_output')} AS s FROM raw_outputs),
thought_parts AS (SELECT *, {_group(_THINK, 1)} AS r, {_group(_THINK, 2)} AS a,
    {_group(_FENCED2, 1)} AS b, {_group(_GENERIC2, 1)} AS c FROM thought),
thought_form AS (SELECT *, CASE
    WHEN r <> '' AND a <> '' AND NOT contains(r, '```') AND NOT contains(a, '```')
      THEN 'reasoning_sql_fence'
    WHEN b <> '' AND NOT contains(b, '```') THEN 'sql_fence'
    WHEN c <> '' AND NOT contains(c, '```') THEN 'generic_fence'
    WHEN regexp_matches(s, '(?i)\A(SELECT|WITH)\b') THEN 'raw_sql' ELSE 'failed' END AS form
  FROM thought_parts),
reasoned AS (SELECT source_index, CASE WHEN form = 'reasoning_sql_fence' THEN r ELSE '' END
    AS reasoning, CASE form WHEN 'reasoning_sql_fence' THEN a WHEN 'sql_fence' THEN b
    WHEN 'generic_fence' THEN c WHEN 'raw_sql' THEN s ELSE '' END AS predicted_sql,
    form AS extraction_status, form = 'reasoning_sql_fence' AS format_compliance
  FROM thought_form)"""


@query(
    "f02_extract_reasoning_sql",
    with_(RAW, REASONING_SQL) + f"SELECT reasoning, {_EXTRACT_COLUMNS} FROM reasoned",
)
def _(t: Tables):
    return inputs.raw_outputs(t).select(
        "source_index", text.extract_reasoning_sql(F.col("raw_output")).alias("x")
    ).select("source_index", "x.*")


_RATIONALE = r"""(?s)\A<RATIONALE>[ \t]*\r?\n(.+?)\r?\n</RATIONALE>\z"""
_PARSED = rf"""parsed AS (SELECT source_index, nullif({_STRIP.format(
    f"regexp_extract({_STRIP.format('teacher_output')}, '{_RATIONALE}', 1)")}, '') AS rationale
  FROM raw_outputs)"""


@query("f03_extract_rationale", with_(RAW, _PARSED) + "SELECT * FROM parsed")
def _(t: Tables):
    return inputs.raw_outputs(t).select(
        "source_index", text.extract_rationale(F.col("teacher_output")).alias("rationale")
    )


#: One schema text per database of the samples (derived from the orders themselves).
_SCHEMAS = """schemas AS (SELECT db_id, concat('TABLE "', db_id, '" with ', CAST(count(*) AS STRING),
  ' rows') AS schema FROM samples GROUP BY db_id)"""


def _schemas(t: Tables):
    return inputs.samples(t).groupBy("db_id").agg(
        F.concat(
            F.lit('TABLE "'), F.col("db_id"), F.lit('" with '),
            F.count("*").cast("string"), F.lit(" rows"),
        ).alias("schema")
    )


_CONTENT = """concat('Database schema:', chr(10), x.schema, {lines}
  CASE WHEN trim(s.evidence) <> '' THEN concat(chr(10), chr(10), 'Evidence:', chr(10),
  trim(s.evidence)) ELSE '' END, chr(10), chr(10), 'Question:', chr(10), trim(s.question))"""
_PLAIN_CONTENT = _CONTENT.format(lines="")
_SYSTEM_DIGEST = "md5('" + datasets.SYSTEM_PROMPT.replace("'", "''") + "')"


@query(
    "f04_prompt",
    with_(SAMPLES, _SCHEMAS)
    + f"""SELECT s.sample_id, {_PLAIN_CONTENT} AS user_content, {_SYSTEM_DIGEST} AS system_digest
FROM samples s JOIN schemas x ON x.db_id = s.db_id""",
)
def _(t: Tables):
    return datasets.build_plain(inputs.samples(t), _schemas(t)).select(
        "sample_id",
        F.element_at("prompt", 2)["content"].alias("user_content"),
        F.md5(F.element_at("prompt", 1)["content"]).alias("system_digest"),
    )


_COMPLETION = "concat('```sql', chr(10), {}, chr(10), '```')"


@query(
    "f05_completion",
    with_(SAMPLES) + f"SELECT sample_id, {_COMPLETION.format('gold_sql')} AS completion FROM samples",
)
def _(t: Tables):
    done = datasets.build_completion(F.col("gold_sql"))
    return inputs.samples(t).select("sample_id", done[0]["content"].alias("completion"))


@query(
    "f06_plain_dataset",
    with_(SAMPLES, _SCHEMAS)
    + f"""SELECT s.split, s.sample_id, s.source_index, s.db_id, md5({_PLAIN_CONTENT}) AS prompt_digest,
  {_COMPLETION.format('s.gold_sql')} AS completion
FROM samples s JOIN schemas x ON x.db_id = s.db_id""",
)
def _(t: Tables):
    return datasets.build_plain(inputs.samples(t), _schemas(t)).select(
        "split", "sample_id", "source_index", "db_id",
        F.md5(F.element_at("prompt", 2)["content"]).alias("prompt_digest"),
        F.element_at("completion", 1)["content"].alias("completion"),
    )


@query(
    "f06_missing_schema",
    with_(SAMPLES, _SCHEMAS)
    + """SELECT s.sample_id, s.db_id, 'missing_schema' AS issue FROM samples s
WHERE s.db_id NOT IN (SELECT db_id FROM schemas WHERE db_id NOT LIKE '%7')""",
)
def _(t: Tables):
    some = _schemas(t).where("db_id NOT LIKE '%7'")
    return datasets.without_schema(inputs.samples(t), some).select("sample_id", "db_id", "issue")


_TEACHER = """concat(content, chr(10), chr(10), 'Verified Gold SQL (reference only):', chr(10),
  '<GOLD_SQL>', chr(10), gold_sql, chr(10), '</GOLD_SQL>')"""


@query(
    "f08_teacher_message",
    with_(SAMPLES, _SCHEMAS)
    + f"""SELECT sample_id, {_TEACHER} AS teacher_user FROM (SELECT s.sample_id, s.gold_sql,
  {_PLAIN_CONTENT} AS content FROM samples s JOIN schemas x ON x.db_id = s.db_id)""",
)
def _(t: Tables):
    records = datasets.build_plain(inputs.samples(t), _schemas(t))
    return records.select(
        "sample_id", datasets.teacher_content(F.col("prompt"), F.col("gold_sql")).alias("teacher_user")
    )


@query(
    "f09_rationale_artifact",
    with_(RAW, _PARSED)
    + """SELECT source_index, rationale, CASE WHEN rationale IS NULL THEN 'fallback' ELSE 'success' END
  AS status FROM parsed""",
)
def _(t: Tables):
    return datasets.rationale_artifact(inputs.raw_outputs(t), "teacher_output").select(
        "source_index", "rationale", "status"
    )


@query(
    "f10_reasoning_dataset",
    with_(RAW, _PARSED)
    + f"""SELECT r.source_index, coalesce(p.rationale, '') AS reasoning_content,
  {_COMPLETION.format('r.gold_sql')} AS content,
  CASE WHEN p.rationale IS NULL THEN 'sql_only_fallback' ELSE 'teacher' END AS rationale_status
FROM raw_outputs r JOIN parsed p ON p.source_index = r.source_index""",
)
def _(t: Tables):
    raw = inputs.raw_outputs(t)
    artifacts = datasets.rationale_artifact(raw, "teacher_output")
    done = datasets.attach_rationales(
        raw.select("source_index", "gold_sql"), artifacts, ["source_index"]
    )
    return done.select(
        "source_index", F.inline("completion"), "rationale_status"
    ).drop("role")


@query(
    "f10_rationale_gaps",
    """WITH a AS (SELECT o_orderkey AS source_index, count(*) AS sources FROM orders GROUP BY 1),
b AS (SELECT l_orderkey AS source_index, count(*) AS artifacts FROM lineitem GROUP BY 1)
SELECT coalesce(a.source_index, b.source_index) AS source_index, coalesce(sources, 0) AS sources,
  coalesce(artifacts, 0) AS artifacts FROM a FULL JOIN b ON a.source_index = b.source_index
WHERE coalesce(sources, 0) <> 1 OR coalesce(artifacts, 0) <> 1""",
)
def _(t: Tables):
    return datasets.rationale_gaps(
        t.orders.selectExpr("o_orderkey AS source_index"),
        t.lineitem.selectExpr("l_orderkey AS source_index"),
        ["source_index"],
    )


@query(
    "f11_prediction_record",
    with_(SAMPLES, RAW, REASONING_SQL)
    + """SELECT r.source_index, s.db_id, s.difficulty, x.raw_output, r.predicted_sql,
  r.extraction_status, r.format_compliance FROM reasoned r
JOIN raw_outputs x ON x.source_index = r.source_index
JOIN samples s ON s.source_index = r.source_index""",
)
def _(t: Tables):
    found = text.extract_reasoning_sql(F.col("raw_output"))
    records = inputs.samples(t).select("source_index", "db_id", "difficulty")
    return (
        inputs.raw_outputs(t)
        .select("source_index", "raw_output", found.alias("x"))
        .select("source_index", "raw_output", "x.predicted_sql", "x.extraction_status", "x.format_compliance")
        .join(records, "source_index")
    )


def _echo_model(prompts: pd.Series, attempt: int) -> pd.DataFrame:
    """Deterministic stand-in for a model."""
    size = prompts.str.len()
    return pd.DataFrame(
        {
            "raw_output": "SELECT " + (size + attempt).astype(str),
            "completion_tokens": size.astype("int64") + attempt,
            "mean_logprob": -0.125 * attempt,
        }
    )


@query(
    "f12_generate_candidates",
    with_(SAMPLES)
    + """SELECT s.source_index, CAST(a AS INTEGER) AS candidate_index,
  CASE WHEN a = 0 THEN 'greedy' ELSE 'sampled' END AS kind,
  concat('SELECT ', CAST(length(s.question) + a AS STRING)) AS raw_output,
  length(s.question) + a AS completion_tokens, CAST(-0.125 * a AS DOUBLE) AS mean_logprob
FROM samples s, (SELECT unnest(range(4)) AS a)""",
)
def _(t: Tables):
    return datasets.generate_candidates(
        inputs.samples(t), "source_index", "question", _echo_model, 3
    )


@query(
    "f13_mean_logprob",
    """SELECT vec_id, round(list_avg(list_filter(embedding::DOUBLE[], lambda x: x < 0.2)), 6)
  AS mean_logprob FROM embeddings""",
)
def _(t: Tables):
    entries = F.transform(
        "embedding",
        lambda x: F.when(x.cast("double") < 0.2, x.cast("double")).otherwise(F.lit(float("-inf"))),
    )
    return t.embeddings.select("vec_id", F.round(arrays.mean_finite(entries), 6).alias("mean_logprob"))


@query(
    "f14_token_counts",
    with_(LENGTHS)
    + """SELECT source_index, prompt_tokens, CAST(len(regexp_extract_all(db_id, '[\\p{L}\\p{N}]+')) AS BIGINT)
  AS completion_tokens, prompt_tokens + CAST(len(regexp_extract_all(db_id, '[\\p{L}\\p{N}]+')) AS BIGINT)
  AS total_tokens FROM lengths""",
)
def _(t: Tables):
    counted = tokens.token_counts(t.documents, F.col("text"), F.col("source"))
    return counted.select(
        F.col("doc_id").alias("source_index"), "prompt_tokens", "completion_tokens", "total_tokens"
    )


#: Token arrays of conversation turns: word lengths stand in for ids; the prompt part is the
#: first (turn + 1) tokens, spoilt in every fifth conversation.
_TOKEN_ROWS = r"""toks AS (SELECT conv_id * 1000 + turn AS source_index,
    [CAST(length(w) AS BIGINT) for w in regexp_extract_all(text, '[\p{L}\p{N}]+')] AS full_, turn,
    conv_id FROM conversations),
tokrows AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN [CAST(99 AS BIGINT)] || full_[2:turn + 1]
    ELSE full_[1:turn + 1] END AS prompt_ FROM toks)"""


def _token_rows(t: Tables):
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    ids = F.transform(words, lambda w: F.length(w).cast("bigint"))
    rows = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("source_index"),
        ids.alias("full_"), F.col("turn").cast("int").alias("turn"), "conv_id",
    )
    good = F.slice("full_", F.lit(1), F.col("turn") + 1)
    bad = F.concat(F.array(F.lit(99).cast("bigint")), F.slice("full_", F.lit(2), F.col("turn")))
    return rows.withColumn("prompt_", F.when(F.col("conv_id") % 5 == 0, bad).otherwise(good))


_LABELLED = """labelled AS (SELECT *, len(full_) > len(prompt_) AND full_[1:len(prompt_)] = prompt_ AS good,
    [CAST(-100 AS BIGINT) for x in prompt_] || full_[len(prompt_) + 1:] AS labels FROM tokrows)"""


@query(
    "f15_completion_labels",
    with_(_TOKEN_ROWS, _LABELLED)
    + """SELECT source_index, good AS is_prefix, array_to_string(labels, ' ') AS labels,
  CAST(len(list_filter(labels[2:], lambda x: x <> -100)) AS INTEGER) AS supervised_tokens
FROM labelled""",
)
def _(t: Tables):
    prompt, full = F.col("prompt_"), F.col("full_")
    return _token_rows(t).withColumn("labels", arrays.completion_labels(prompt, full)).select(
        "source_index",
        arrays.is_strict_prefix(prompt, full).alias("is_prefix"),
        F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"),
        arrays.supervised_count(F.col("labels")).alias("supervised_tokens"),
    )


@query(
    "f16_trim_at_end",
    with_(_TOKEN_ROWS)
    + """, ends AS (SELECT source_index, full_, list_min([x for x in [nullif(coalesce(list_position(full_, 9), 0), 0),
    nullif(coalesce(list_position(full_, 11), 0), 0)] if x IS NOT NULL]) AS p FROM tokrows)
SELECT source_index, array_to_string(CASE WHEN p IS NULL THEN full_ ELSE full_[1:p] END, ' ') AS kept,
  p IS NULL AS truncated, CAST(coalesce(p, 0) AS BIGINT) AS mask_sum FROM ends""",
)
def _(t: Tables):
    trimmed = arrays.trim_at_end(F.col("full_"), [9, 11])
    mask = arrays.completion_mask(F.col("full_"), [9, 11])
    total = F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _token_rows(t).select(
        "source_index",
        F.array_join(trimmed["tokens"].cast("array<string>"), " ").alias("kept"),
        trimmed["truncated"].alias("truncated"),
        total.alias("mask_sum"),
    )


@query(
    "f17_batch_padding",
    with_(_TOKEN_ROWS, _LABELLED)
    + """SELECT conv_id // 4 AS batch, count(*) AS batch_size, max(len(full_)) AS padded_length,
  CAST(sum(len(full_)) AS BIGINT) AS sequence_tokens, CAST(sum(len(prompt_)) AS BIGINT) AS prompt_tokens,
  CAST(sum(len(list_filter(labels[2:], lambda x: x <> -100))) AS BIGINT) AS supervised_tokens,
  CAST(max(len(full_)) * count(*) - sum(len(full_) - len(prompt_)) AS BIGINT) AS masked_tokens
FROM labelled GROUP BY 1""",
)
def _(t: Tables):
    rows = _token_rows(t).select(
        "conv_id",
        F.size("full_").alias("length"),
        F.size("prompt_").alias("prompt"),
        arrays.supervised_count(
            arrays.completion_labels(F.col("prompt_"), F.col("full_"))
        ).alias("supervised"),
    )
    return tokens.padding_statistics(rows, F.expr("conv_id div 4"), "length", "prompt", "supervised")


@query(
    "f18_length_limit",
    with_(LENGTHS)
    + """SELECT source_index, prompt_tokens, prompt_tokens + 200 <= 1024 AS fits FROM lengths""",
)
def _(t: Tables):
    fits, rejected = tokens.within_context(inputs.lengths(t), 1024, 200)
    return (
        fits.withColumn("fits", F.lit(True))
        .unionByName(rejected.withColumn("fits", F.lit(False)))
        .select("source_index", "prompt_tokens", "fits")
    )
