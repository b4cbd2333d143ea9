"""Prompt and completion datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The prompt wording must equal the reference.
SYSTEM_PROMPT = (
    "You are an expert SQLite query generator.\n\n"
    "Given a database schema, optional evidence, relevant database information, and a "
    "question, reason briefly about tables, joins, filters, aggregation, and ordering, then "
    "generate one valid read-only SQLite query.\n\n"
    "Return exactly one <think>...</think> block followed by one SQL code block and no other "
    "text."
)


def user_content(
    schema: Column, question: Column, evidence: Column, relevant_lines: Column | None = None
) -> Column:
    """Prompt sections joined by blank lines; empty sections are left out."""
    evidence = text.strip(F.coalesce(evidence, F.lit("")))
    sections = [F.concat(F.lit("Database schema:\n"), schema)]
    if relevant_lines is not None:
        block = F.concat(
            F.lit("Relevant database information:\n"), F.array_join(relevant_lines, "\n")
        )
        sections.append(F.when(F.size(relevant_lines) > 0, block))
    sections.append(F.when(evidence != "", F.concat(F.lit("Evidence:\n"), evidence)))
    sections.append(F.concat(F.lit("Question:\n"), text.strip(question)))
    return F.concat_ws("\n\n", *sections)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_prompt(content: Column, system: str = SYSTEM_PROMPT) -> Column:
    return F.array(message("system", F.lit(system)), message("user", content))


def build_completion(gold_sql: Column) -> Column:
    return F.array(message("assistant", text.wrap_sql(gold_sql)))


def build_plain(samples: DataFrame, schema_text: DataFrame) -> DataFrame:
    """Samples with their prompt and completion; ``schema_text`` has db_id and schema.

    Adaptive execution broadcasts ``schema_text`` only when it measures small.
    """
    content = user_content(F.col("schema"), F.col("question"), F.col("evidence"))
    return (
        samples.join(schema_text, "db_id")
        .withColumn("prompt", build_prompt(content))
        .withColumn("completion", build_completion(F.col("gold_sql")))
        .drop("schema")
    )


def without_schema(samples: DataFrame, schema_text: DataFrame) -> DataFrame:
    """The samples that neither builder can give a prompt: no schema text of their database."""
    return samples.join(schema_text, "db_id", "left_anti").withColumn("issue", F.lit("missing_schema"))


def build_grounded(samples: DataFrame, schema_text: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """As ``build_plain`` with the retrieved lines; ``hits`` holds (key, position, line).

    At most ``top_columns`` hits exist per sample, so the collected array is short.
    """
    lines = hits.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "line"))), lambda h: h["line"]
        ).alias("grounding")
    )
    joined = (
        samples.join(schema_text, "db_id")
        .join(lines, key, "left")
        .withColumn("grounding", F.coalesce("grounding", F.array().cast("array<string>")))
    )
    content = user_content(
        F.col("schema"), F.col("question"), F.col("evidence"), F.col("grounding")
    )
    return (
        joined.withColumn("prompt", build_prompt(content))
        .withColumn("completion", build_completion(F.col("gold_sql")))
        .drop("schema")
    )


def teacher_content(prompt: Column, gold_sql: Column) -> Column:
    """User message of the rationale request."""
    return F.concat(
        F.element_at(prompt, 2)["content"],
        F.lit("\n\nVerified Gold SQL (reference only):\n<GOLD_SQL>\n"),
        gold_sql,
        F.lit("\n</GOLD_SQL>"),
    )


def rationale_artifact(df: DataFrame, raw: str) -> DataFrame:
    """Parsed rationale and whether a fallback is needed."""
    rationale = text.extract_rationale(F.col(raw))
    return df.withColumn("rationale", rationale).withColumn(
        "status", F.when(rationale.isNotNull(), "success").otherwise("fallback")
    )


def rationale_gaps(sources: DataFrame, artifacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identities present on one side only, or more than once."""
    a = sources.groupBy(*keys).agg(F.count("*").alias("sources"))
    b = artifacts.groupBy(*keys).agg(F.count("*").alias("artifacts"))
    return (
        a.join(b, list(keys), "full_outer")
        .select(
            *keys,
            F.coalesce("sources", F.lit(0)).cast("bigint").alias("sources"),
            F.coalesce("artifacts", F.lit(0)).cast("bigint").alias("artifacts"),
        )
        .where((F.col("sources") != 1) | (F.col("artifacts") != 1))
    )


def attach_rationales(sources: DataFrame, artifacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reasoning dataset: completion with reasoning text, empty for fallbacks."""
    reasoning = F.coalesce("rationale", F.lit(""))
    return (
        sources.join(artifacts.select(*keys, "rationale"), list(keys))
        .withColumn(
            "completion",
            F.array(
                F.struct(
                    F.lit("assistant").alias("role"),
                    reasoning.alias("reasoning_content"),
                    text.wrap_sql(F.col("gold_sql")).alias("content"),
                )
            ),
        )
        .withColumn(
            "rationale_status",
            F.when(F.col("rationale").isNotNull(), "teacher").otherwise("sql_only_fallback"),
        )
        .drop("rationale")
    )


def reward_manifest(
    records: DataFrame, audit: DataFrame, key: str, timeout_ms: float, max_rows: int
) -> DataFrame:
    """Train records with their gold run and the first reason that excludes them."""
    from .audit import exclusion_reason

    run = audit.select(key, "usable", "status", "empty_result", "elapsed_ms", "row_count")
    return (
        records.join(run, key)
        .withColumn("exclusion_reason", exclusion_reason(timeout_ms, max_rows))
        .withColumn("reward_eligible", F.col("exclusion_reason").isNull())
    )


def generate_candidates(
    prompts: DataFrame,
    key: str,
    prompt: str,
    model: Callable[[pd.Series, int], pd.DataFrame],
    sampled: int,
    include_greedy: bool = True,
) -> DataFrame:
    """Run a caller-supplied model over Arrow batches of prompts.

    ``model(prompts, attempt)`` returns raw_output, completion_tokens and mean_logprob for a
    batch; attempt 0 is the greedy one. Candidates come out long: one row per attempt.
    """
    attempts = list(range(0 if include_greedy else 1, sampled + 1))
    kind = dict(prompts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for attempt in attempts:
                out = model(batch[prompt], attempt)
                out.insert(0, key, batch[key].to_numpy())
                out.insert(1, "candidate_index", attempt)
                out.insert(2, "kind", "greedy" if attempt == 0 else "sampled")
                yield out

    schema = (
        f"{key} {kind}, candidate_index int, kind string, raw_output string, "
        "completion_tokens bigint, mean_logprob double"
    )
    return prompts.select(key, prompt).mapInPandas(run, schema)
