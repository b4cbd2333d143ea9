"""Dataset constraints. Every check returns the rows that break it.

Violations carry the rule name and the key of the offending row as text, so that frames
from different checks can be united and counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import strip
from ..session import cut
from . import bitmaps
from .ranks import with_position


def check_rows(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row (rule, key) per rule that a record fails. Null counts as a failure."""
    failures = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
        lambda r: r.isNotNull(),
    )
    return df.select(F.explode(failures).alias("rule"), F.col(key).cast("string").alias("key"))


def passed(violations: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Pass / fail and the violation count for each named rule."""
    spark = violations.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule"))
    counts = violations.groupBy("rule").agg(F.count("*").alias("violations"))
    return names.join(counts, "rule", "left").select(
        "rule",
        F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"),
        F.col("violations").isNull().alias("passed"),
    )


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (strip(c) != "")


def one_of(c: Column, allowed: Sequence[str]) -> Column:
    return c.isin(list(allowed))


def row_counts(df: DataFrame, split: str, expected: Mapping[str, int]) -> DataFrame:
    """Actual against expected rows per split, both directions."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(expected.items()), f"{split} string, expected bigint")
    actual = df.groupBy(split).agg(F.count("*").alias("actual"))
    return (
        actual.join(wanted, split, "full_outer")
        .select(
            split,
            F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"),
            F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"),
        )
        .withColumn("passed", F.col("expected") == F.col("actual"))
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def contiguous_range(df: DataFrame, key: str, n: int) -> DataFrame:
    """Ids missing from, or outside of, 0..n-1.

    Ids shrink to bitmaps of 32,768 before the shuffle; only buckets that are not full are looked
    into. Nulls are unexpected; an id is named once however often it occurs.
    """
    inside = F.col(key).between(0, n - 1)
    shifted = df.where(inside).select((F.col(key) + 1).cast("bigint").alias("id"))  # buckets count from 1
    seen = bitmaps.build(shifted, "id", {"seen": F.lit(True)})
    buckets = df.sparkSession.range(1, -(-n // bitmaps.BITS) + 1).withColumnRenamed("id", "bucket")
    gaps = buckets.join(seen, "bucket", "left").where(
        F.col("seen").isNull() | (F.bitmap_count("seen") < bitmaps.BITS)
    )
    # The bits that should be set and are not, with all of an absent bucket.
    absent = F.coalesce("seen", F.unhex(F.repeat(F.lit("00"), F.lit(bitmaps.BITS // 8))))
    every = F.unhex(F.repeat(F.lit("FF"), F.lit(bitmaps.BITS // 8)))
    words = bitmaps.words(gaps.select("bucket", absent.alias("seen"), every.alias("all")), ["seen", "all"])
    lacking = bitmaps.ids(F.col("all").bitwiseAND(F.bitwise_not("seen")))
    missing = words.select(F.explode(lacking).alias("id")).select((F.col("id") - 1).alias("id")).where(F.col("id") < n)
    unexpected = df.where(inside.isNull() | ~inside).select(F.col(key).cast("bigint").alias("id")).distinct()
    return missing.withColumn("issue", F.lit("missing")).unionByName(
        unexpected.withColumn("issue", F.lit("unexpected"))
    )


def json_type(raw: Column, path: str) -> Column:
    """Type of the value at a path of a JSON text, as it is written: integer (not 1.0, not true),
    float, boolean, string, null, array, object; 'missing' without the path, 'malformed' if the text
    is no JSON, null texts included. Whole numbers beyond 64 bits are integers."""
    whole = F.try_parse_json(raw)
    found = F.schema_of_variant(F.try_variant_get(whole, path, "variant"))
    return (
        F.when(whole.isNull(), "malformed")
        .when(found.isNull(), "missing")
        .when(found == "BIGINT", "integer")
        .when(found.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer")
        .when((found == "DOUBLE") | F.startswith(found, F.lit("DECIMAL")), "float")
        .when(found == "BOOLEAN", "boolean")
        .when(found == "STRING", "string")
        .when(found == "VOID", "null")
        .when(F.startswith(found, F.lit("ARRAY")), "array")
        .otherwise("object")
    )


def record_types(df: DataFrame, key: str, raw: Column, expected: Mapping[str, str]) -> DataFrame:
    """(key, path, expected, found) of every value in raw JSON records that has another type than
    the contract says; a fixed schema would turn 1.0 or true into what it expects."""
    checks = F.array(
        *[F.struct(F.lit(p).alias("path"), F.lit(e).alias("expected"), json_type(raw, p).alias("found")) for p, e in expected.items()]
    )
    return df.select(key, F.inline(F.filter(checks, lambda c: c["found"] != c["expected"])))


def positional_order(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows whose id differs from their position."""
    return with_position(df, *order).where(F.col("position") != F.col(key))


def field_set(df: DataFrame, key: str, raw: Column, expected: Sequence[str]) -> DataFrame:
    """JSON records whose keys are not exactly the contract: missing and extra names."""
    wanted = F.array(*[F.lit(n) for n in expected])
    names = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return df.select(
        F.col(key),
        F.array_join(F.array_sort(F.array_except(wanted, names)), ",").alias("missing"),
        F.array_join(F.array_sort(F.array_except(names, wanted)), ",").alias("extra"),
    ).where((F.col("missing") != "") | (F.col("extra") != ""))


def reference_match(
    predictions: DataFrame, annotations: DataFrame, key: str, field: str
) -> DataFrame:
    """Unknown ids, uncovered annotations and rows whose ``field`` disagrees."""
    known = annotations.select(key, F.col(field).alias("_expected"))
    checked = predictions.select(key, field).join(known, key, "left")
    wrong = checked.select(
        key,
        F.when(F.col("_expected").isNull(), "unknown_id")
        .when(F.col("_expected") != F.col(field), "field_mismatch")
        .alias("issue"),
    ).where(F.col("issue").isNotNull())
    # Distinct first: a repeated id must not weigh on one task of the anti join.
    uncovered = known.join(predictions.select(key).distinct(), key, "left_anti").select(
        key, F.lit("missing_prediction").alias("issue")
    )
    return wrong.unionByName(uncovered)


def extraction_consistency() -> dict[str, Column]:
    """Compliance goes with the sql fence; a failed extraction has no statement."""
    status, sql = F.col("extraction_status"), F.col("predicted_sql")
    return {
        "compliance_matches_status": F.col("format_compliance") == (status == "sql_fence"),
        "failed_has_no_sql": (status == "failed") == (strip(sql) == ""),
    }


def rederived(df: DataFrame, key: str, stored: Mapping[str, Column]) -> DataFrame:
    """Records whose stored values differ from the recomputed ones, nulls being equal."""
    return check_rows(df, key, {n: F.col(n).eqNullSafe(c) for n, c in stored.items()})


STATUSES = ["success", "timeout", "execution_error", "unsafe_sql", "row_limit"]


def execution_shape(zero_on_failure: bool = True) -> dict[str, Column]:
    """Rules an execution record must satisfy.

    A capped run reports the rows it had seen, so ``row_limit`` keeps its counts.
    """
    ok = F.col("status") == "success"
    capped = F.col("status") == "row_limit"
    error = F.col("error_type")
    rules = {
        "known_status": F.col("status").isin(STATUSES),
        "row_count_not_negative": F.col("row_count") >= 0,
        "column_count_not_negative": F.col("column_count") >= 0,
        "elapsed_is_finite": (F.col("elapsed_ms") >= 0)
        & ~F.isnan("elapsed_ms")
        & (F.col("elapsed_ms") < F.lit(float("inf"))),
        "success_has_no_error": ~ok | error.isNull(),
        "failure_has_error": ok | error.isNotNull(),
        "empty_flag_agrees": ~ok | (F.col("empty_result") == (F.col("row_count") == 0)),
    }
    if zero_on_failure:
        rules["failure_has_zero_shape"] = (
            ok | capped | ((F.col("row_count") == 0) & (F.col("column_count") == 0) & ~F.col("empty_result"))
        )
    return rules


def leaks(df: DataFrame, key: str, prompt: Column, gold: Column) -> DataFrame:
    """Records whose prompt contains their own gold text."""
    return df.where(F.contains(prompt, gold)).select(key)


#: Words of a run by which passages and texts meet.
ANCHOR_WORDS = 3


def _runs(tokens: Column, words: int) -> Column:
    """Digests of all runs of ``words`` neighbouring tokens."""
    starts = F.sequence(F.lit(1), F.size(tokens) - words + 1)
    runs = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, words), " ")))
    return F.when(F.size(tokens) >= words, runs).otherwise(F.array().cast("array<bigint>"))


def contained_passages(
    texts: DataFrame, text_id: str, passages: DataFrame, passage_id: str, text: str = "text",
    words: int = ANCHOR_WORDS,
) -> DataFrame:
    """(text_id, passage_id) of every whole passage that stands in a text, exactly as written.

    The first and last word of a passage may be parts of longer words in a text; all words between
    them, cut at blanks and line ends, are words of the text too. So each passage is sought by the
    one run of ``words`` of its inner words that is rarest in the texts, counted over all of them;
    only texts with this run meet the passage, and the whole passage is then compared in place.
    Null and blank passages stand nowhere. Passages with fewer inner words are sought by runs of as
    many words as they have; those without any inner word are left out and listed by
    ``short_passages``. Ids are unique in their table.
    """
    inner = F.slice("_words", F.lit(2), F.greatest(F.size("_words") - 2, F.lit(0)))
    cut_up = passages.where(F.trim(text) != "").select(passage_id, F.col(text).alias("_passage"), _words(text).alias("_words"))
    known = cut_up.select(passage_id, "_passage", inner.alias("_inner"))
    known = known.where(F.size("_inner") > 0).withColumn("_size", F.least(F.size("_inner"), F.lit(words)))
    known = cut(known)
    kinds = [frame.schema[name] for frame, name in ((texts, text_id), (passages, passage_id))]
    found = texts.sparkSession.createDataFrame([], StructType(kinds))
    for (size,) in known.select("_size").distinct().collect():  # at most ``words`` rows
        some = known.where(F.col("_size") == size).select(
            passage_id, F.explode(F.array_distinct(_runs(F.col("_inner"), size))).alias("_run")
        )
        # Cut first: an expression inside the runs would be cut anew for each of them.
        held = texts.select(text_id, _words(text).alias("_words")).where(F.size("_words") >= size)
        held = held.select(text_id, F.explode(F.array_distinct(_runs(F.col("_words"), size))).alias("_run"))
        held = cut(held.join(some.select("_run").distinct(), "_run", "left_semi"))
        counts = held.groupBy("_run").agg(F.count("*").alias("_texts"))
        rarest = some.join(counts, "_run", "left").groupBy(passage_id).agg(
            F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("_texts"), "_run")).alias("_rare")
        )
        pairs = held.join(rarest.select(passage_id, "_rare._run"), "_run").select(text_id, passage_id)
        found = found.unionByName(pairs)
    whole = found.join(known.select(passage_id, "_passage"), passage_id).join(
        texts.select(text_id, F.col(text).alias("_text")), text_id
    )
    return whole.where(F.contains("_text", F.col("_passage"))).select(text_id, passage_id).distinct()


def _words(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), r"\s+")


def short_passages(passages: DataFrame, passage_id: str, text: str = "text") -> DataFrame:
    """Passages that ``contained_passages`` leaves out, since they have no inner word."""
    return passages.where((F.trim(text) != "") & (F.size(_words(text)) < 3)).select(passage_id)


def wrapping_rules(content: Column, gold: Column) -> dict[str, Column]:
    """One fence pair around exactly the gold statement."""
    body = F.substr(content, F.lit(8), F.length(content) - 11)
    return {
        "opens_with_fence": F.startswith(content, F.lit("```sql\n")),
        "closes_with_fence": F.endswith(content, F.lit("\n```")),
        "one_fence_pair": F.regexp_count(content, F.lit("```")) == 2,
        "inner_equals_gold": body == gold,
    }


def message_rules(messages: Column) -> dict[str, Column]:
    """System first, user last before one assistant, nothing blank."""
    roles = F.transform(messages, lambda m: m["role"])
    return {
        "system_first": F.element_at(roles, 1) == "system",
        "assistant_last": F.element_at(roles, -1) == "assistant",
        "user_before_assistant": F.try_element_at(roles, F.lit(-2)) == "user",
        "one_assistant": F.size(F.filter(roles, lambda r: r == "assistant")) == 1,
        "no_blank_content": F.forall(messages, lambda m: not_blank(m["content"])),
    }


def message_shape(turns: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """``message_rules`` for one row per message.

    Aggregates only: no conversation is ever gathered into one row.
    """
    last = turns.groupBy(key).agg(F.max(order).alias("_last"))
    ends = turns.groupBy(key).agg(
        F.min_by(role, order).alias("_first_role"),
        F.max_by(role, order).alias("_last_role"),
        F.count_if(F.col(role) == "assistant").alias("_assistants"),
        F.bool_and(not_blank(F.col(content))).alias("_filled"),
    )
    before = (
        turns.join(last, key)
        .where(F.col(order) < F.col("_last"))
        .groupBy(key)
        .agg(F.max_by(role, order).alias("_before_role"))
    )
    rules = {
        "system_first": F.col("_first_role") == "system",
        "assistant_last": F.col("_last_role") == "assistant",
        "user_before_assistant": F.col("_before_role") == "user",
        "one_assistant": F.col("_assistants") == 1,
        "no_blank_content": F.col("_filled"),
    }
    return check_rows(ends.join(before, key, "left"), key, rules)


def split_share(df: DataFrame, inside: Column, low: float, high: float) -> DataFrame:
    """Share of the rows matching ``inside`` and whether it lies within the bounds."""
    share = F.count_if(inside) / F.count("*")
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(inside).alias("inside"),
        F.round(share, 6).alias("share"),
        ((share >= low) & (share <= high)).alias("passed"),
    )


def gold_agreement(records: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """Records whose gold report names another statement or database."""
    other = report.select(key, F.col("gold_sql").alias("_sql"), F.col("db_id").alias("_db"))
    return (
        records.join(other, key, "left")
        .select(
            key,
            F.when(F.col("_sql").isNull(), "missing_report")
            .when(F.col("_sql") != F.col("gold_sql"), "gold_sql_mismatch")
            .when(F.col("_db") != F.col("db_id"), "db_id_mismatch")
            .alias("issue"),
        )
        .where(F.col("issue").isNotNull())
    )


def valid_requests(df: DataFrame, db: str, question: str, evidence: str) -> tuple[DataFrame, DataFrame]:
    """Trimmed requests with defaulted evidence, and the rejected rest."""
    trimmed = df.withColumns(
        {
            db: strip(F.coalesce(F.col(db), F.lit(""))),
            question: strip(F.coalesce(F.col(question), F.lit(""))),
            evidence: strip(F.coalesce(F.col(evidence), F.lit(""))),
        }
    )
    good = (F.col(db) != "") & (F.col(question) != "")
    return trimmed.where(good), trimmed.where(~good)
