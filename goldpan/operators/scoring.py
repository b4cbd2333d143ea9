"""Result-set comparison and partial credit.

Two executions match when their sets of rows are equal: row order, duplicates and column
names are ignored, column positions count, and NULL equals NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import set_f1

# Must equal the reference for matching results.
PARTIAL_WEIGHTS = {
    "executable": 0.10,
    "table_f1": 0.10,
    "column_f1": 0.15,
    "column_count_match": 0.05,
    "row_count_match": 0.05,
    "result_jaccard": 0.15,
    "incorrect_cap": 0.55,
}


def cell_key(c: Column, dtype: T.DataType) -> Column:
    """Text that is equal exactly when two result cells compare equal.

    Numbers share one family, so 1 and 1.0 agree while 1 and '1' do not.
    """
    if isinstance(dtype, T.BooleanType):
        return F.concat(F.lit("n:"), c.cast("int").cast("string"))
    if isinstance(dtype, T.IntegralType):
        return F.concat(F.lit("n:"), c.cast("string"))
    if isinstance(dtype, T.DecimalType):
        return F.concat(F.lit("n:"), _plain(c))
    if isinstance(dtype, T.FractionalType):
        d = c.cast("double")
        # A whole double is its integer up to 38 digits; another one is the decimal that its
        # shortest text stands for, if that decimal gives the same double back.
        whole = F.when((d == F.floor(d)) & (F.abs(d) < F.lit(1e37)), d.try_cast("decimal(38,0)"))
        exact = d.cast("string").try_cast("decimal(38,18)")
        exact = F.when(exact.cast("double") == d, exact)
        text = F.coalesce(whole.cast("string"), _plain(exact), d.cast("string"))
        return F.concat(F.lit("n:"), text)
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("b:"), F.hex(c))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.concat(F.lit("j:"), F.to_json(c))
    return F.concat(F.lit("s:"), c.cast("string"))


def _plain(c: Column) -> Column:
    """Decimal text without zeros after the last digit of the fraction, and without a sign at 0."""
    text = F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
    text = F.regexp_replace(text, r"\.$", "")
    return F.regexp_replace(text, r"^-(0(?:\.0*)?)$", "$1")


def row_key(df: DataFrame) -> Column:
    """Array of cell keys in column order, usable as a grouping key."""
    cells = [
        F.coalesce(cell_key(F.col(f"`{f.name}`"), f.dataType), F.lit("null"))
        for f in df.schema.fields
    ]
    return F.array(*cells)


def result_digest(df: DataFrame) -> DataFrame:
    """One row: row_count, distinct_rows and an order-free digest of the row set.

    Every column is read, so an expression that fails is not skipped.
    """
    keyed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    rows = keyed.select(row_key(keyed).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    left = F.sum(F.xxhash64("k").cast("decimal(38,0)"))
    right = F.sum(F.xxhash64(F.lit(1), "k").cast("decimal(38,0)"))
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.concat_ws(":", left.cast("string"), right.cast("string")), F.lit("")).alias(
            "result_key"
        ),
    )


def compare_row_sets(
    predicted: DataFrame, gold: DataFrame, pair: Sequence[str], cells: Sequence[str],
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Per pair: distinct rows of each side, of both, and of either; plus raw row counts.

    A pair with two empty results has no rows; it appears, with zero counts, if it is in ``pairs``.

    One grouping replaces a null-safe full join: sides are tagged, equal rows meet in one
    group, and each side is already reduced before the shuffle.
    """
    tagged = predicted.select(*pair, *cells, F.lit(1).alias("_p"), F.lit(0).alias("_g")).union(
        gold.select(*pair, *cells, F.lit(0).alias("_p"), F.lit(1).alias("_g"))
    )
    rows = tagged.groupBy(*pair, *cells).agg(
        F.sum("_p").alias("_p"), F.sum("_g").alias("_g")
    )
    counts = rows.groupBy(*pair).agg(
        F.count_if(F.col("_p") > 0).alias("predicted_rows"),
        F.count_if(F.col("_g") > 0).alias("gold_rows"),
        F.count_if((F.col("_p") > 0) & (F.col("_g") > 0)).alias("common_rows"),
        F.count("*").alias("union_rows"),
        F.sum("_p").alias("predicted_row_count"),
        F.sum("_g").alias("gold_row_count"),
    )
    if pairs is None:
        return counts
    measures = [c for c in counts.columns if c not in pair]
    return pairs.select(*pair).distinct().join(counts, list(pair), "left").fillna(0, measures)


def execution_match(counts: DataFrame) -> Column:
    """1 when the row sets of ``compare_row_sets`` are equal."""
    return (F.col("common_rows") == F.col("union_rows")).cast("int")


def result_jaccard() -> Column:
    union = F.col("union_rows")
    return F.when(union == 0, F.lit(1.0)).otherwise(F.col("common_rows") / union)


def frames_match(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Exact comparison of two arbitrary query results: one row (official_ex)."""
    if len(predicted.columns) != len(gold.columns):
        both = predicted.limit(1).select(F.lit(1).alias("x")).union(
            gold.limit(1).select(F.lit(1).alias("x"))
        )
        return both.agg(F.when(F.count("*") == 0, 1).otherwise(0).alias("official_ex"))
    sides = [
        df.toDF(*[f"c{i}" for i in range(len(df.columns))]) for df in (predicted, gold)
    ]
    keyed = [d.select(F.lit(0).alias("pair"), row_key(d).alias("k")) for d in sides]
    counts = compare_row_sets(keyed[0], keyed[1], ["pair"], ["k"])
    return counts.agg(
        F.coalesce(F.max(F.when(execution_match(counts) == 0, 0)), F.lit(1)).alias("official_ex")
    )


def folded(items: Column) -> Column:
    """Case-folded set of access-trace names."""
    return F.array_distinct(F.transform(items, lambda x: F.lower(x)))


def with_access_f1(df: DataFrame, predicted: str, gold: str, name: str) -> DataFrame:
    """Fold two access-trace arrays and add the F1 of the two sets."""
    sized = df.withColumns({c: folded(F.col(c)) for c in (predicted, gold)}).withColumn(
        "_overlap", F.size(F.array_intersect(predicted, gold))
    )
    f1 = set_f1(F.col("_overlap"), F.size(predicted), F.size(gold))
    return sized.withColumn(name, f1).drop("_overlap")


def partial_score(
    df: DataFrame, weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Screening score per pair.

    Expects status, official_ex, table_f1, column_f1, column_count / gold_column_count,
    row_count / gold_row_count and result_jaccard.
    """
    w = {**PARTIAL_WEIGHTS, **(weights or {})}
    ok = F.col("status") == "success"
    columns_agree = F.col("column_count") == F.col("gold_column_count")
    rows_agree = F.col("row_count") == F.col("gold_row_count")
    jaccard = F.when(columns_agree, F.col("result_jaccard")).otherwise(F.lit(0.0))
    earned = (
        F.lit(w["executable"])
        + w["table_f1"] * F.col("table_f1")
        + w["column_f1"] * F.col("column_f1")
        + w["column_count_match"] * columns_agree.cast("int")
        + w["row_count_match"] * rows_agree.cast("int")
        + w["result_jaccard"] * jaccard
    )
    score = (
        F.when(~ok, F.lit(0.0))
        .when(F.col("official_ex") == 1, F.lit(1.0))
        .otherwise(F.least(earned, F.lit(w["incorrect_cap"])))
    )
    zero = F.lit(0.0)
    return df.select(
        *[c for c in df.columns if c not in {"official_ex", "table_f1", "column_f1", "result_jaccard"}],
        F.round(score, 8).alias("screening_score"),
        F.when(ok, F.col("official_ex")).otherwise(0).alias("official_ex"),
        F.round(F.when(ok, F.col("table_f1")).otherwise(zero), 8).alias("table_f1"),
        F.round(F.when(ok, F.col("column_f1")).otherwise(zero), 8).alias("column_f1"),
        (ok & columns_agree).cast("int").alias("column_count_match"),
        (ok & rows_agree).cast("int").alias("row_count_match"),
        F.round(F.when(ok, jaccard).otherwise(zero), 8).alias("result_jaccard"),
    )


def score_predictions(
    annotations: DataFrame, predictions: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Join predictions to their gold rows and mark the ones that agree."""
    both_ok = (F.col("status") == "success") & (F.col("gold_status") == "success")
    same = F.col("result_key") == F.col("gold_key")
    return predictions.join(annotations, list(keys)).withColumn(
        "official_ex", F.coalesce(both_ok & same, F.lit(False)).cast("int")
    )
