"""Value index over table columns and BM25 retrieval of columns for a question."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut
from .ranks import first_per_group, top_per_group

# Defaults of the reference and of its text index.
SCAN_ROWS = 5000
MAX_UNIQUE = 500
MAX_CHARS = 128
TOP_COLUMNS = 8
VALUES_PER_COLUMN = 3
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6

COLUMN = ["table_name", "column_name"]
HIT_SCORE_DIGITS = 9


def _last_of_first(rows: DataFrame, lead: str, limit: int):
    """Largest leading key of the ``limit`` smallest, or None if there are fewer; Spark keeps
    ``limit`` keys per task."""
    first = rows.select(lead).where(F.col(lead).isNotNull()).orderBy(lead).limit(limit)
    n, last = first.agg(F.count("*"), F.max(lead)).first()
    return last if n >= limit else None


def key_bounds(df: DataFrame, lead: str, columns: Sequence[str], limit: int) -> dict[str, object]:
    """For each column a leading key, of any ordered type, up to which its first ``limit`` non-null
    values stand; None if there may be fewer.

    The bound of the rows holds for every column that is full enough up to it, which a count of the
    rows below it tells; a sparser column gets a bound of its own.
    """
    whole = _last_of_first(df, lead, limit)
    if whole is None:
        return dict.fromkeys(columns)
    below = df.where(F.col(lead) <= F.lit(whole)).agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    return {
        c: whole if below[c] >= limit else _last_of_first(df.where(F.col(c).isNotNull()), lead, limit) for c in columns
    }


def _cells(df: DataFrame, table: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(table_name, _key, column_name, value) for every non-null cell. Numeric keys have one type in
    all tables, so that the tables can be ranked together."""
    kinds = dict(df.dtypes)
    numeric = all(kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "decimal", "float", "double")) for c in order)
    key = F.array(*[F.col(c).cast("decimal(38,6)") for c in order]) if numeric else F.struct(*order)
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                for c in columns
            ]
        )
    )
    return (
        df.where(F.col(order[0]).isNotNull())
        .select(F.lit(table).alias("table_name"), key.alias("_key"), cells.alias("_cell"))
        .select("table_name", "_key", "_cell.*")
        .where(F.col("value").isNotNull())
    )


def scanned_cells(
    frames: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]], limit: int = SCAN_ROWS
) -> list[DataFrame]:
    """The cells among which the first ``limit`` of every column are, one frame per type of key.

    Bounds are literals in the filter of the scan, so row groups beyond them are not read.
    """
    used = {name: frame for name, frame in frames.items() if frame[2]}
    with ThreadPoolExecutor(4) as pool:  # small jobs that wait for each other otherwise
        bounds = list(pool.map(lambda f: key_bounds(f[0], f[1][0], f[2], limit), used.values()))
    kinds: dict[str, DataFrame] = {}
    for (name, (df, order, columns)), found in zip(used.items(), bounds):
        for bound in dict.fromkeys(found.values()):
            some = [c for c in columns if found[c] == bound]
            rows = df if bound is None else df.where(F.col(order[0]) <= F.lit(bound))
            part = _cells(rows, name, order, some)
            kind = part.schema["_key"].dataType.simpleString()
            kinds[kind] = kinds[kind].unionByName(part) if kind in kinds else part
    return list(kinds.values())


def scan_tables(
    frames: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]],
    limit: int = SCAN_ROWS,
) -> DataFrame:
    """First ``limit`` non-null values of every column, in key order.

    ``frames`` maps a table name to (frame, key columns of any ordered types, value columns). Only
    rows up to the bound of ``key_bounds`` are read and ranked; rows without a leading key are not
    scanned. The result is exact for any key distribution, which only changes how many rows are
    ranked.
    """
    ranked = None
    for cells in scanned_cells(frames, limit):
        some = first_per_group(cells, COLUMN, [F.col("_key")], limit, "scan_order")
        some = some.select(*COLUMN, "scan_order", "value")
        ranked = some if ranked is None else ranked.unionByName(some)
    # At most ``limit`` rows per column, read by several aggregates: kept once.
    return cut(ranked)


def bounded_scan(
    df: DataFrame, table: str, order: Sequence[str], columns: Sequence[str],
    limit: int = SCAN_ROWS,
) -> DataFrame:
    """``scan_tables`` for one table."""
    return scan_tables({table: (df, order, columns)}, limit)


def normalized_values(scanned: DataFrame, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """Scanned values on one line; blank and over-long ones dropped."""
    line = text.normalize_value(F.col("value"), max_chars)
    return scanned.withColumn("value", line).where(F.col("value").isNotNull())


def distinct_values(values: DataFrame, keys: Sequence[str] = COLUMN) -> DataFrame:
    """One row per case-folded value; the first spelling stays."""
    return (
        values.groupBy(*keys, text.casefold(F.col("value")).alias("_folded"))
        .agg(
            F.min_by("value", "scan_order").alias("value"),
            F.min("scan_order").alias("scan_order"),
        )
        .drop("_folded")
    )


def capped_values(
    distinct: DataFrame, keys: Sequence[str] = COLUMN, cap: int = MAX_UNIQUE
) -> DataFrame:
    """The first ``cap`` distinct values of each column, numbered."""
    return top_per_group(distinct, keys, [F.col("scan_order")], cap, "value_order")


def value_statistics(
    scanned: DataFrame, capped: DataFrame, keys: Sequence[str] = COLUMN, cap: int = MAX_UNIQUE
) -> DataFrame:
    """Per column: values indexed, and values read until the cap was reached."""
    read = scanned.groupBy(*keys).agg(F.max("scan_order").alias("_read"))
    kept = capped.groupBy(*keys).agg(
        F.count("*").alias("indexed_unique_values"),
        F.max(F.when(F.col("value_order") == cap, F.col("scan_order"))).alias("_stopped"),
    )
    return read.join(kept, list(keys), "left").select(
        *keys,
        F.coalesce("_stopped", "_read").cast("bigint").alias("scanned_values"),
        F.coalesce("indexed_unique_values", F.lit(0)).cast("bigint").alias("indexed_unique_values"),
    )


def index_statistics(columns: DataFrame, per_column: DataFrame) -> DataFrame:
    """One row of totals over the catalog columns and the indexed values."""
    totals = per_column.agg(
        F.sum("scanned_values").alias("scanned_value_count"),
        F.sum("indexed_unique_values").alias("indexed_unique_value_count"),
    )
    return columns.agg(
        F.count_distinct("db_id").alias("database_count"),
        F.count("*").alias("column_count"),
        F.count_if(text.is_value_type(F.col("declared_type"))).alias("value_column_count"),
    ).select(
        "*",
        totals.select("scanned_value_count").scalar().alias("scanned_value_count"),
        totals.select("indexed_unique_value_count").scalar().alias("indexed_unique_value_count"),
    )


def column_search_text(parts: Sequence[str]) -> Column:
    """Names and descriptions joined by blanks, empty parts left out."""
    filled = F.filter(
        F.array(*[F.coalesce(F.col(p), F.lit("")) for p in parts]), lambda x: x != ""
    )
    return F.array_join(filled, " ")


def index_rows(metadata: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metadata rows (search_text) and value rows (value) as one table of index rows."""
    meta = metadata.select(
        *keys, F.lit("metadata").alias("row_kind"), F.lit("").alias("value"), "search_text"
    )
    vals = values.select(
        *keys, F.lit("value").alias("row_kind"), "value", F.col("value").alias("search_text")
    )
    return meta.unionByName(vals)


def hit_limit(top_columns: int = TOP_COLUMNS) -> int:
    return max(256, top_columns * 64)


def column_hits(
    hits: DataFrame, rows: DataFrame, key: str, row_id: str,
    values_per_column: int = VALUES_PER_COLUMN,
) -> DataFrame:
    """Per question and column: best score and the first distinct matched values.

    ``hits`` holds at most ``hit_limit`` rows per question, which bounds every group here.
    They are materialised once, with digests in place of the values; whole values are
    fetched only for the few that are kept.
    """
    narrow = rows.select(
        row_id,
        *COLUMN,
        ((F.col("row_kind") == "value") & (F.col("value") != "")).alias("_valued"),
        F.xxhash64("value").alias("_value1"),
        F.xxhash64(F.lit(1), "value").alias("_value2"),
    )
    placed = cut(hits.join(narrow, row_id))
    best = placed.groupBy(key, *COLUMN).agg(F.min("score").alias("score"))
    first_seen = (
        placed.where("_valued")
        .groupBy(key, *COLUMN, "_value1", "_value2")
        .agg(F.min("hit_rank").alias("hit_rank"))
    )
    kept = (
        top_per_group(first_seen, [key, *COLUMN], [F.col("hit_rank")], values_per_column)
        .join(placed.select(key, "hit_rank", row_id), [key, "hit_rank"])
        .join(rows.select(row_id, "value"), row_id)
    )
    values = kept.groupBy(key, *COLUMN).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda v: v["value"]
        ).alias("matched_values")
    )
    return best.join(values, [key, *COLUMN], "left").withColumn(
        "matched_values", F.coalesce("matched_values", F.array().cast("array<string>"))
    )


def top_columns(hits: DataFrame, key: str, n: int = TOP_COLUMNS) -> DataFrame:
    """Best ``n`` columns per question by (score, table, column)."""
    order = [F.col("score"), F.col("table_name"), F.col("column_name")]
    return top_per_group(hits, [key], order, n, "position")


def grounding_line() -> Column:
    """Prompt line of one retrieved column."""
    name = F.concat(
        text.quote_identifier(F.col("table_name")),
        F.lit("."),
        text.quote_identifier(F.col("column_name")),
    )
    described = F.col("column_description")
    notes = F.col("value_description")
    quoted = F.transform(
        "matched_values",
        lambda v: F.regexp_replace(F.to_json(F.array(v)), r"(?s)\A\[(.*)\]\z", "$1"),
    )
    details = F.concat_ws(
        " | ",
        F.when(described != "", described),
        F.when((notes != "") & (notes != described), F.concat(F.lit("value notes: "), notes)),
        F.when(
            F.size("matched_values") > 0,
            F.concat(F.lit("matched values: "), F.array_join(quoted, ", ")),
        ),
    )
    head = F.concat(F.lit("- "), name)
    return F.when(details != "", F.concat(head, F.lit(": "), details)).otherwise(head)


def enrich(hits: DataFrame, column_info: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Add descriptions and the rendered line; ``hits`` carries the scope columns."""
    info = column_info.select(
        *scope, *COLUMN, "column_description", "value_description", "data_format"
    )
    return hits.join(info, [*scope, *COLUMN], "left").withColumn("line", grounding_line())


def coverage(samples: DataFrame, hits: DataFrame, key: str, split: str) -> DataFrame:
    """Per split: samples with and without hits, columns, values and their maxima."""
    per_sample = hits.groupBy(key).agg(
        F.count("*").alias("_columns"), F.sum(F.size("matched_values")).alias("_values")
    )
    joined = samples.join(per_sample, key, "left").fillna(0, ["_columns", "_values"])
    return joined.groupBy(split).agg(
        F.count("*").alias("sample_count"),
        F.count_distinct("db_id").alias("database_count"),
        F.count_if(F.col("_columns") > 0).alias("samples_with_grounding"),
        F.count_if(F.col("_columns") == 0).alias("samples_without_grounding"),
        F.sum("_columns").alias("retrieved_column_count"),
        F.sum("_values").alias("matched_value_count"),
        F.max("_columns").alias("maximum_columns_per_sample"),
        F.max("_values").alias("maximum_values_per_sample"),
    )

