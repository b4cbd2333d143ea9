"""Inputs of the registered queries, derived from the given tables.

Each input is a list of (expression, name) pairs over one table. The same text runs in
Spark (``selectExpr``) and in the checking SQL, so both sides start from equal rows.
All rows of the table are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

NL = "chr(10)"


def _sql(name: str, table: str, pairs: list[tuple[str, str]]) -> str:
    columns = ",\n  ".join(f"{expr} AS {alias}" for expr, alias in pairs)
    return f"{name} AS (SELECT {columns} FROM {table})"


def _df(source: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return source.selectExpr(*[f"{expr} AS {alias}" for expr, alias in pairs])


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def padded(column: str) -> str:
    text = f"CAST({column} AS STRING)"
    return f"concat('train_', repeat('0', greatest(0, 6 - length({text}))), {text})"


_SAMPLES = [
    ("o_orderkey", "source_index"),
    (padded("o_orderkey"), "sample_id"),
    ("concat('db_', CAST(o_custkey % 69 AS STRING))", "db_id"),
    ("o_orderpriority", "question"),
    ("CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END", "evidence"),
    ("concat('SELECT ', CAST(o_orderkey AS STRING))", "gold_sql"),
    ("CASE WHEN o_custkey % 69 < 7 THEN 'validation' ELSE 'train' END", "split"),
    (
        "CASE o_orderkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END",
        "difficulty",
    ),
]
SAMPLES = _sql("samples", "orders", _SAMPLES)


def samples(t: Tables) -> DataFrame:
    return _df(t.orders, _SAMPLES)


_GOLD = [
    ("o_orderkey", "source_index"),
    (padded("o_orderkey"), "sample_id"),
    ("concat('db_', CAST(o_custkey % 69 AS STRING))", "db_id"),
    ("concat('SELECT ', CAST(o_orderkey AS STRING))", "gold_sql"),
    (
        "concat('N', CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END)",
        "gold_key",
    ),
    (
        "CASE WHEN o_totalprice < 10000 THEN 'timeout' "
        "WHEN o_totalprice < 20000 THEN 'execution_error' ELSE 'success' END",
        "gold_status",
    ),
    ("o_totalprice >= 20000 AND o_totalprice < 30000", "gold_empty"),
    ("CAST(o_custkey * 7 % 12000 AS BIGINT)", "gold_row_count"),
    ("CAST(o_custkey % 6000 AS DOUBLE)", "gold_elapsed_ms"),
    (
        "CASE o_orderkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END",
        "difficulty",
    ),
    ("o_totalprice >= 20000", "usable"),
]
GOLD = _sql("gold", "orders", _GOLD)


def gold(t: Tables) -> DataFrame:
    return _df(t.orders, _GOLD)


_STATUS = (
    "CASE WHEN l_quantity <= 5 THEN 'execution_error' WHEN l_quantity <= 7 THEN 'timeout' "
    "WHEN l_quantity >= 49 THEN 'row_limit' ELSE 'success' END"
)
_CANDIDATES = [
    ("l_orderkey", "source_index"),
    (padded("l_orderkey"), "sample_id"),
    (
        "l_linenumber * CAST(100000000000000000 AS BIGINT) + l_partkey * CAST(1000000000 AS BIGINT) "
        "+ CAST(round(l_extendedprice * 100) AS BIGINT)",
        "candidate_index",
    ),
    ("l_linenumber = 1", "is_greedy"),
    ("CASE WHEN l_linenumber = 1 THEN 'greedy' ELSE 'sampled' END", "kind"),
    (_STATUS, "status"),
    (f"({_STATUS}) = 'success' AND l_tax = 0", "empty_result"),
    (
        "CASE WHEN l_tax = 0 THEN '' ELSE concat(l_returnflag, l_linestatus) END",
        "result_key",
    ),
    ("CASE WHEN l_linenumber = 7 THEN NULL ELSE -l_discount END", "mean_logprob"),
    ("l_discount = CAST(0.1 AS DOUBLE)", "truncated"),
    ("l_quantity * 100", "elapsed_ms"),
    ("l_partkey % 12000", "row_count"),
    ("CAST(1 + l_suppkey % 3 AS BIGINT)", "column_count"),
    (
        f"CASE WHEN ({_STATUS}) = 'success' THEN NULL WHEN ({_STATUS}) = 'timeout' THEN 'timeout' "
        "WHEN l_suppkey % 4 = 0 THEN 'syntax_error' WHEN l_suppkey % 4 = 1 THEN 'missing_table' "
        "WHEN l_suppkey % 4 = 2 THEN 'missing_column' ELSE 'database_not_found' END",
        "error_type",
    ),
    ("concat('SELECT ', CAST(l_partkey % 100 AS STRING))", "predicted_sql"),
    (
        "CASE WHEN l_shipdate < TIMESTAMP '1996-06-01 00:00:00' THEN 'generic_fence' "
        "ELSE 'reasoning_sql_fence' END",
        "extraction_status",
    ),
    ("l_shipdate >= TIMESTAMP '1996-06-01 00:00:00'", "format_compliance"),
    ("CAST(floor(l_extendedprice) AS BIGINT)", "completion_tokens"),
]
CANDIDATES = _sql("candidates", "lineitem", _CANDIDATES)


def candidates(t: Tables) -> DataFrame:
    return _df(t.lineitem, _CANDIDATES)


#: Candidates that meet their gold rows in one task, on average.
TASK_ROWS = 250_000

_EX = (
    "CASE WHEN c.status = 'success' AND g.gold_status = 'success' "
    "AND c.result_key = g.gold_key THEN 1 ELSE 0 END"
)
#: Candidates joined with their gold row; needs CANDIDATES and GOLD before it.
SCORED = f"""scored AS (
  SELECT c.*, g.gold_status, g.gold_empty, g.difficulty, g.db_id,
         CAST({_EX} AS BIGINT) AS official_ex,
         CAST(CASE WHEN c.status <> 'success' THEN 0.0 WHEN c.result_key = g.gold_key THEN 1.0
              ELSE least(0.55, 0.1 + 0.05 * c.column_count) END AS DOUBLE) AS screening_score
  FROM candidates c JOIN gold g ON c.source_index = g.source_index)"""


def scored(t: Tables) -> DataFrame:
    c = candidates(t).alias("c")
    g = gold(t).select(
        "source_index", "gold_status", "gold_empty", "gold_key", "difficulty", "db_id"
    ).alias("g")
    # As many parts as the rows ask: what a task sorts here and in the groupings by sample behind it,
    # which need no shuffle of their own, does not grow with the tables.
    parts = -(-t.lineitem.count() // TASK_ROWS)
    if parts > t.spark.sparkContext.defaultParallelism:
        c, g = c.repartition(parts, "source_index").alias("c"), g.repartition(parts, "source_index").alias("g")
    joined = c.join(g, "source_index")
    return joined.selectExpr(
        "c.*", "g.gold_status", "g.gold_empty", "g.difficulty", "g.db_id",
        f"CAST({_EX} AS BIGINT) AS official_ex",
        "CASE WHEN c.status <> 'success' THEN 0D WHEN c.result_key = g.gold_key THEN 1D "
        "ELSE least(0.55D, 0.1D + 0.05D * c.column_count) END AS screening_score",
    )


_SQL_FENCE = f"concat('```sql', {NL}, text, {NL}, '```')"
_RAW = [
    ("conv_id * 1000 + turn", "source_index"),
    ("conv_id", "conv_id"),
    ("turn", "turn"),
    ("text", "gold_sql"),
    (
        "CASE conv_id % 7 "
        f"WHEN 0 THEN concat('<think> ', role, ' </think>', {NL}, {_SQL_FENCE}) "
        f"WHEN 1 THEN {_SQL_FENCE} "
        f"WHEN 2 THEN concat('```', {NL}, text, {NL}, '```') "
        "WHEN 3 THEN concat('select ', text) WHEN 4 THEN text WHEN 5 THEN ' ' "
        f"ELSE concat('```sql', {NL}, text, {NL}, '```', {NL}, '```sql', {NL}, role, {NL}, '```') END",
        "raw_output",
    ),
    (
        "CASE turn % 3 "
        f"WHEN 0 THEN concat('<RATIONALE>', {NL}, text, {NL}, '</RATIONALE>') "
        f"WHEN 1 THEN text ELSE concat('<RATIONALE>', {NL}, ' ', {NL}, '</RATIONALE>') END",
        "teacher_output",
    ),
]
RAW = _sql("raw_outputs", "conversations", _RAW)


def raw_outputs(t: Tables) -> DataFrame:
    return _df(t.conversations, _RAW)


_CATALOG = [
    ("CASE WHEN o_custkey % 69 < 11 THEN 'dev' ELSE 'train' END", "split"),
    ("concat('db_', CAST(o_custkey AS STRING))", "db_id"),
    ("o_orderkey", "table_ordinal"),
    ("concat('Table_', CAST(o_orderkey AS STRING))", "table_name"),
    (
        "CASE WHEN o_orderstatus = 'P' THEN concat('Table_', CAST(o_orderkey AS STRING)) "
        "ELSE o_orderpriority END",
        "table_display",
    ),
    (
        "l_linenumber * CAST(100000000000000000 AS BIGINT) + l_partkey * CAST(1000000000 AS BIGINT) "
        "+ CAST(round(l_extendedprice * 100) AS BIGINT)",
        "ordinal",
    ),
    (
        "concat('col_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', "
        "CAST(o_orderkey AS STRING))",
        "column_name",
    ),
    (
        "CASE WHEN l_returnflag = 'N' THEN concat('col_', CAST(l_linenumber AS STRING), '_', "
        "CAST(l_partkey AS STRING), '_', CAST(o_orderkey AS STRING)) ELSE concat('part  ', CAST(l_partkey AS STRING)) END",
        "column_display",
    ),
    (
        "CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'text' WHEN 'AO' THEN 'integer' "
        "WHEN 'NF' THEN 'varchar(20)' WHEN 'NO' THEN 'date' WHEN 'RF' THEN 'real' "
        "ELSE 'datetime' END",
        "declared_type",
    ),
    ("l_linenumber = 1", "is_primary_key"),
    ("l_linenumber = 2", "is_foreign_key"),
    ("l_partkey", "part_ref"),
]
#: One row per catalog column: a customer is a database, an order a table.
CATALOG = _sql("catalog", "lineitem JOIN orders ON l_orderkey = o_orderkey", _CATALOG)


def catalog_rows(t: Tables) -> DataFrame:
    """What the catalog is derived from, one row per catalog column."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority",
        "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus",
    )


def derived_catalog(rows: DataFrame) -> DataFrame:
    return _df(rows, _CATALOG)


def catalog(t: Tables) -> DataFrame:
    return derived_catalog(catalog_rows(t))


#: Foreign keys of that catalog; needs CATALOG. Some point at columns that do not exist.
CATALOG_FK = """catalog_fk AS (
  SELECT split, db_id, ordinal AS key_ordinal, table_ordinal,
         table_name AS source_table, column_name AS source_column,
         table_name AS target_table,
         CASE WHEN part_ref % 2 = 0 THEN column_name
              ELSE concat('col_1_', CAST(part_ref AS STRING), '_', CAST(table_ordinal AS STRING)) END AS target_column
  FROM catalog WHERE is_foreign_key)"""


def catalog_fk(t: Tables) -> DataFrame:
    return catalog(t).where("is_foreign_key").selectExpr(
        "split", "db_id", "ordinal AS key_ordinal", "table_ordinal",
        "table_name AS source_table", "column_name AS source_column",
        "table_name AS target_table",
        "CASE WHEN part_ref % 2 = 0 THEN column_name "
        "ELSE concat('col_1_', CAST(part_ref AS STRING), '_', CAST(table_ordinal AS STRING)) END AS target_column",
    )


_META_JSON = (
    "concat('{\"db_id\":\"db_', CAST(o_orderkey AS STRING), '\",', "
    "'\"table_names_original\":[\"t_a\",\"', o_orderstatus, '\"],', "
    "'\"table_names\":[\"t a\",\"t b\"],', "
    "'\"column_names_original\":[[-1,\"*\"],[0,\"id\"],[0,\"', o_orderpriority, '\"],[', "
    "CASE WHEN o_orderkey % 13 = 0 THEN '5' ELSE '1' END, ',\"id\"],[1,\"ref\"]],', "
    "'\"column_names\":[[-1,\"*\"],[0,\"id\"],[0,\"priority\"],[', "
    "CASE WHEN o_orderkey % 13 = 0 THEN '5' ELSE '1' END, ',\"id\"],[1,\"ref\"]],', "
    "'\"column_types\":[\"text\",\"integer\",\"text\",\"integer\"', "
    "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ',\"integer\"' END, '],', "
    "'\"primary_keys\":[1', CASE WHEN o_orderkey % 17 = 0 THEN ',[3,3]' "
    "WHEN o_orderkey % 19 = 0 THEN ',[2,3]' WHEN o_orderkey % 7 = 0 THEN ',[3,4]' ELSE ',3' END, '],', "
    "'\"foreign_keys\":[[4,1]', CASE WHEN o_orderkey % 23 = 0 THEN ',[0,1]' "
    "WHEN o_orderkey % 29 = 0 THEN ',[4,1]' WHEN o_orderkey % 31 = 0 THEN ',[3,1],[4,2]' ELSE '' END, ']}')"
)
_METADATA = [("o_orderkey", "doc_index"), (_META_JSON, "raw")]
METADATA = _sql("metadata", "orders", _METADATA)


def metadata(t: Tables) -> DataFrame:
    return _df(t.orders, _METADATA)


_NAMES = [
    ("concat('db_', CAST(s_nationkey AS STRING))", "scope"),
    ("s_suppkey", "ordinal"),
    ("s_name", "name"),
]
_TOKENS = [
    ("doc_id", "source_index"),
    ("concat('doc_', CAST(doc_id AS STRING))", "sample_id"),
    ("source", "db_id"),
    ("CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END", "split"),
]
_REQUESTS = [
    ("event_id", "request_id"),
    ("ts", "ts"),
    ("concat('db_', CAST(user_id % 80 AS STRING))", "db_id"),
    (
        "CASE WHEN event_type IN ('purchase', 'signup') THEN 'accurate' ELSE 'fast' END",
        "mode",
    ),
    (
        "CASE WHEN event_type = 'error' THEN 'sql_execution_failed' ELSE 'success' END",
        "status",
    ),
    ("value * 10", "total_ms"),
    ("value * 8", "generation_ms"),
    ("value", "execution_ms"),
]
REQUESTS = _sql("requests", "events", _REQUESTS)


def requests(t: Tables) -> DataFrame:
    return _df(t.events, _REQUESTS)


#: Token counts of documents: words of the whole text and a derived completion length.
LENGTHS = """lengths AS (
  SELECT doc_id AS source_index, concat('doc_', CAST(doc_id AS STRING)) AS sample_id,
         source AS db_id,
         CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split,
         CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS BIGINT) AS prompt_tokens,
         CAST(5 + doc_id % 60 AS BIGINT) AS completion_tokens,
         CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) + 5 + doc_id % 60 AS BIGINT)
           AS total_tokens
  FROM documents)"""


def lengths(t: Tables) -> DataFrame:
    from ..operators.tokens import word_count

    return _df(
        t.documents.withColumn("prompt_tokens", word_count(F.col("text"))),
        [
            *_TOKENS,
            ("prompt_tokens", "prompt_tokens"),
            ("CAST(5 + doc_id % 60 AS BIGINT)", "completion_tokens"),
            ("prompt_tokens + 5 + doc_id % 60", "total_tokens"),
        ],
    )


#: One evaluated run per (customer group, order month).
RUNS = """runs AS (
  SELECT CAST(o_custkey % 7 AS BIGINT) AS run,
         CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS step,
         CAST(count(*) AS BIGINT) AS sample_count,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS correct_count,
         CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT)
           AS greedy_correct,
         round(100.0 * sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) / count(*), 2)
           AS executable_rate,
         round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 1e7, 6) AS loss,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT) % 1000) AS BIGINT) AS supervised_tokens
  FROM orders GROUP BY 1, 2)"""


def runs(t: Tables) -> DataFrame:
    keyed = t.orders.selectExpr(
        "CAST(o_custkey % 7 AS BIGINT) AS run",
        "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS step",
        "o_orderstatus", "o_orderpriority", "o_totalprice",
    )
    n = F.count("*")
    return keyed.groupBy("run", "step").agg(
        n.alias("sample_count"),
        F.count_if(F.expr("o_orderstatus = 'F'")).alias("correct_count"),
        F.count_if(F.expr("o_orderpriority = '1-URGENT'")).alias("greedy_correct"),
        F.round(F.lit(100.0) * F.count_if(F.expr("o_orderstatus <> 'P'")) / n, 2).alias(
            "executable_rate"
        ),
        F.round(
            F.sum(F.expr("CAST(round(o_totalprice * 100) AS BIGINT)")) / n / F.lit(1e7), 6
        ).alias("loss"),
        F.sum(F.expr("CAST(floor(o_totalprice) AS BIGINT) % 1000")).alias("supervised_tokens"),
    )
