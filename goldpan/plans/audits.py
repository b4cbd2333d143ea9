"""Statement audits (family D), exclusions (H13) and display rows (A14)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import audit, datasets
from . import inputs
from .inputs import CANDIDATES, GOLD, SAMPLES, with_
from .registry import Tables, query

#: Statements every engine here understands, one per family.
GOOD = {
    "inner_join": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "left_join": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "semi_join": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "theta_join": "SELECT a.n_nationkey, b.r_regionkey FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey",
    "group_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 9",
    "distinct": "SELECT DISTINCT l_partkey FROM lineitem",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rank_window": "SELECT * FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) x WHERE r <= 2",
    "top_k": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "union": "SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT l_suppkey FROM lineitem INTERSECT SELECT s_suppkey FROM supplier",
    "except": "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "correlated_subquery": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer",
    "recursive_cte": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n, o_orderkey FROM r JOIN orders ON o_orderkey = n",
    "string_function": "SELECT upper(p_brand) AS b, length(p_name) AS n FROM part WHERE p_name LIKE '%ring%'",
    "date_function": "SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE month(o_orderdate) = 3",
    "math_function": "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 3) AS s FROM supplier",
    "no_rows": "SELECT * FROM region WHERE r_regionkey < 0",
}
#: statement, expected status, expected error type
BAD = {
    "missing_table": ("SELECT * FROM no_such_table", "execution_error", "missing_table"),
    "missing_column": ("SELECT no_such_column FROM region", "execution_error", "missing_column"),
    "ambiguous_column": (
        "SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey",
        "execution_error", "ambiguous_column",
    ),
    "unknown_function": ("SELECT no_such_function(1) FROM region", "execution_error", "missing_function"),
    "syntax_error": ("SELECT r_name FROM region WHERE (", "execution_error", "syntax_error"),
    "two_statements": ("SELECT 1; SELECT 2", "unsafe_sql", "unsafe_sql"),
    "ddl": ("DROP VIEW region", "unsafe_sql", "unsafe_sql"),
    "dml": ("INSERT INTO region VALUES (9, 'X')", "unsafe_sql", "unsafe_sql"),
    "empty": ("-- nothing", "execution_error", "invalid_sql"),
    "division_by_zero": ("SELECT 1 / (r_regionkey - r_regionkey) FROM region", "execution_error", "sqlite_error"),
}
#: Wider than the cap used with it.
CAP = 50_000


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
#: The second database: the same table names with other rows.
OTHER = {"region": "r_regionkey > 1", "nation": "n_regionkey > 1"}
SHARED = "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"


def register_tables(folder: str):
    def register(session: SparkSession, db_id: str) -> None:
        for name in TABLES:
            table = session.read.parquet(f"{folder}/{name}.parquet")
            if db_id == "branch" and name in OTHER:
                table = table.where(OTHER[name])
            table.createOrReplaceTempView(name)

    return register


def _corpus(t: Tables, only: list[str] | None = None):
    """Statements with the orders that ask for them: order k asks statement k mod n."""
    pairs = [(q, s) for q, s in GOOD.items()] + [(q, s) for q, (s, _, _) in BAD.items()]
    pairs = [(q, s) for q, s in pairs if only is None or q in only]
    table = t.spark.createDataFrame(
        [(i, "shop", q, s) for i, (q, s) in enumerate(pairs)],
        "slot int, db_id string, query_id string, sql string",
    )
    slot = (F.col("source_index") % len(pairs)).cast("int")
    samples = inputs.samples(t).select("source_index", "sample_id", slot.alias("slot"))
    # Spark does not know how short a list from the driver is; a shuffle by slot would have as many keys as it.
    return samples.join(F.broadcast(table), "slot").drop("slot")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _outcome_sql(cap: int | None = None) -> str:
    status = "'success'" if cap is None else f"CASE WHEN n > {cap} THEN 'row_limit' ELSE 'success' END"
    count = "n" if cap is None else f"least(n, {cap + 1})"
    error = "NULL" if cap is None else f"CASE WHEN n > {cap} THEN 'row_limit' END"
    good = " UNION ALL ".join(
        f"SELECT '{q}' AS query_id, (SELECT count(*) FROM ({s}) z) AS n" for q, s in GOOD.items()
    )
    bad = " UNION ALL ".join(
        f"SELECT '{q}', {_lit(st)}, CAST(0 AS BIGINT), {_lit(err)}" for q, (_, st, err) in BAD.items()
    )
    return (
        f"counted AS ({good}), outcomes AS (SELECT query_id, {status} AS status, "
        f"{count} AS row_count, {error} AS error_type FROM counted UNION ALL {bad})"
    )


_SLOTS = [*GOOD, *BAD]
_ASKED = (
    "asked AS (SELECT s.source_index, s.sample_id, q.query_id FROM samples s JOIN (VALUES "
    + ", ".join(f"({i}, '{q}')" for i, q in enumerate(_SLOTS))
    + f") q(slot, query_id) ON q.slot = s.source_index % {len(_SLOTS)})"
)


@query(
    "d01_audited_run",
    "WITH RECURSIVE " + _outcome_sql()
    + " SELECT 'shop' AS db_id, query_id, status, row_count, error_type FROM outcomes"
    + " UNION ALL SELECT 'shop', 'shared', 'success', count(*), NULL FROM nation"
    + " UNION ALL SELECT 'branch', 'shared', 'success', count(*), NULL FROM nation"
    + f" WHERE {OTHER['nation']}",
)
def _(t: Tables):
    shared = t.spark.createDataFrame(
        [("shop", "shared", SHARED), ("branch", "shared", SHARED)],
        "db_id string, query_id string, sql string",
    )
    corpus = _corpus(t).select("db_id", "query_id", "sql").unionAll(shared)
    outcomes = audit.run_statements(corpus, register_tables(t.folder))
    return corpus.distinct().join(outcomes, ["db_id", "sql"]).select(
        "db_id", "query_id", "status", "row_count", "error_type"
    )


@query(
    "d02_batch_audit",
    "WITH RECURSIVE " + ", ".join([SAMPLES, _ASKED, _outcome_sql()])
    + """ SELECT a.sample_id, a.query_id, o.status, o.row_count, o.row_count = 0 AND o.status = 'success'
  AS empty_result, o.status = 'success' AS usable
FROM asked a JOIN outcomes o ON o.query_id = a.query_id""",
)
def _(t: Tables):
    corpus = _corpus(t)
    outcomes = audit.run_statements(corpus, register_tables(t.folder))
    known = t.spark.createDataFrame([("shop", True)], "db_id string, available boolean")
    return audit.audit_samples(corpus, outcomes, known).select(
        "sample_id", "query_id", "status", "row_count", "empty_result", "usable"
    )


_KNOWN = (
    "known AS (SELECT DISTINCT concat('db_', CAST(c_nationkey AS STRING)) AS db_id, "
    "c_nationkey % 5 <> 0 AS available FROM customer)"
)


@query(
    "d03_missing_prerequisites",
    with_(GOLD, _KNOWN)
    + """SELECT g.sample_id, CASE WHEN k.db_id IS NULL OR NOT k.available THEN 'execution_error'
    ELSE g.gold_status END AS status,
  CASE WHEN k.db_id IS NULL OR NOT k.available THEN 0.0 ELSE g.gold_elapsed_ms END AS elapsed_ms,
  CASE WHEN k.db_id IS NULL THEN 'missing_schema' WHEN NOT k.available THEN 'database_not_found' END
    AS error_type, k.db_id IS NOT NULL AND k.available AND g.gold_status = 'success' AS usable
FROM gold g LEFT JOIN known k ON k.db_id = g.db_id""",
)
def _(t: Tables):
    gold = inputs.gold(t)
    known = t.customer.selectExpr(
        "concat('db_', CAST(c_nationkey AS STRING)) AS db_id", "c_nationkey % 5 <> 0 AS available"
    ).distinct()
    samples = gold.selectExpr("sample_id", "db_id", "gold_sql AS sql")
    outcomes = gold.selectExpr(
        "db_id", "gold_sql AS sql", "gold_status AS status", "gold_elapsed_ms AS elapsed_ms",
        "gold_row_count AS row_count", "1 AS column_count", "gold_empty AS empty_result",
        "CAST(NULL AS STRING) AS error_type",
    )
    return audit.audit_samples(samples, outcomes, known).select(
        "sample_id", "status", "elapsed_ms", "error_type", "usable"
    )


_CONDITION = (
    "CASE user_id % 7 WHEN 0 THEN 'TABLE_OR_VIEW_NOT_FOUND' WHEN 1 THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' "
    "WHEN 2 THEN 'AMBIGUOUS_REFERENCE' WHEN 3 THEN 'UNRESOLVED_ROUTINE' WHEN 4 THEN 'PARSE_SYNTAX_ERROR' "
    "WHEN 5 THEN 'FAILED_READ_FILE.NO_HINT' ELSE concat('DIVIDE_BY_ZERO_', event_type) END"
)


@query(
    "d04_error_types",
    f"""WITH e AS (SELECT event_id, {_CONDITION} AS condition FROM events)
SELECT event_id, condition, CASE WHEN condition LIKE 'TABLE_OR_VIEW%' THEN 'missing_table'
  WHEN condition LIKE 'UNRESOLVED_COLUMN%' THEN 'missing_column'
  WHEN condition LIKE 'AMBIGUOUS%' THEN 'ambiguous_column'
  WHEN condition LIKE 'UNRESOLVED_ROUTINE%' THEN 'missing_function'
  WHEN condition LIKE 'PARSE%' THEN 'syntax_error'
  WHEN condition LIKE 'FAILED_READ%' THEN 'database_open_error' ELSE 'sqlite_error' END AS error_type FROM e""",
)
def _(t: Tables):
    rows = t.events.selectExpr("event_id", f"{_CONDITION} AS condition")
    return rows.withColumn("error_type", audit.error_type(F.col("condition")))


_STATEMENT = (
    "CASE conv_id % 9 WHEN 0 THEN concat('select ''', role, ';'' from t') "
    "WHEN 1 THEN concat('DROP TABLE ', role) WHEN 2 THEN concat('SELECT 1; SELECT ', role) "
    "WHEN 3 THEN concat('SELECT load_extension(''', role, ''')') "
    "WHEN 4 THEN concat('-- ', role) WHEN 5 THEN concat(' with x as (select 1) select ', role, ' ; ') "
    "WHEN 6 THEN concat('WITH x AS (SELECT 1) INSERT INTO ', role, ' SELECT * FROM x') "
    "WHEN 7 THEN concat('/* ', role, ' */ SELECT \"a;b\" FROM t') ELSE text END"
)
_GUARD = r"""bare AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(sql, '''([^'']|'''')*''', '''''', 'gs'), '"([^"]|"")*"', 'q', 'gs'),
    '/\*.*?\*/|--[^\n]*', ' ', 'gs'), '\s+', ' ', 'g')), '[; ]+$', '') AS b FROM statements),
guarded AS (SELECT *, CASE WHEN b = '' THEN 'invalid_sql'
    WHEN NOT regexp_matches(b, '(?i)^\(* ?(select|with)\b') THEN 'unsafe_sql'
    WHEN contains(b, ';') THEN 'unsafe_sql'
    WHEN regexp_matches(b, '(?i)\b(edit|load_extension|readfile|writefile) ?\(') THEN 'unsafe_sql'
    WHEN regexp_matches(b, '(?i)\b(insert (into|overwrite)|delete from|merge into)\b') THEN 'unsafe_sql'
    ELSE 'ok' END AS verdict FROM bare)"""
_STATEMENTS = f"statements AS (SELECT conv_id, turn, {_STATEMENT} AS sql FROM conversations)"


@query(
    "d05_read_only_guard",
    with_(_STATEMENTS, _GUARD) + "SELECT conv_id, turn, verdict FROM guarded",
)
def _(t: Tables):
    rows = t.conversations.selectExpr("conv_id", "turn", f"{_STATEMENT} AS sql")
    return rows.select("conv_id", "turn", audit.guard(F.col("sql")).alias("verdict"))


@query(
    "d06_row_cap",
    "WITH RECURSIVE " + _outcome_sql(CAP)
    + " SELECT query_id, status, row_count FROM outcomes WHERE query_id IN ('distinct', 'left_join', 'wide')"
    + f" UNION ALL SELECT 'wide', CASE WHEN count(*) > {CAP} THEN 'row_limit' ELSE 'success' END,"
    + f" least(count(*), {CAP + 1}) FROM lineitem",
)
def _(t: Tables):
    statements = {
        "distinct": GOOD["distinct"], "left_join": GOOD["left_join"],
        "wide": "SELECT l_orderkey, l_partkey FROM lineitem",
    }
    asked = t.spark.createDataFrame(
        [("shop", q, s) for q, s in statements.items()], "db_id string, query_id string, sql string"
    )
    outcomes = audit.run_statements(asked, register_tables(t.folder), max_rows=CAP)
    return asked.join(outcomes, ["db_id", "sql"]).select("query_id", "status", "row_count")


@query(
    "d08_no_result_statement",
    with_(_STATEMENTS, _GUARD)
    + "SELECT conv_id, turn, sql FROM guarded WHERE verdict = 'invalid_sql'",
)
def _(t: Tables):
    rows = t.conversations.selectExpr("conv_id", "turn", f"{_STATEMENT} AS sql")
    return rows.where(audit.guard(F.col("sql")) == "invalid_sql")


#: What each statement reads, written out by hand: table and columns.
READS = {
    "inner_join": {"nation": "n_name n_regionkey", "region": "r_name r_regionkey"},
    "left_join": {"customer": "c_custkey", "orders": "o_custkey o_orderkey"},
    "semi_join": {"orders": "o_orderkey", "lineitem": "l_orderkey l_quantity"},
    "anti_join": {"customer": "c_custkey", "orders": "o_custkey o_orderstatus"},
    "theta_join": {"nation": "n_nationkey", "region": "r_regionkey"},
    "group_having": {"orders": "o_custkey"},
    "distinct": {"lineitem": "l_partkey"},
    "rollup": {"lineitem": "l_returnflag l_linestatus"},
    "rank_window": {"orders": "o_custkey o_orderkey o_totalprice"},
    "top_k": {"orders": "o_orderkey o_totalprice"},
    "union": {"customer": "c_nationkey", "supplier": "s_nationkey"},
    "intersect": {"lineitem": "l_suppkey", "supplier": "s_suppkey"},
    "except": {"orders": "o_orderkey", "lineitem": "l_orderkey"},
    "scalar_subquery": {"orders": "o_orderkey o_totalprice"},
    "correlated_subquery": {"customer": "c_custkey", "orders": "o_custkey o_totalprice"},
    "recursive_cte": {"orders": "o_orderkey"},
    "string_function": {"part": "p_brand p_name"},
    "date_function": {"orders": "o_orderkey o_orderdate"},
    "math_function": {"supplier": "s_suppkey s_acctbal"},
    "no_rows": {"region": "r_regionkey r_name"},
}
_READS = "reads(slot, query_id, table_name, column_name) AS (VALUES " + ", ".join(
    f"({i}, '{q}', '{t}', '{c}')"
    for i, q in enumerate(GOOD) for t, columns in READS[q].items() for c in columns.split()
) + ")"


@query(
    "d09_access_trace",
    with_(SAMPLES, _READS)
    + f"""SELECT query_id, table_name AS "table", column_name AS "column", count(*) AS samples
FROM samples JOIN reads ON slot = source_index % {len(GOOD)} GROUP BY ALL""",
)
def _(t: Tables):
    corpus = _corpus(t, list(GOOD))
    trace = audit.access_trace(corpus, register_tables(t.folder))
    named = corpus.groupBy("query_id", "db_id", "sql").agg(F.count("*").alias("samples"))
    return named.join(trace, ["db_id", "sql"]).select("query_id", "table", "column", "samples")


@query(
    "d10_summary_without_rows",
    with_(CANDIDATES)
    + "SELECT source_index, candidate_index, status, row_count, empty_result, error_type FROM candidates",
)
def _(t: Tables):
    held = inputs.candidates(t).select(
        "source_index", "candidate_index", "status", "row_count", "empty_result", "error_type",
        F.array("result_key").alias("rows"),
    )
    return audit.summarize(held)


_RUN = """runs_ AS (SELECT sample_id, source_index, usable, gold_status AS status, gold_empty AS empty_result,
    gold_elapsed_ms AS elapsed_ms, gold_row_count AS row_count, db_id FROM gold)"""


def _reason_sql(prefix: str = "") -> str:
    limit = prefix or "gold_"
    return (
        f"CASE WHEN NOT usable OR status <> 'success' THEN concat('{prefix}', status) "
        f"WHEN empty_result THEN 'empty_gold_result' WHEN elapsed_ms > 5000 THEN '{limit}timeout_limit' "
        f"WHEN row_count > 10000 THEN '{limit}row_limit' END"
    )


def _runs(t: Tables):
    return inputs.gold(t).selectExpr(
        "sample_id", "source_index", "usable", "gold_status AS status", "gold_empty AS empty_result",
        "gold_elapsed_ms AS elapsed_ms", "gold_row_count AS row_count", "db_id",
    )


@query(
    "d11_exclusion_cascade",
    with_(GOLD, _RUN) + f"SELECT sample_id, {_reason_sql()} AS exclusion_reason FROM runs_",
)
def _(t: Tables):
    return _runs(t).select("sample_id", audit.exclusion_reason(5000, 10000).alias("exclusion_reason"))


@query(
    "d12_reward_manifest",
    with_(SAMPLES, GOLD, _RUN)
    + f"""SELECT s.sample_id, s.source_index, s.db_id, s.gold_sql, exclusion_reason,
  exclusion_reason IS NULL AS reward_eligible FROM samples s JOIN (SELECT sample_id,
  {_reason_sql()} AS exclusion_reason FROM runs_) r ON r.sample_id = s.sample_id""",
)
def _(t: Tables):
    records = inputs.samples(t).select("sample_id", "source_index", "db_id", "gold_sql")
    return datasets.reward_manifest(records, _runs(t), "sample_id", 5000, 10000).select(
        *records.columns, "exclusion_reason", "reward_eligible"
    )


@query(
    "d12_reason_counts",
    with_(GOLD, _RUN)
    + f"""SELECT coalesce({_reason_sql()}, 'eligible') AS reason, count(*) AS records FROM runs_ GROUP BY 1""",
)
def _(t: Tables):
    records = inputs.samples(t).select("sample_id")
    return audit.reason_counts(
        datasets.reward_manifest(records, _runs(t), "sample_id", 5000, 10000)
    )


@query(
    "d13_status_counts",
    with_(CANDIDATES)
    + """SELECT status, count(*) AS records, count(*) FILTER (status = 'success' AND NOT truncated) AS usable
FROM candidates GROUP BY status""",
)
def _(t: Tables):
    usable = F.expr("status = 'success' AND NOT truncated")
    return audit.status_counts(inputs.candidates(t).withColumn("usable", usable))


@query(
    "d14_distinct_statements",
    with_(CANDIDATES)
    + """SELECT concat('db_', CAST(source_index % 69 AS STRING)) AS db_id, predicted_sql AS sql,
  count(*) AS occurrences FROM candidates GROUP BY 1, 2""",
)
def _(t: Tables):
    asked = inputs.candidates(t).selectExpr(
        "concat('db_', CAST(source_index % 69 AS STRING)) AS db_id", "predicted_sql AS sql"
    )
    return audit.distinct_statements(asked)


_ANSWERED = (
    "CASE WHEN l_linenumber % 2 = 0 THEN 'accurate' ELSE 'fast' END AS mode, "
    "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_linenumber END AS chosen, "
    "CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE l_returnflag END AS answer_sql"
)


@query(
    "d15_response_status",
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {_ANSWERED} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE
  WHEN mode = 'accurate' AND chosen IS NULL THEN 'no_executable_candidate'
  WHEN chosen IS NOT NULL AND answer_sql = '' THEN 'no_sql_extracted'
  WHEN chosen IS NULL OR l_quantity <= 7 THEN 'sql_execution_failed' ELSE 'success' END AS response_status
FROM c""",
)
def _(t: Tables):
    rows = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'accurate' ELSE 'fast' END AS mode",
        "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_linenumber END AS chosen",
        "CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE l_returnflag END AS answer_sql",
        "CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_quantity <= 7 THEN 'timeout' ELSE 'success' END AS ran",
    )
    status = audit.response_status(F.col("mode"), F.col("chosen"), F.col("answer_sql"), F.col("ran"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("response_status")
    )


@query(
    "d16_failure_masking",
    with_(CANDIDATES)
    + """SELECT source_index, candidate_index, CASE WHEN error_type = 'database_not_found' THEN
  'The registered SQLite database is unavailable.' ELSE concat('failed: ', error_type) END AS error_message
FROM candidates WHERE status <> 'success'""",
)
def _(t: Tables):
    failed = inputs.candidates(t).where("status <> 'success'")
    message = F.concat(F.lit("failed: "), "error_type")
    return failed.select(
        "source_index", "candidate_index",
        audit.masked_message(F.col("error_type"), message).alias("error_message"),
    )


@query(
    "h13_exclusion_prefilter",
    with_(GOLD, _RUN)
    + f"""SELECT sample_id, exclusion_reason FROM (SELECT sample_id, {_reason_sql('gold_report_')}
  AS exclusion_reason FROM runs_) WHERE exclusion_reason IS NOT NULL""",
)
def _(t: Tables):
    reason = audit.exclusion_reason(5000, 10000, "gold_report_")
    _, excluded = audit.split_by_exclusion(_runs(t), reason)
    return excluded.select("sample_id", "exclusion_reason")


@query(
    "a14_display_rows",
    """SELECT doc_id, concat('<BLOB: ', CAST(strlen(text) AS STRING), ' bytes>') AS body,
  CASE doc_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf'
    ELSE concat(CAST(n_chars AS STRING), '.0') END AS score, (SELECT count(*) FROM documents) AS row_count,
  (SELECT count(*) FROM documents) > 100 AS result_truncated FROM documents ORDER BY doc_id LIMIT 100""",
)
def _(t: Tables):
    rows = t.documents.select(
        "doc_id",
        F.col("text").cast("binary").alias("body"),
        F.expr(
            "CASE doc_id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') "
            "WHEN 2 THEN double('-Infinity') ELSE CAST(n_chars AS DOUBLE) END"
        ).alias("score"),
    )
    return audit.display_rows(rows, ["doc_id"], 100)
