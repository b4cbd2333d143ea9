"""Running read-only SQL statements as Spark jobs and judging their outcomes."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from threading import Event, Thread

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .scoring import result_digest

# Must equal the reference for matching results.
UNSAFE_FUNCTIONS = ["edit", "load_extension", "readfile", "writefile"]
# Functions through which a Spark SELECT could leave the engine.
UNSAFE_SPARK_FUNCTIONS = ["reflect", "try_reflect", "java_method"]

OUTCOME_SCHEMA = (
    "db_id string, sql string, status string, elapsed_ms double, row_count bigint, "
    "column_count int, empty_result boolean, result_key string, error_type string, "
    "error_message string"
)

# Spark error conditions by error type; a condition matches by equality or as a prefix.
ERROR_TYPES = {
    "TABLE_OR_VIEW_NOT_FOUND": "missing_table",
    "UNRESOLVED_COLUMN": "missing_column",
    "MISSING_ATTRIBUTES": "missing_column",
    "AMBIGUOUS_REFERENCE": "ambiguous_column",
    "UNRESOLVED_ROUTINE": "missing_function",
    "PARSE_SYNTAX_ERROR": "syntax_error",
    "PARSE_EMPTY_STATEMENT": "syntax_error",
    "PATH_NOT_FOUND": "database_open_error",
    "FAILED_READ_FILE": "database_open_error",
    "CANNOT_READ_FILE_FOOTER": "database_open_error",
}
OTHER_ERROR = "sqlite_error"


# Left to right, as the parser reads: raw literals know no escapes, others escape with a backslash.
# A line comment ends at a carriage return or line feed unless a backslash stands before the line
# feed; block comments nest; a hint is no comment, and what it holds is read like the rest.
_RAW = r"""\br'[^']*+'|\br"[^"]*+\""""
_LITERAL = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
_NAME = r"`[^`]*+(?:``[^`]*+)*+`"
_LINE_COMMENT = r"--(?:[^\r\n\\]++|\\\n|\\(?!\n))*+"
#: Block comments inside block comments that are understood; deeper ones are refused.
NESTED = 3


def _block_comment(depth: int) -> str:
    inner = f"|{_block_comment(depth - 1)}" if depth else ""
    return rf"/\*(?!\+)(?:[^/*]++|/(?!\*)|\*(?!/){inner})*+\*/"


_COMMENT = f"{_LINE_COMMENT}|{_block_comment(NESTED)}"
#: Put after whatever was quoted.
_QUOTED = "\u00a4"


def _bare(sql: Column) -> Column:
    """Statement without comments; literals are emptied, quoted names of plain letters are
    written plainly, so that a quoted function is seen, and other quoted names become ``q``."""
    quoted = f"{_RAW}|{_LITERAL}|{_NAME}"
    text = F.replace(sql, F.lit(_QUOTED), F.lit(" "))
    text = F.regexp_replace(text, rf"(?is)({quoted})|(?:{_COMMENT})", "$1 ")
    text = F.regexp_replace(text, rf"(?is)({_NAME})|(?:{_RAW}|{_LITERAL})", f"$1{_QUOTED}")
    text = F.regexp_replace(text, rf"`(\w+)`{_QUOTED}", " $1 ")
    text = F.regexp_replace(text, rf"(?s){_NAME}{_QUOTED}", " q ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def guard(sql: Column) -> Column:
    """'ok', 'invalid_sql' for nothing to run, or 'unsafe_sql'.

    Runs before ``spark.sql``, which would execute a definition statement at once. A null
    statement is nothing to run. Functions that leave the engine are refused wherever their call is
    written, in comments and literals too; a comment or quote that does not end is refused.
    """
    text = F.regexp_replace(_bare(F.coalesce(sql, F.lit(""))), r"[; ]+$", "")
    functions = "|".join([*UNSAFE_FUNCTIONS, *UNSAFE_SPARK_FUNCTIONS])
    return (
        F.when(text == "", "invalid_sql")
        .when(~text.rlike(r"(?i)^\(* ?(select|with)\b"), "unsafe_sql")
        .when(F.contains(text, F.lit(";")), "unsafe_sql")
        .when(text.rlike(rf"(?i)\b({functions}) ?\("), "unsafe_sql")
        .when(sql.rlike(rf"(?i)\b({'|'.join(UNSAFE_SPARK_FUNCTIONS)})[`\s]*\("), "unsafe_sql")
        .when(text.rlike(r"/\*(?!\+)|['\"`]|\$\w*\$"), "unsafe_sql")
        .when(
            text.rlike(
                r"(?i)\b(insert (into|overwrite)|delete from|merge into|update [\w.]+ set)\b"
            ),
            "unsafe_sql",
        )
        .when(text.rlike(rf"(?i)\busing ?{_QUOTED}"), "unsafe_sql")
        .otherwise("ok")
    )


def error_type(condition: Column) -> Column:
    """Error type of a Spark error condition."""
    result = None
    for prefix, name in ERROR_TYPES.items():
        hit = F.startswith(condition, F.lit(prefix))
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise(OTHER_ERROR)


def _error_type_of(condition: str | None) -> str:
    for prefix, name in ERROR_TYPES.items():
        if (condition or "").startswith(prefix):
            return name
    return OTHER_ERROR


def _outcome(db_id: str, sql: str, status: str, started: float, **fields) -> dict:
    return {
        "db_id": db_id,
        "sql": sql,
        "status": status,
        "elapsed_ms": round((time.perf_counter() - started) * 1000, 3),
        "row_count": 0,
        "column_count": 0,
        "empty_result": False,
        "result_key": None,
        "error_type": None,
        "error_message": None,
        **fields,
    }


def run_statement(
    session: SparkSession, db_id: str, sql: str, verdict: str,
    max_rows: int | None = None, timeout_ms: float | None = None,
) -> dict:
    """Run one guarded statement as a Spark job and describe its outcome.

    All columns of the result are digested on the executors; only the one-row summary
    comes back. A cap reads at most one row more than it allows.
    """
    started = time.perf_counter()
    if verdict == "invalid_sql":
        return _outcome(
            db_id, sql, "execution_error", started, error_type="invalid_sql",
            error_message="The statement returns no result.",
        )
    if verdict != "ok":
        return _outcome(
            db_id, sql, "unsafe_sql", started, error_type="unsafe_sql",
            error_message="Only a single read-only statement is allowed.",
        )
    # The jobs of a driver thread share a group. After the deadline it is ended again and again, as
    # a statement may be between two jobs.
    context, group = session.sparkContext, f"goldpan-{uuid.uuid4().hex}"
    late, over = Event(), Event()

    def watch() -> None:
        if not over.wait(timeout_ms / 1000):
            late.set()
            while not over.wait(0.5):
                context.cancelJobGroup(group)

    context.setJobGroup(group, f"statement on {db_id}", interruptOnCancel=True)
    try:
        if timeout_ms is not None:
            Thread(target=watch, daemon=True).start()
        result = session.sql(sql.rstrip().rstrip(";"))
        width = len(result.columns)
        if width == 0:
            return _outcome(
                db_id, sql, "execution_error", started, error_type="invalid_sql",
                error_message="The statement returns no result.",
            )
        bounded = result if max_rows is None else result.limit(max_rows + 1)
        summary = result_digest(bounded).first()
    except (PySparkException, Py4JJavaError) as error:
        if late.is_set():
            return _timeout(db_id, sql, started, timeout_ms)
        condition, message = _described(error)
        return _outcome(
            db_id, sql, "execution_error", started, error_type=_error_type_of(condition),
            error_message=message,
        )
    finally:
        over.set()
    rows = int(summary["row_count"])
    if max_rows is not None and rows > max_rows:
        return _outcome(
            db_id, sql, "row_limit", started, row_count=rows, column_count=width,
            error_type="row_limit", error_message=f"More than {max_rows} rows.",
        )
    done = _outcome(
        db_id, sql, "success", started, row_count=rows, column_count=width,
        empty_result=rows == 0, result_key=summary["result_key"],
    )
    if timeout_ms is not None and (late.is_set() or done["elapsed_ms"] > timeout_ms):
        return _timeout(db_id, sql, started, timeout_ms)
    return done


def _timeout(db_id: str, sql: str, started: float, timeout_ms: float) -> dict:
    return _outcome(
        db_id, sql, "timeout", started, error_type="timeout",
        error_message=f"Took longer than {timeout_ms} ms.",
    )


def _described(error: Exception) -> tuple[str | None, str]:
    """Error condition and first line of the message; both kinds of engine errors have one."""
    text = str(error)
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    if condition is None:
        # Wrapped errors: the first bracketed condition that is known, outermost first.
        found = re.findall(r"\[([A-Z][A-Z0-9_.]+)\]", text)
        condition = next((c for c in found if _error_type_of(c) != OTHER_ERROR), next(iter(found), None))
    lines = (line.strip() for line in text.splitlines())
    return condition, next((line for line in lines if line), type(error).__name__)


def distinct_statements(df: DataFrame, db: str = "db_id", sql: str = "sql") -> DataFrame:
    """Each (database, statement) once, with how often it occurs."""
    return df.groupBy(db, sql).agg(F.count("*").alias("occurrences"))


def run_statements(
    statements: DataFrame,
    register: Callable[[SparkSession, str], None],
    max_rows: int | None = None,
    timeout_ms: float | None = None,
    threads: int = 4,
    path: str | None = None,
    chunk: int = 256,
) -> DataFrame:
    """Outcome rows for the distinct (db_id, sql) of ``statements``.

    ``register`` creates the views of one database in the session that it is given; every database
    has a session of its own, in which a file path is no table name. Statements are submitted from
    a few driver threads, each as an ordinary distributed job; data rows stay on the executors.
    Outcomes are appended to the table at ``path`` in chunks, so the driver holds one chunk, and a
    run that was broken off goes on with the statements that the table does not have.
    """
    spark = statements.sparkSession
    path = path or scratch_path(spark, "outcomes")
    spark.createDataFrame([], OUTCOME_SCHEMA).write.mode("append").parquet(path)
    done = spark.read.schema(OUTCOME_SCHEMA).parquet(path).select("db_id", "sql")
    left = distinct_statements(statements).join(done, ["db_id", "sql"], "left_anti")
    checked = left.select("db_id", "sql", guard(F.col("sql")).alias("v")).orderBy("db_id", "sql")
    sessions: dict[str, SparkSession] = {}

    def session_of(db_id: str) -> SparkSession:
        if db_id not in sessions:
            sessions.clear()  # rows come database by database
            session = spark.newSession()
            session.conf.set("spark.sql.runSQLOnFiles", "false")
            register(session, db_id)
            sessions[db_id] = session
        return sessions[db_id]

    def run(job: tuple) -> dict:
        session, row = job
        return run_statement(session, row["db_id"], row["sql"], row["v"], max_rows, timeout_ms)

    rows = checked.toLocalIterator()
    with ThreadPoolExecutor(threads) as pool:
        while part := list(islice(rows, chunk)):
            jobs = [(session_of(row["db_id"]), row) for row in part]
            outcomes = list(pool.map(run, jobs))
            spark.createDataFrame(outcomes, OUTCOME_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(OUTCOME_SCHEMA).parquet(path)


def audit_samples(samples: DataFrame, outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """One audit row per sample: its outcome, or a zero-time failure when its database is
    not in ``known`` (db_id, available)."""
    joined = samples.join(known, "db_id", "left").join(outcomes, ["db_id", "sql"], "left")
    missing = (
        F.when(F.col("available").isNull(), "missing_schema")
        .when(~F.col("available"), "database_not_found")
    )
    ok = missing.isNull()
    status = F.when(ok, F.col("status")).otherwise("execution_error")
    zero = F.lit(0)
    return joined.select(
        *[c for c in samples.columns],
        status.alias("status"),
        F.when(ok, F.col("elapsed_ms")).otherwise(F.lit(0.0)).alias("elapsed_ms"),
        F.when(ok, F.col("row_count")).otherwise(zero).cast("bigint").alias("row_count"),
        F.when(ok, F.col("column_count")).otherwise(zero).cast("int").alias("column_count"),
        F.when(ok, F.col("empty_result")).otherwise(F.lit(False)).alias("empty_result"),
        F.coalesce(missing, F.col("error_type")).alias("error_type"),
        (ok & (F.col("status") == "success")).alias("usable"),
    )


def exclusion_reason(timeout_ms: float, max_rows: int, prefix: str = "") -> Column:
    """First reason a gold run is not usable for rewards; null when it is.

    ``prefix`` is put before the status, the timeout and the row limit.
    """
    status = F.coalesce("status", F.lit("unusable_gold"))
    limit = prefix or "gold_"
    return (
        F.when(
            ~F.coalesce("usable", F.lit(False)) | (status != "success"),
            F.concat(F.lit(prefix), status),
        )
        .when(F.col("empty_result"), "empty_gold_result")
        .when(F.col("elapsed_ms") > timeout_ms, f"{limit}timeout_limit")
        .when(F.col("row_count") > max_rows, f"{limit}row_limit")
    )


def split_by_exclusion(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Eligible rows, and the excluded ones with their reason."""
    marked = df.withColumn("exclusion_reason", reason)
    none = F.col("exclusion_reason").isNull()
    return marked.where(none).drop("exclusion_reason"), marked.where(~none)


def reason_counts(manifest: DataFrame) -> DataFrame:
    """Eligible and excluded records by reason, in order of the reason."""
    return (
        manifest.groupBy(F.coalesce("exclusion_reason", F.lit("eligible")).alias("reason"))
        .agg(F.count("*").alias("records"))
        .orderBy("reason")
    )


def status_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(
        F.count("*").alias("records"), F.count_if("usable").alias("usable")
    )


def summarize(executions: DataFrame, rows: str = "rows") -> DataFrame:
    """Diagnostics without the result rows."""
    return executions.drop(rows)


def response_status(mode: Column, chosen: Column, sql: Column, execution: Column) -> Column:
    """Outcome shown to a user for one request."""
    return (
        F.when((mode == "accurate") & chosen.isNull(), "no_executable_candidate")
        .when(chosen.isNotNull() & (F.coalesce(sql, F.lit("")) == ""), "no_sql_extracted")
        .when(F.coalesce(execution, F.lit("")) != "success", "sql_execution_failed")
        .otherwise("success")
    )


def masked_message(error: Column, message: Column) -> Column:
    """Error text without database locations."""
    # Fixed value: the message must equal the reference for matching results.
    hidden = error.isin("database_not_found", "database_open_error")
    return F.when(hidden, "The registered SQLite database is unavailable.").otherwise(message)


_SCAN = re.compile(r"^\(\d+\) Scan \w+.*?(?=^\(\d+\) |\Z)", re.DOTALL | re.MULTILINE)


def _scans(plan: str) -> Iterable[tuple[str, list[str]]]:
    for block in _SCAN.findall(plan):
        location = re.search(r"Location: .*?\[(.*?)\]", block)
        schema = re.search(r"ReadSchema: struct<(.*)>", block)
        if location is None:
            continue
        name = location.group(1).split(",")[0].rstrip("/").rsplit("/", 1)[-1]
        columns = re.findall(r"(?:^|,)([^:,<>]+):", schema.group(1)) if schema else []
        yield name.removesuffix(".parquet"), columns


def access_trace(
    statements: DataFrame, register: Callable[[SparkSession, str], None]
) -> DataFrame:
    """(db_id, sql, table, column, error) read by each safe statement, from the scans of its plan.

    A scan without columns (a bare count) gives one row with a null column; a statement that
    cannot be planned gives one row with its error. Columns are the ones left after pruning.
    """
    spark = statements.sparkSession
    sessions: dict[str, SparkSession] = {}

    def session_of(db_id: str) -> SparkSession:
        if db_id not in sessions:
            session = sessions[db_id] = spark.newSession()
            session.conf.set("spark.sql.maxMetadataStringLength", str(2**31 - 1))
            session.conf.set("spark.sql.debug.maxToStringFields", str(2**31 - 1))
            session.conf.set("spark.sql.runSQLOnFiles", "false")
            register(session, db_id)
        return sessions[db_id]

    checked = distinct_statements(statements).where(guard(F.col("sql")) == "ok")
    rows = []
    for row in checked.toLocalIterator():
        try:
            text = row["sql"].rstrip().rstrip(";")
            plan = session_of(row["db_id"]).sql("EXPLAIN FORMATTED " + text).first()[0]
            if plan.startswith("Error occurred"):  # an EXPLAIN reports what it cannot plan as text
                session_of(row["db_id"]).sql(text)
        except (PySparkException, Py4JJavaError) as error:
            rows.append((row["db_id"], row["sql"], None, None, _error_type_of(_described(error)[0])))
            continue
        seen = {(t, c) for t, columns in _scans(plan) for c in (columns or [None])}
        rows.extend((row["db_id"], row["sql"], t, c, None) for t, c in sorted(seen, key=str))
    return spark.createDataFrame(
        rows, "db_id string, sql string, table string, column string, error string"
    )


def display_rows(
    df: DataFrame, order: Sequence[str], max_rows: int
) -> DataFrame:
    """First ``max_rows`` rows with JSON-safe cells, the full row count and a cut-off flag."""
    total = df.agg(F.count("*")).scalar()

    def safe(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "binary":
            size = F.octet_length(c).cast("string")
            return F.when(c.isNotNull(), F.concat(F.lit("<BLOB: "), size, F.lit(" bytes>")))
        if kind in ("double", "float"):
            text = (
                F.when(F.isnan(c), "nan")
                .when(c == F.lit(float("inf")), "inf")
                .when(c == F.lit(float("-inf")), "-inf")
                .otherwise(c.cast("string"))
            )
            return F.when(c.isNotNull(), text)
        return c

    shown = df.orderBy(*order).limit(max_rows)
    return shown.select(
        *[safe(n, k).alias(n) for n, k in df.dtypes],
        total.alias("row_count"),
        (total > max_rows).alias("result_truncated"),
    )

