"""Sources and sinks (family A): tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import csvs, files, jsonl
from ..streaming import logs
from . import inputs
from .inputs import CANDIDATES, REQUESTS, with_
from .registry import Tables, query

_EVENT = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
_FIELDS = "event_id, user_id, event_type, value, props"


def _json_lines(t: Tables):
    return t.events.select(
        "event_id",
        F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("line"),
    )


@query("a01_jsonl_scan", f"SELECT {_FIELDS} FROM events")
def _(t: Tables):
    path = scratch_path(t.spark, "a01")
    blank = F.expr("CASE WHEN event_id % 10 = 0 THEN concat(line, '\\n \\n') ELSE line END")
    _json_lines(t).select(blank).write.text(path)
    return jsonl.scan_jsonl(t.spark, path, _EVENT)


#: Every 83rd line is an array, every 89th is cut off, every 97th is blank.
_LINE = (
    "CASE WHEN event_id % 97 = 0 THEN '  ' WHEN event_id % 89 = 0 THEN substr(line, 1, 20) "
    "WHEN event_id % 83 = 0 THEN concat('[', line, ']') ELSE line END"
)
_KIND = (
    "CASE WHEN event_id % 97 = 0 THEN 'blank' WHEN event_id % 89 = 0 THEN 'invalid_json' "
    "WHEN event_id % 83 = 0 THEN 'not_an_object' ELSE 'record' END"
)


def _damaged(t: Tables, label: str) -> str:
    path = scratch_path(t.spark, label)
    _json_lines(t).select(F.expr(_LINE)).write.text(path)
    return path


@query("a02_strict_records", f"SELECT {_FIELDS} FROM events WHERE {_KIND} = 'record'")
def _(t: Tables):
    return jsonl.scan_strict_jsonl(t.spark, _damaged(t, "a02"), _EVENT)[0]


@query(
    "a02_rejected_lines",
    f"""SELECT {_KIND} AS issue, count(*) AS lines FROM events
WHERE {_KIND} IN ('invalid_json', 'not_an_object') GROUP BY 1""",
)
def _(t: Tables):
    rejected = jsonl.scan_strict_jsonl(t.spark, _damaged(t, "a02"), _EVENT)[1]
    return rejected.groupBy("issue").agg(F.count("*").alias("lines"))


@query(
    "a03_torn_lines",
    f"""SELECT count(*) AS lines, count(*) FILTER ({_KIND} = 'blank') AS blank_lines,
  count(*) FILTER ({_KIND} IN ('invalid_json', 'not_an_object')) AS bad_lines,
  CAST(0 AS BIGINT) AS torn_files FROM events""",
)
def _(t: Tables):
    return jsonl.torn_files(t.spark, _damaged(t, "a03")).agg(
        *[F.sum(c).alias(c) for c in ("lines", "blank_lines", "bad_lines")],
        F.count_if("torn").alias("torn_files"),
    )


@query("a04_json_documents", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def _(t: Tables):
    """Documents of at most 5000 orders, one array per file."""
    path = scratch_path(t.spark, "a04")
    rows = F.collect_list(F.struct("o_orderkey", "o_custkey", "o_orderpriority"))
    documents = t.orders.groupBy(F.expr("o_orderkey div 5000").alias("part")).agg(
        F.regexp_replace(F.to_json(rows), r"\},\{", "},\n{").alias("document")
    )
    documents.select("document").write.option("maxRecordsPerFile", 1).text(path)
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING"
    return jsonl.scan_json(t.spark, path, schema)


_DESCRIPTION = (
    "p_name AS original_column_name",
    "concat('Größe  ', p_type, ' ', chr(10), '\"', p_brand, '\" ') AS column_description",
    "CASE WHEN p_size > 25 THEN p_type END AS value_description",
)


#: Rows of one description file; such files are small, and each is read as one value.
_FILE_ROWS = 5000


@query(
    "a05_description_csv",
    r"""SELECT p_name AS original_column_name, concat('Größe ', p_type, ' "', p_brand, '"') AS column_description,
  CASE WHEN p_size > 25 THEN p_type ELSE '' END AS value_description,
  p_partkey % 2 = 0 AS legacy FROM part""",
)
def _(t: Tables):
    root = scratch_path(t.spark, "a05")
    for legacy, encoding in ((False, "UTF-8"), (True, "ISO-8859-1")):
        rows = t.part.where((F.col("p_partkey") % 2 == 0) == legacy).selectExpr(*_DESCRIPTION)
        first = " original_column_name" if legacy else "\ufefforiginal_column_name"
        (
            rows.toDF(first, "column_description ", "value_description")
            .write.option("header", True).option("escape", '"').option("encoding", encoding)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("maxRecordsPerFile", _FILE_ROWS)
            .csv(f"{root}/{'legacy' if legacy else 'unicode'}")
        )
    rows = csvs.scan_description_csv(t.spark, root)
    return rows.select(
        "original_column_name", "column_description", "value_description",
        F.contains("file", F.lit("/legacy/")).alias("legacy"),
    )


@query("a07_file_discovery")
def _(t: Tables):
    return files.discover(t.spark, t.folder, "*.parquet").select("name", "length")


@query(
    "a08_verified_publish",
    with_(CANDIDATES) + "SELECT source_index, candidate_index, status, row_count FROM candidates",
)
def _(t: Tables):
    root = scratch_path(t.spark, "a08")
    rows = inputs.candidates(t).select("source_index", "candidate_index", "status", "row_count")
    files.publish(rows.limit(0), root, "candidates")
    files.publish(rows, root, "candidates")
    return files.published(t.spark, root, "candidates")


@query(
    "a08_publication_history",
    with_(CANDIDATES)
    + """SELECT CAST(number AS BIGINT) AS number, n AS rows FROM (
  SELECT 1 AS number, count(*) AS n FROM candidates WHERE status = 'success'
  UNION ALL SELECT 2, count(*) FROM candidates)""",
)
def _(t: Tables):
    root = scratch_path(t.spark, "a08")
    rows = inputs.candidates(t).select("source_index", "candidate_index", "status")
    files.publish(rows.where("status = 'success'"), root, "candidates")
    files.publish(rows, root, "candidates")
    return files.manifests(t.spark, root, "candidates").select("number", "rows")


@query(
    "a09_round_trip",
    """SELECT o_orderkey, o_orderpriority, only_in FROM (
  SELECT o_orderkey, o_orderpriority, 'left' AS only_in FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'changed', 'right' FROM orders WHERE o_orderstatus = 'P')""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "a09")
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    t.orders.selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE o_orderpriority END AS o_orderpriority"
    ).write.json(path)
    return files.differences(rows, t.spark.read.schema(rows.schema).json(path))


@query("a10_append", f"SELECT {_FIELDS} FROM events")
def _(t: Tables):
    path = scratch_path(t.spark, "a10")
    rows = t.events.select(*_FIELDS.split(", "))
    files.append_records(rows.where("event_type <> 'error'"), path)
    files.append_records(rows.where("event_type = 'error'"), path)
    return t.spark.read.schema(_EVENT).json(path)


@query(
    "a11_request_log",
    with_(REQUESTS)
    + """SELECT request_id, db_id, mode, status, round(total_ms, 3) AS total_ms,
  round(generation_ms, 3) AS generation_ms, round(execution_ms, 3) AS execution_ms,
  CASE WHEN status <> 'success' THEN status END AS error_type FROM requests""",
)
def _(t: Tables):
    root = scratch_path(t.spark, "a11")
    arrived = inputs.requests(t).withColumn("ts", F.col("ts").cast("string"))
    arrived.write.json(f"{root}/in")
    stream = logs.log_record(logs.request_stream(t.spark, f"{root}/in"))
    logs.write_log(stream, f"{root}/log", f"{root}/state").awaitTermination()
    return t.spark.read.parquet(f"{root}/log").drop("ts")


@query(
    "a11_batch_ledger",
    with_(REQUESTS)
    + """SELECT request_id, db_id, status, CAST(CASE WHEN status = 'success' THEN 0 ELSE 1 END AS BIGINT) AS batch
  FROM requests""",
)
def _(t: Tables):
    """Two batches, each of which arrives twice."""
    path = scratch_path(t.spark, "a11-ledger")
    records = inputs.requests(t).select("request_id", "db_id", "status")
    for number, some in ((0, "status = 'success'"), (1, "status <> 'success'"), (0, "true"), (1, "status <> 'success'")):
        logs.save_batch(records.where(some), number, path)
    return logs.logged_batches(t.spark, path, records.schema)


@query(
    "a13_csv_export",
    """SELECT concat('"', CAST(o_orderkey AS STRING), '","', replace(concat('"', o_orderstatus, '", ', o_orderpriority),
  '"', '""'), '","', CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END, '"') AS line FROM orders""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "a13")
    rows = t.orders.selectExpr(
        "o_orderkey", "concat('\"', o_orderstatus, '\", ', o_orderpriority) AS label",
        "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority",
    )
    csvs.export_csv(rows, path)
    header = '"o_orderkey","label","priority"'
    return t.spark.read.text(path).where(F.col("value") != header).withColumnRenamed("value", "line")
