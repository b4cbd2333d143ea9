"""Value index and ranked retrieval (family E) and the grounded dataset (F07)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, datasets, index, retrieval_index
from ..operators.retrieval_index import StoredIndex
from ..session import scratch_path
from . import inputs
from .inputs import CATALOG, with_
from .registry import Tables, query

_FOLD = "replace(lower({}), 'ß', 'ss')"
_TOKENS = "regexp_extract_all(strip_accents(" + _FOLD + r"), '[\p{{L}}\p{{N}}]+')"
_LINE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"

#: A numeric total order of each table that has searchable columns.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
    "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn"],
}
#: What E01 finds searchable in them, for the checking SQL; the queries ask the live schema.
SCANNED = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus", "l_shipdate"], "events": ["ts", "event_type", "props"],
    "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"],
    "conversations": ["role", "text"],
}
#: Declared type of the live column types, by which E01 judges.
DECLARED = {"string": "VARCHAR", "date": "DATE", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME"}


def _scan_sql(name: str, column: str) -> str:
    order = ", ".join(KEYS[name])
    return (
        f"SELECT '{name}' AS table_name, '{column}' AS column_name, CAST(row_number() OVER "
        f"(ORDER BY {order}) AS INTEGER) AS scan_order, CAST({column} AS VARCHAR) AS value FROM {name} "
        f"WHERE {column} IS NOT NULL QUALIFY scan_order <= 5000"
    )


_SCAN = (
    "scanned AS ("
    + " UNION ALL ".join(
        f"SELECT * FROM ({_scan_sql(n, c)})" for n, cols in SCANNED.items() for c in cols
    )
    + ")"
)
_NORMAL = (
    f"normal AS (SELECT table_name, column_name, scan_order, {_LINE.format('value')} AS value "
    f"FROM scanned WHERE length({_LINE.format('value')}) BETWEEN 1 AND 128)"
)
_DISTINCT = (
    "distinct_ AS (SELECT table_name, column_name, arg_min(value, scan_order) AS value, "
    f"min(scan_order) AS scan_order FROM normal GROUP BY 1, 2, {_FOLD.format('value')})"
)
_CAPPED = """capped AS (SELECT *, CAST(row_number() OVER (PARTITION BY table_name, column_name
  ORDER BY scan_order) AS INTEGER) AS value_order FROM distinct_ QUALIFY value_order <= 500)"""
_PER_COLUMN = """per_column AS (SELECT s.table_name, s.column_name,
  coalesce(max(CASE WHEN c.value_order = 500 THEN c.scan_order END), max(s.scan_order)) AS scanned_values,
  count(c.value_order) AS indexed_unique_values
  FROM scanned s LEFT JOIN capped c ON c.table_name = s.table_name AND c.column_name = s.column_name
    AND c.scan_order = s.scan_order GROUP BY 1, 2)"""


def _frames(t: Tables):
    frames = {}
    for name, order in KEYS.items():
        table = getattr(t, name)
        kinds = {c: DECLARED.get(k, "") for c, k in table.dtypes}
        searchable = [c for c, k in kinds.items() if any(m in k for m in text.VALUE_TYPE_MARKERS)]
        frames[name] = (table, order, searchable)
    return frames


def _scanned(t: Tables):
    return index.scan_tables(_frames(t))


def _capped(t: Tables):
    return index.capped_values(index.distinct_values(index.normalized_values(_scanned(t))))


@query(
    "a06_column_scan",
    """SELECT column_name, CAST(scan_order AS INTEGER) AS scan_order, value FROM (
SELECT 'p_name' AS column_name, row_number() OVER (ORDER BY p_partkey) AS scan_order, p_name AS value FROM part
UNION ALL SELECT 'p_brand', row_number() OVER (ORDER BY p_partkey), p_brand FROM part) WHERE scan_order <= 700""",
)
def _(t: Tables):
    scan = index.bounded_scan(t.part, "part", ["p_partkey"], ["p_name", "p_brand"], 700)
    return scan.drop("table_name")


@query(
    "e01_value_columns",
    with_(CATALOG)
    + """SELECT db_id, table_name, ordinal, declared_type, regexp_matches(upper(declared_type),
  'TEXT|CHAR|CLOB|DATE|DATETIME') AS searchable FROM catalog""",
)
def _(t: Tables):
    return inputs.catalog(t).select(
        "db_id", "table_name", "ordinal", "declared_type",
        text.is_value_type(F.col("declared_type")).alias("searchable"),
    )


@query("e02_bounded_scan", with_(_SCAN) + "SELECT * FROM scanned")
def _(t: Tables):
    return _scanned(t)


@query(
    "e03_value_normalisation",
    rf"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents)
SELECT doc_id, {_LINE.format('raw')} AS value FROM lines
WHERE length({_LINE.format('raw')}) BETWEEN 1 AND 128""",
)
def _(t: Tables):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return index.normalized_values(lines)


@query("e04_distinct_values", with_(_SCAN, _NORMAL, _DISTINCT) + "SELECT * FROM distinct_")
def _(t: Tables):
    return index.distinct_values(index.normalized_values(_scanned(t)))


@query("e05_capped_values", with_(_SCAN, _NORMAL, _DISTINCT, _CAPPED) + "SELECT * FROM capped")
def _(t: Tables):
    return _capped(t)


_DESCRIBED = """described AS (SELECT *, CASE WHEN part_ref % 3 = 0 THEN '' ELSE concat('about ', declared_type) END
  AS column_description, CASE WHEN part_ref % 4 = 0 THEN '' ELSE 'coded' END AS value_description
  FROM catalog)"""


@query(
    "e06_column_search_text",
    with_(CATALOG, _DESCRIBED)
    + """SELECT db_id, table_ordinal, ordinal, concat_ws(' ', nullif(table_name, ''), nullif(table_display, ''),
  nullif(column_name, ''), nullif(column_display, ''), nullif(column_description, ''),
  nullif(value_description, '')) AS search_text FROM described""",
)
def _(t: Tables):
    described = inputs.catalog(t).selectExpr(
        "*",
        "CASE WHEN part_ref % 3 = 0 THEN '' ELSE concat('about ', declared_type) END AS column_description",
        "CASE WHEN part_ref % 4 = 0 THEN '' ELSE 'coded' END AS value_description",
    )
    parts = ["table_name", "table_display", "column_name", "column_display",
             "column_description", "value_description"]
    return described.select(
        "db_id", "table_ordinal", "ordinal", index.column_search_text(parts).alias("search_text")
    )


#: The live tables as two databases of one split.
_CORPUS_TABLES = ("documents", "pages", "benchmark", "conversations")
_LIVE_DB = f"CASE WHEN table_name IN {_CORPUS_TABLES} THEN 'corpus' ELSE 'trade' END"
_META_ROWS = (
    "meta AS (SELECT table_name, column_name, concat_ws(' ', table_name, column_name) AS search_text "
    "FROM (SELECT DISTINCT table_name, column_name FROM scanned))"
)
_INDEX_ROWS = f"""index_rows AS (SELECT 'live' AS split, {_LIVE_DB} AS db_id, * FROM (
    SELECT table_name, column_name, 'metadata' AS row_kind, '' AS value, search_text FROM meta
    UNION ALL SELECT table_name, column_name, 'value', value, value FROM capped))"""

#: Where this application keeps the index of each folder of tables.
_PATHS: dict[tuple[str, str, str], str] = {}


def _stored(t: Tables, name: str) -> StoredIndex:
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _PATHS:
        _PATHS[key] = scratch_path(t.spark, f"index-{name}")
    return StoredIndex(t.spark, _PATHS[key])


def _live_rows(t: Tables):
    scanned = t.once("scanned", lambda: _scanned(t))
    values = index.capped_values(index.distinct_values(index.normalized_values(scanned)))
    metadata = scanned.select(*index.COLUMN).distinct().withColumns(
        {"search_text": index.column_search_text(index.COLUMN), "value_order": F.lit(0)}
    )
    rows = index.index_rows(metadata, values, [*index.COLUMN, "value_order"])
    return rows.select(
        F.lit("live").alias("split"), F.expr(_LIVE_DB).alias("db_id"),
        F.concat_ws(".", *index.COLUMN, "value_order").alias("row_id"),
        *index.COLUMN, "row_kind", "value", "search_text",
    )


@query(
    "e07_index_build",
    with_(_SCAN, _NORMAL, _DISTINCT, _CAPPED, _META_ROWS, _INDEX_ROWS)
    + f"""SELECT split, db_id, table_name, column_name, row_kind, value, CAST(len(toks) AS INTEGER) AS row_length,
  term, CAST(count(*) AS INTEGER) AS tf, list(CAST(i AS INTEGER) ORDER BY i) AS positions FROM (
    SELECT *, unnest(toks) AS term, unnest(range(len(toks))) AS i FROM (
      SELECT *, {_TOKENS.format('search_text')} AS toks FROM index_rows))
  GROUP BY split, db_id, table_name, column_name, row_kind, value, len(toks), term""",
)
def _(t: Tables):
    stored = _stored(t, "live")
    stored.refresh(t.once("live rows", lambda: _live_rows(t)), lambda rows: rows)
    named = stored.rows().select(*retrieval_index.DATABASE, "row_id", *index.COLUMN, "row_kind", "value")
    return stored.postings().join(named, [*retrieval_index.DATABASE, "row_id"]).drop("row_id")


@query(
    "e08_index_statistics",
    with_(_SCAN, _NORMAL, _DISTINCT, _CAPPED, _PER_COLUMN, CATALOG)
    + """SELECT count(DISTINCT db_id) AS database_count, count(*) AS column_count,
  count(*) FILTER (regexp_matches(upper(declared_type), 'TEXT|CHAR|CLOB|DATE|DATETIME'))
    AS value_column_count,
  CAST((SELECT sum(scanned_values) FROM per_column) AS BIGINT) AS scanned_value_count,
  CAST((SELECT sum(indexed_unique_values) FROM per_column) AS BIGINT) AS indexed_unique_value_count
FROM catalog""",
)
def _(t: Tables):
    scanned = t.once("scanned", lambda: _scanned(t))
    values = index.capped_values(index.distinct_values(index.normalized_values(scanned)))
    per_column = index.value_statistics(scanned, values)
    return index.index_statistics(inputs.catalog(t), per_column)


# ---- retrieval over whole documents ---------------------------------------------------

_DEV = "('src16', 'src17', 'src18', 'src19')"
_QUESTION_COLUMNS = [
    "item_id AS question_id",
    "CASE WHEN item_id % 20 >= 16 THEN 'dev' ELSE 'train' END AS split",
    "concat('src', CAST(item_id % 20 AS STRING)) AS db_id",
    "text AS question",
    "CASE item_id % 3 WHEN 0 THEN 'Show the c1_en _list_ of 7 text_in, free_text' "
    "WHEN 1 THEN concat(split_part(text, ' ', 2), '_', split_part(text, ' ', 3)) ELSE '' END AS evidence",
]
_QUESTIONS = f"questions AS (SELECT {', '.join(_QUESTION_COLUMNS)} FROM benchmark)"
_STOPS = "[" + ", ".join(f"'{w}'" for w in text.QUERY_STOP_WORDS) + "]"
_TERMS = rf"""words AS (SELECT question_id, split, db_id, unnest(regexp_extract_all(
    {_FOLD.format("concat_ws(' ', question, evidence)")}, '[\p{{L}}\p{{N}}_]+')) AS w FROM questions),
kept_words AS (SELECT question_id, split, db_id, trim(w, '_') AS w FROM words),
terms AS (SELECT * FROM (SELECT DISTINCT question_id, split, db_id, w AS term,
    array_to_string(regexp_extract_all(strip_accents(w), '[\p{{L}}\p{{N}}]+'), ' ') AS phrase FROM kept_words
    WHERE w <> '' AND NOT list_contains({_STOPS}, w) AND (length(w) > 1 OR regexp_matches(w, '[0-9]')))
  WHERE phrase <> '')"""
_CORPUS = f"""info AS (SELECT DISTINCT CASE WHEN source IN {_DEV} THEN 'dev' ELSE 'train' END AS split,
    source AS db_id, lang AS table_name,
    concat('c', CAST(doc_id % 5 AS STRING)) AS column_name,
    concat('text in ', lang) AS column_description,
    CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN concat('text in ', lang)
         ELSE 'free text' END AS value_description FROM documents),
corpus AS (SELECT CASE WHEN source IN {_DEV} THEN 'dev' ELSE 'train' END AS split, source AS db_id,
    lang AS table_name, concat('c', CAST(doc_id % 5 AS STRING)) AS column_name,
    'value' AS row_kind, concat('v', CAST(doc_id AS STRING)) AS row_id,
    {_LINE.format('text')} AS value, {_LINE.format('text')} AS search_text FROM documents
  UNION ALL SELECT split, db_id, table_name, column_name, 'metadata',
    concat('m', db_id, '.', table_name, '.', column_name), '',
    concat_ws(' ', table_name, column_name, column_description, nullif(value_description, ''))
  FROM info),
tokens AS (SELECT *, {_TOKENS.format('search_text')} AS toks FROM corpus)"""
#: A phrase starts where each of its tokens stands at its own distance from the start.
_SCORES = """asked AS (SELECT question_id, split, db_id, phrase, count(*) AS times FROM terms GROUP BY ALL),
phrase_tokens AS (SELECT phrase, len(ps) AS m, unnest(ps) AS tok, unnest(range(len(ps))) AS k
  FROM (SELECT DISTINCT phrase, string_split(phrase, ' ') AS ps FROM terms)),
places AS (SELECT split, db_id, row_id, len(toks) AS dl, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM tokens),
starts AS (SELECT split, db_id, row_id, dl, phrase, i - k AS s FROM places JOIN phrase_tokens USING (tok)
  GROUP BY ALL HAVING count(*) = max(m)),
posting AS (SELECT split, db_id, row_id, dl, phrase, count(*) AS tf FROM starts GROUP BY ALL),
corpus_size AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM tokens),
spread AS (SELECT phrase, count(*) AS df FROM posting GROUP BY phrase),
weights AS (SELECT phrase, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0
    THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM spread, corpus_size),
scores AS (SELECT q.question_id, p.row_id, round(-sum(q.times * w.idf * p.tf * 2.2e0
    / (p.tf + 1.2e0 * (0.25e0 + 0.75e0 * p.dl / mean))), 9) AS score
  FROM asked q JOIN posting p ON p.split = q.split AND p.db_id = q.db_id AND p.phrase = q.phrase
  JOIN weights w ON w.phrase = q.phrase, corpus_size GROUP BY 1, 2),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score, row_id) AS INTEGER)
  AS hit_rank FROM scores QUALIFY hit_rank <= 512)"""
_ROLLUP = """placed AS (SELECT h.*, c.table_name, c.column_name, c.row_kind, c.value, c.db_id
    FROM hits h JOIN corpus c ON c.row_id = h.row_id),
seen AS (SELECT question_id, table_name, column_name, value, min(hit_rank) AS hit_rank FROM placed
    WHERE row_kind = 'value' AND value <> '' GROUP BY 1, 2, 3, 4),
first_values AS (SELECT * FROM seen QUALIFY row_number() OVER (
    PARTITION BY question_id, table_name, column_name ORDER BY hit_rank) <= 3),
value_lists AS (SELECT question_id, table_name, column_name, list(value ORDER BY hit_rank) AS vs
    FROM first_values GROUP BY 1, 2, 3),
columns_ AS (SELECT p.question_id, p.db_id, p.table_name, p.column_name, min(score) AS score,
    any_value(v.vs) AS vs FROM placed p LEFT JOIN value_lists v ON v.question_id = p.question_id
    AND v.table_name = p.table_name AND v.column_name = p.column_name GROUP BY 1, 2, 3, 4)"""
_TOP = """top_ AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id
    ORDER BY score, table_name, column_name) AS INTEGER) AS position FROM columns_
  QUALIFY position <= 8)"""
_LINES = """lines AS (SELECT t.*, concat('- "', t.table_name, '"."', t.column_name, '": ',
    concat_ws(' | ', i.column_description,
      CASE WHEN i.value_description <> '' AND i.value_description <> i.column_description
           THEN concat('value notes: ', i.value_description) END,
      CASE WHEN len(t.vs) > 0 THEN concat('matched values: ', array_to_string(
        [CAST(to_json(v) AS STRING) for v in t.vs], ', ')) END)) AS line
  FROM top_ t JOIN info i ON i.db_id = t.db_id AND i.table_name = t.table_name
    AND i.column_name = t.column_name)"""

_SCOPE = ["split", "db_id"]


def _questions(t: Tables):
    return t.benchmark.selectExpr(*_QUESTION_COLUMNS)


def _info(documents):
    return documents.selectExpr(
        "split",
        "db_id",
        "lang AS table_name",
        "concat('c', CAST(doc_id % 5 AS STRING)) AS column_name",
        "concat('text in ', lang) AS column_description",
        "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN concat('text in ', lang) "
        "ELSE 'free text' END AS value_description",
        "'' AS data_format",
    ).distinct()


def _databases(t: Tables):
    """The documents as the tables and columns of one database per source."""
    split = f"CASE WHEN source IN {_DEV} THEN 'dev' ELSE 'train' END AS split"
    return t.documents.selectExpr(split, "source AS db_id", "doc_id", "lang", "text")


def _corpus_rows(documents):
    line = text.one_line(F.col("text"))
    scope = ["split", "db_id", "table_name", "column_name", "row_id"]
    values = documents.select(
        "split", "db_id", F.col("lang").alias("table_name"),
        F.expr("concat('c', CAST(doc_id % 5 AS STRING))").alias("column_name"),
        F.expr("concat('v', CAST(doc_id AS STRING))").alias("row_id"),
        line.alias("value"),
    )
    parts = ["table_name", "column_name", "column_description", "value_description"]
    metadata = _info(documents).select(
        "split", "db_id", "table_name", "column_name",
        F.concat(F.lit("m"), F.concat_ws(".", "db_id", "table_name", "column_name")).alias("row_id"),
        index.column_search_text(parts).alias("search_text"),
    )
    return index.index_rows(metadata, values, scope)


def _corpus(t: Tables) -> StoredIndex:
    """The stored index, brought up to the documents: only changed databases are written."""
    stored = _stored(t, "corpus")
    if "corpus" not in t.kept:
        t.kept["corpus"] = stored.refresh(_databases(t), _corpus_rows)
    return stored


def _terms(t: Tables):
    return retrieval_index.question_phrases(_questions(t), "question_id")


def _hits(t: Tables):
    return retrieval_index.best_rows(_terms(t), _corpus(t), "question_id", index.hit_limit())


def _columns(t: Tables):
    return index.column_hits(_hits(t), _corpus(t).rows(), "question_id", "row_id")


def _digests():
    return F.array_join(F.transform("matched_values", lambda v: F.md5(v)), ",").alias("value_digests")


@query("e09_query_terms", with_(_QUESTIONS, _TERMS) + "SELECT * FROM terms")
def _(t: Tables):
    return _terms(t)


@query(
    "e10_bm25",
    with_(_QUESTIONS, _TERMS, _CORPUS, _SCORES)
    + "SELECT question_id, row_id, score, hit_rank FROM hits",
)
def _(t: Tables):
    return _hits(t)


_VALUE_DIGESTS = "coalesce(array_to_string([md5(v) for v in vs], ','), '') AS value_digests"


@query(
    "e11_column_rollup",
    with_(_QUESTIONS, _TERMS, _CORPUS, _SCORES, _ROLLUP)
    + f"SELECT question_id, table_name, column_name, score, {_VALUE_DIGESTS} FROM columns_",
)
def _(t: Tables):
    return _columns(t).select(
        "question_id", "table_name", "column_name", "score", _digests()
    )


@query(
    "e12_top_columns",
    with_(_QUESTIONS, _TERMS, _CORPUS, _SCORES, _ROLLUP, _TOP)
    + "SELECT question_id, position, table_name, column_name, score FROM top_",
)
def _(t: Tables):
    return index.top_columns(_columns(t), "question_id").select(
        "question_id", "position", "table_name", "column_name", "score"
    )


def _lines(t: Tables):
    top = index.top_columns(_columns(t), "question_id")
    scoped = top.join(_questions(t).select("question_id", *_SCOPE), "question_id")
    return index.enrich(scoped, _info(_databases(t)), _SCOPE)


_ALL = with_(_QUESTIONS, _TERMS, _CORPUS, _SCORES, _ROLLUP, _TOP, _LINES)


@query("e13_grounding_lines", _ALL + "SELECT question_id, position, md5(line) AS line_digest FROM lines")
def _(t: Tables):
    return _lines(t).select("question_id", "position", F.md5("line").alias("line_digest"))


@query(
    "e14_coverage",
    _ALL
    + """, per AS (SELECT question_id, count(*) AS nc, sum(coalesce(len(vs), 0)) AS nv FROM top_ GROUP BY 1)
SELECT CASE WHEN q.question_id % 2 = 0 THEN 'train' ELSE 'dev' END AS split, count(*) AS sample_count,
  count(DISTINCT q.db_id) AS database_count, count(*) FILTER (coalesce(nc, 0) > 0) AS samples_with_grounding,
  count(*) FILTER (coalesce(nc, 0) = 0) AS samples_without_grounding,
  CAST(coalesce(sum(nc), 0) AS BIGINT) AS retrieved_column_count,
  CAST(coalesce(sum(nv), 0) AS BIGINT) AS matched_value_count,
  coalesce(max(nc), 0) AS maximum_columns_per_sample,
  CAST(coalesce(max(nv), 0) AS BIGINT) AS maximum_values_per_sample
FROM questions q LEFT JOIN per p ON p.question_id = q.question_id GROUP BY 1""",
)
def _(t: Tables):
    samples = _questions(t).withColumn(
        "split", F.expr("CASE WHEN question_id % 2 = 0 THEN 'train' ELSE 'dev' END")
    )
    hits = index.top_columns(_columns(t), "question_id")
    return index.coverage(samples, hits, "question_id", "split")


_GOLD = (
    "concat('SELECT count(*) FROM documents WHERE source = ', chr(39), db_id, chr(39), "
    "' AND doc_id > ', CAST(question_id AS STRING))"
)
_SAMPLES = f"samples AS (SELECT *, {_GOLD} AS gold_sql FROM questions)"
_SCHEMA = """schemas AS (SELECT db_id, string_agg(section, chr(10) || chr(10) ORDER BY table_name) AS schema FROM (
    SELECT db_id, table_name, concat('TABLE "', table_name, '"', chr(10),
      string_agg(concat('- "', column_name, '" TEXT'), chr(10) ORDER BY column_name)) AS section
    FROM (SELECT DISTINCT db_id, table_name, column_name FROM info) GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "f07_grounded_dataset",
    _ALL
    + f""", {_SAMPLES}, {_SCHEMA}, grounded AS (SELECT question_id, string_agg(line, chr(10) ORDER BY position) AS block
    FROM lines GROUP BY 1)
SELECT q.question_id, q.db_id, md5(concat('Database schema:', chr(10), s.schema,
  CASE WHEN g.block IS NULL THEN '' ELSE concat(chr(10), chr(10), 'Relevant database information:',
  chr(10), g.block) END, CASE WHEN q.evidence <> '' THEN concat(chr(10), chr(10), 'Evidence:',
  chr(10), q.evidence) ELSE '' END, chr(10), chr(10), 'Question:', chr(10), trim(q.question)))
  AS prompt_digest, md5(concat('```sql', chr(10), q.gold_sql, chr(10), '```')) AS completion_digest
  FROM samples q JOIN schemas s ON s.db_id = q.db_id LEFT JOIN grounded g ON g.question_id = q.question_id""",
)
def _(t: Tables):
    samples = _questions(t).withColumn("gold_sql", F.expr(_GOLD))
    records = datasets.build_grounded(samples, _schemas(t), _lines(t), "question_id")
    return records.select(
        "question_id", "db_id",
        F.md5(F.element_at("prompt", 2)["content"]).alias("prompt_digest"),
        F.md5(F.element_at("completion", 1)["content"]).alias("completion_digest"),
    )


def _schemas(t: Tables):
    """Rendered schema of every database of the corpus."""
    columns = _info(_databases(t)).select("db_id", "table_name", "column_name").distinct()
    in_db = Window.partitionBy("db_id").orderBy("table_name")  # one row per column of a database
    in_table = Window.partitionBy("db_id", "table_name").orderBy("column_name")
    full = columns.select(
        "*", F.dense_rank().over(in_db).alias("table_ordinal"), F.col("table_name").alias("table_display"),
        F.row_number().over(in_table).alias("ordinal"), F.col("column_name").alias("column_display"),
        F.lit("text").alias("declared_type"), F.lit(False).alias("is_primary_key"),
    )
    no_keys = t.spark.createDataFrame(
        [], "db_id string, table_ordinal int, key_ordinal int, source_table string, source_column string, "
        "target_table string, target_column string",
    )
    return catalog.render(full, no_keys)


_CHANGED = "src3"


@query(
    "e07_index_refresh",
    with_(_CORPUS)
    + f"""SELECT split, db_id, CAST(CASE WHEN db_id = '{_CHANGED}' THEN 2 ELSE 1 END AS BIGINT) AS written_by,
  count(*) AS row_count, CAST(sum(len(toks) + CASE WHEN db_id = '{_CHANGED}' AND row_kind = 'value' THEN 1 ELSE 0 END)
    AS BIGINT) AS token_count FROM tokens GROUP BY split, db_id""",
)
def _(t: Tables):
    """A second refresh, after one source got a word more per document, writes that database alone."""
    stored = StoredIndex(t.spark, scratch_path(t.spark, "index-refreshed"))
    documents = _databases(t)
    stored.refresh(documents, _corpus_rows)
    longer = F.when(F.col("db_id") == _CHANGED, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    stored.refresh(documents.withColumn("text", longer), _corpus_rows)
    return stored.state().drop("fingerprint")
