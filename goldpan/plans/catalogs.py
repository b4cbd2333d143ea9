"""Schema catalogs (family B): customers stand for databases, orders for tables, line items
for columns, so every catalog here grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..session import shuffles_freed
from . import inputs
from .inputs import CATALOG, CATALOG_FK, METADATA, SAMPLES, with_
from .registry import Tables, query

_IDS = (
    "CASE WHEN o_orderkey % 50 = 0 THEN '  ' WHEN o_orderkey % 51 = 0 THEN NULL "
    "ELSE concat('db_', CAST(o_custkey AS STRING)) END AS db_id"
)
_SPLIT = "CASE WHEN o_orderkey % 4 = 0 THEN 'dev' ELSE 'train' END AS split"


@query(
    "b01_database_ids",
    f"""WITH s AS (SELECT {_IDS}, {_SPLIT} FROM orders)
SELECT DISTINCT split, db_id FROM s WHERE trim(db_id) <> ''""",
)
def _(t: Tables):
    return cat.database_ids(t.orders.selectExpr(_IDS, _SPLIT))[0]


@query(
    "b01_invalid_ids",
    f"""WITH s AS (SELECT o_orderkey, {_IDS}, {_SPLIT} FROM orders)
SELECT o_orderkey, split FROM s WHERE coalesce(trim(db_id), '') = ''""",
)
def _(t: Tables):
    return cat.database_ids(t.orders.selectExpr("o_orderkey", _IDS, _SPLIT))[1].select(
        "o_orderkey", "split"
    )


_INTERNAL = "CASE WHEN o_orderstatus = 'P' THEN concat('T', CAST(o_orderkey AS STRING)) ELSE 'sqlite_sequence' END AS table_name"
_DB = "concat('db_', CAST(o_custkey AS STRING)) AS db_id"


@query(
    "b02_has_user_table",
    f"""WITH s AS (SELECT {_DB}, {_INTERNAL} FROM orders)
SELECT db_id, bool_or(NOT starts_with(table_name, 'sqlite_')) AS has_user_table FROM s GROUP BY 1""",
)
def _(t: Tables):
    return cat.has_user_table(t.orders.selectExpr(_DB, _INTERNAL))


#: Found files: some customers have two, some lie elsewhere, some cannot be read, some are empty.
_FILES = """SELECT concat('db_', CAST(c_custkey AS STRING)) AS db_id,
  concat('/data/', CAST(c_custkey AS STRING), '/', c_mktsegment) AS path,
  c_custkey % 7 <> 0 AS in_place, c_custkey % 11 <> 0 AS readable,
  CAST(c_custkey % 13 AS BIGINT) AS user_tables FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL SELECT concat('db_', CAST(c_custkey AS STRING)), concat('/copy/', CAST(c_custkey AS STRING)),
  true, true, CAST(1 AS BIGINT) FROM customer WHERE c_nationkey = 3"""


def _files(t: Tables):
    first = t.customer.where("c_mktsegment <> 'MACHINERY'").selectExpr(
        "concat('db_', CAST(c_custkey AS STRING)) AS db_id",
        "concat('/data/', CAST(c_custkey AS STRING), '/', c_mktsegment) AS path",
        "c_custkey % 7 <> 0 AS in_place", "c_custkey % 11 <> 0 AS readable",
        "CAST(c_custkey % 13 AS BIGINT) AS user_tables",
    )
    copies = t.customer.where("c_nationkey = 3").selectExpr(
        "concat('db_', CAST(c_custkey AS STRING)) AS db_id",
        "concat('/copy/', CAST(c_custkey AS STRING)) AS path",
        "true AS in_place", "true AS readable", "CAST(1 AS BIGINT) AS user_tables",
    )
    return first.unionByName(copies)


@query(
    "b03_database_resolution",
    f"""WITH files AS ({_FILES}), expected AS (SELECT DISTINCT {_DB} FROM orders),
found AS (SELECT db_id, count(*) AS n, bool_and(in_place) AS p, bool_and(readable) AS r,
  sum(user_tables) AS u FROM files GROUP BY db_id),
j AS (SELECT e.db_id, f.n, f.p, f.r, f.u FROM expected e LEFT JOIN found f ON f.db_id = e.db_id)
SELECT db_id, 'not_found' AS issue FROM j WHERE n IS NULL
UNION ALL SELECT db_id, 'multiple_files' FROM j WHERE n > 1
UNION ALL SELECT db_id, 'wrong_location' FROM j WHERE n = 1 AND NOT p
UNION ALL SELECT db_id, 'unreadable' FROM j WHERE n = 1 AND NOT r
UNION ALL SELECT db_id, 'no_user_tables' FROM j WHERE n = 1 AND r AND u = 0""",
)
def _(t: Tables):
    expected = t.orders.selectExpr(_DB).distinct()
    return cat.resolve_databases(expected, _files(t), ["db_id"])


@query(
    "b04_split_isolation",
    f"""WITH s AS (SELECT {_DB}, {_SPLIT} FROM orders)
SELECT db_id FROM s WHERE split = 'train' INTERSECT SELECT db_id FROM s WHERE split = 'dev'""",
)
def _(t: Tables):
    return cat.shared_databases(t.orders.selectExpr(_DB, _SPLIT), "train", "dev")


@query(
    "b05_coverage_gaps",
    f"""WITH a AS (SELECT DISTINCT db_id FROM ({_FILES})), b AS (SELECT DISTINCT concat('db_',
  CAST(o_custkey + 10 AS STRING)) AS db_id FROM orders)
SELECT db_id, 'left' AS missing_from FROM b WHERE db_id NOT IN (SELECT db_id FROM a)
UNION ALL SELECT db_id, 'right' FROM a WHERE db_id NOT IN (SELECT db_id FROM b)""",
)
def _(t: Tables):
    wanted = t.orders.selectExpr("concat('db_', CAST(o_custkey + 10 AS STRING)) AS db_id")
    return cat.coverage_gaps(_files(t), wanted, ["db_id"])


# ---- metadata documents ---------------------------------------------------------------

#: The documents of ``METADATA`` taken apart; independent of how Spark parses them.
_DOCS = """docs AS (SELECT doc_index, raw->>'db_id' AS db_id,
    from_json(raw->'table_names_original', '["VARCHAR"]') AS tno,
    from_json(raw->'table_names', '["VARCHAR"]') AS tn,
    from_json(raw->'column_names_original', '["JSON"]') AS cno,
    from_json(raw->'column_names', '["JSON"]') AS cn,
    from_json(raw->'column_types', '["VARCHAR"]') AS ct,
    from_json(raw->'primary_keys', '["JSON"]') AS pk,
    from_json(raw->'foreign_keys', '["JSON"]') AS fk
  FROM (SELECT doc_index, CAST(raw AS JSON) AS raw FROM metadata)),
names AS (SELECT doc_index, db_id, tno, tn, cno, ct, cn, unnest(range(len(cno))) AS i FROM docs),
cols AS (SELECT doc_index, db_id, CAST(i AS INTEGER) AS column_index,
    CAST(cno[i + 1]->>0 AS INTEGER) AS table_index, tno[CAST(cno[i + 1]->>0 AS INTEGER) + 1] AS table_name,
    tn[CAST(cno[i + 1]->>0 AS INTEGER) + 1] AS table_display, cno[i + 1]->>1 AS column_name,
    cn[i + 1]->>1 AS column_display, ct[i + 1] AS declared_type, len(tno) AS nt FROM names)"""


def _parsed(t: Tables):
    return cat.parse_metadata(inputs.metadata(t), "raw")


@query(
    "b06_metadata_columns",
    with_(METADATA, _DOCS)
    + """SELECT doc_index, db_id, column_index, table_index, table_name, table_display, column_name,
  column_display, declared_type FROM cols WHERE column_index > 0""",
)
def _(t: Tables):
    return cat.metadata_columns(_parsed(t), "doc_index")


@query(
    "b06_metadata_issues",
    with_(METADATA, _DOCS)
    + """SELECT doc_index, 'column_lengths_differ' AS rule FROM docs WHERE len(cno) <> len(cn) OR len(cno) <> len(ct)
UNION ALL SELECT doc_index, 'table_lengths_differ' FROM docs WHERE len(tno) <> len(tn)
UNION ALL SELECT DISTINCT doc_index, 'table_index_out_of_range' FROM cols
  WHERE column_index > 0 AND (table_index < 0 OR table_index >= nt)""",
)
def _(t: Tables):
    return cat.metadata_issues(_parsed(t), "doc_index")


@query(
    "b07_primary_keys",
    with_(METADATA, _DOCS)
    + """, keys AS (SELECT doc_index, db_id, unnest(range(len(pk))) AS o, pk FROM docs),
each AS (SELECT doc_index, db_id, CAST(o AS INTEGER) AS key_ordinal, CASE WHEN json_type(pk[o + 1]) = 'ARRAY'
    THEN from_json(pk[o + 1], '["INTEGER"]') ELSE [CAST(pk[o + 1] AS INTEGER)] END AS ids FROM keys),
parts AS (SELECT e.*, unnest(ids) AS cid, unnest(range(len(ids))) AS place FROM each e),
joined AS (SELECT p.doc_index, p.db_id, p.key_ordinal, any_value(ids) AS ids, count(DISTINCT c.table_index) AS nt,
    count(c.column_index) AS found, any_value(c.table_name) AS table_name,
    string_agg(c.column_name, ',' ORDER BY place) AS key_columns
  FROM parts p LEFT JOIN cols c ON c.doc_index = p.doc_index AND c.column_index = p.cid GROUP BY 1, 2, 3),
judged AS (SELECT *, CASE WHEN len(list_distinct(ids)) <> len(ids) THEN 'repeated_column'
    WHEN found <> len(ids) THEN 'column_out_of_range' WHEN nt <> 1 THEN 'columns_in_several_tables' END AS issue
  FROM joined)
SELECT doc_index, db_id, key_ordinal, CASE WHEN issue IS NULL THEN table_name END AS table_name,
  CASE WHEN issue IS NULL THEN key_columns END AS key_columns, issue FROM judged""",
)
def _(t: Tables):
    return cat.metadata_primary_keys(_parsed(t), "doc_index")


@query(
    "b08_foreign_keys",
    with_(METADATA, _DOCS)
    + """, keys AS (SELECT doc_index, db_id, CAST(unnest(range(len(fk))) AS INTEGER) AS o, fk FROM docs),
pairs AS (SELECT doc_index, db_id, o AS key_ordinal, CAST(fk[o + 1]->>0 AS INTEGER) AS s,
    CAST(fk[o + 1]->>1 AS INTEGER) AS d FROM keys),
good AS (SELECT p.doc_index, p.db_id, a.table_name AS source_table, a.column_name AS source_column,
    b.table_name AS target_table, b.column_name AS target_column, min(p.key_ordinal) AS key_ordinal
  FROM pairs p JOIN cols a ON a.doc_index = p.doc_index AND a.column_index = p.s
  JOIN cols b ON b.doc_index = p.doc_index AND b.column_index = p.d
  WHERE p.s > 0 AND p.d > 0 GROUP BY 1, 2, 3, 4, 5, 6)
SELECT *, NULL AS issue FROM good
UNION ALL SELECT doc_index, db_id, NULL, NULL, NULL, NULL, key_ordinal, 'source_out_of_range'
FROM pairs WHERE s <= 0""",
)
def _(t: Tables):
    return cat.metadata_foreign_keys(_parsed(t), "doc_index")


# ---- names ----------------------------------------------------------------------------


@query(
    "b09_duplicate_names",
    """SELECT p_brand, p_name, p_partkey AS second_use FROM part QUALIFY
  row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) = 2""",
)
def _(t: Tables):
    return cat.duplicate_names(t.part, ["p_brand"], "p_name", "p_partkey")


_KEY = "CAST(p_partkey AS STRING)"
_OURS = (
    f"CASE p_partkey % 6 WHEN 4 THEN concat('É', {_KEY}) ELSE concat('Name_', {_KEY}) END AS name"
)
_THEIRS = (
    f"CASE p_partkey % 6 WHEN 0 THEN concat('Name_', {_KEY}) WHEN 1 THEN concat('NAME_', {_KEY}) "
    f"WHEN 2 THEN concat('other_', {_KEY}) WHEN 3 THEN concat('name_', {_KEY}) "
    f"WHEN 4 THEN concat('é', {_KEY}) ELSE concat('nAME_', {_KEY}) END AS name"
)
_CLASH = f"concat('Name_', {_KEY}) AS name"
_LIVE = f"SELECT p_brand AS scope, {_THEIRS} FROM part UNION ALL SELECT p_brand, {_CLASH} FROM part WHERE p_type = 'ECONOMY'"
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _live(t: Tables):
    return t.part.selectExpr("p_brand AS scope", _THEIRS).unionByName(
        t.part.where("p_type = 'ECONOMY'").selectExpr("p_brand AS scope", _CLASH)
    )


@query(
    "b10_case_collisions",
    f"""WITH live AS ({_LIVE}), n AS (SELECT DISTINCT scope, name, {_ASCII.format('name')} AS folded_name FROM live)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY scope, folded_name) AS spellings FROM n) WHERE spellings > 1""",
)
def _(t: Tables):
    return cat.case_collisions(_live(t), ["scope"], "name")


@query(
    "b11_name_matching",
    f"""WITH ours AS (SELECT DISTINCT p_brand AS scope, {_OURS} FROM part),
theirs AS (SELECT DISTINCT scope, name FROM ({_LIVE})),
exact AS (SELECT * FROM ours INTERSECT SELECT * FROM theirs),
ro AS (SELECT *, {_ASCII.format('name')} AS f FROM (SELECT * FROM ours EXCEPT SELECT * FROM exact)),
rt AS (SELECT *, {_ASCII.format('name')} AS f FROM (SELECT * FROM theirs EXCEPT SELECT * FROM exact)),
o1 AS (SELECT * FROM ro QUALIFY count(*) OVER (PARTITION BY scope, f) = 1),
t1 AS (SELECT * FROM rt QUALIFY count(*) OVER (PARTITION BY scope, f) = 1),
folded AS (SELECT o1.scope, o1.name, t1.name AS live_name FROM o1 JOIN t1 ON o1.scope = t1.scope AND o1.f = t1.f)
SELECT scope, name, name AS live_name, 'exact' AS how FROM exact
UNION ALL SELECT *, 'folded' FROM folded
UNION ALL SELECT scope, name, NULL, 'missing_in_live' FROM ro
  WHERE (scope, name) NOT IN (SELECT (scope, name) FROM folded)
UNION ALL SELECT scope, NULL, name, 'missing_in_catalog' FROM rt
  WHERE (scope, name) NOT IN (SELECT (scope, live_name) FROM folded)""",
)
def _(t: Tables):
    ours = t.part.selectExpr("p_brand AS scope", _OURS)
    return cat.match_names(ours, _live(t), ["scope"])


_FOURTEEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    "b12_live_schema",
    "WITH counts AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in _FOURTEEN)
    + """) SELECT c.table_name, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name,
  CASE data_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'INTEGER' THEN 'INT' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ'
    WHEN 'FLOAT[]' THEN 'ARRAY<FLOAT>' ELSE data_type END AS declared_type, k.row_count
FROM information_schema.columns c JOIN counts k ON k.table_name = c.table_name""",
)
def _(t: Tables):
    return cat.live_schema({n: getattr(t, n) for n in _FOURTEEN})


@query(
    "b13_file_coverage",
    f"""WITH files AS (SELECT path FROM ({_FILES}) UNION ALL SELECT path FROM ({_FILES}) WHERE NOT in_place),
refs AS (SELECT concat('/data/', CAST(o_custkey AS STRING), '/BUILDING') AS path FROM orders
  WHERE o_orderstatus = 'P'),
r AS (SELECT path, count(*) AS n FROM refs GROUP BY 1), f AS (SELECT path, count(*) AS n FROM files GROUP BY 1)
SELECT path, 'missing_file' AS issue FROM r WHERE path NOT IN (SELECT path FROM f)
UNION ALL SELECT path, 'extra_file' FROM f WHERE path NOT IN (SELECT path FROM r)
UNION ALL SELECT path, 'duplicate_reference' FROM r WHERE n > 1
UNION ALL SELECT path, 'duplicate_file' FROM f WHERE n > 1""",
)
def _(t: Tables):
    files = _files(t)
    twice = files.select("path").unionByName(files.where("NOT in_place").select("path"))
    refs = t.orders.where("o_orderstatus = 'P'").selectExpr(
        "concat('/data/', CAST(o_custkey AS STRING), '/BUILDING') AS path"
    )
    return cat.file_coverage(refs, twice)


_MAPPING = """mapping AS (SELECT DISTINCT db_id, table_name, column_name, upper(table_name) AS live_table,
  CASE WHEN part_ref % 4 = 0 THEN 'shared' ELSE upper(column_name) END AS live_column FROM catalog)"""


def _mapping(t: Tables):
    return inputs.catalog(t).selectExpr(
        "db_id", "table_name", "column_name", "upper(table_name) AS live_table",
        "CASE WHEN part_ref % 4 = 0 THEN 'shared' ELSE upper(column_name) END AS live_column",
    ).distinct()


@query(
    "b14_apply_names",
    with_(CATALOG, _MAPPING)
    + """SELECT c.db_id, m.live_table AS table_name, m.live_column AS column_name, c.ordinal, c.is_primary_key
FROM catalog c JOIN mapping m ON m.db_id = c.db_id AND m.table_name = c.table_name
  AND m.column_name = c.column_name""",
)
def _(t: Tables):
    return cat.apply_names(inputs.catalog(t), _mapping(t)).select(
        "db_id", "table_name", "column_name", "ordinal", "is_primary_key"
    )


_SOME = "ordinal % 5 <> 2"


@query(
    "b14_unmapped_names",
    with_(CATALOG, _MAPPING)
    + f"""SELECT c.db_id, c.table_name, c.column_name, c.ordinal, 'unmapped_column' AS issue FROM catalog c
WHERE NOT EXISTS (SELECT 1 FROM mapping m JOIN catalog k USING (db_id, table_name, column_name)
  WHERE k.{_SOME} AND m.db_id = c.db_id AND m.table_name = c.table_name AND m.column_name = c.column_name)""",
)
def _(t: Tables):
    catalog, names = inputs.catalog(t), ["db_id", "table_name", "column_name"]
    known = _mapping(t).join(catalog.where(_SOME).select(*names), names, "left_semi")
    return cat.unmapped_names(catalog, known).select(*names, "ordinal", "issue")


@query(
    "b14_apply_names_to_keys",
    with_(CATALOG, CATALOG_FK, _MAPPING)
    + """SELECT k.db_id, s.live_table AS source_table, s.live_column AS source_column,
  d.live_table AS target_table, d.live_column AS target_column, min(k.key_ordinal) AS key_ordinal
FROM catalog_fk k JOIN mapping s ON s.db_id = k.db_id AND s.table_name = k.source_table
  AND s.column_name = k.source_column
JOIN mapping d ON d.db_id = k.db_id AND d.table_name = k.target_table AND d.column_name = k.target_column
GROUP BY 1, 2, 3, 4, 5""",
)
def _(t: Tables):
    return cat.apply_names_to_keys(inputs.catalog_fk(t), _mapping(t))


@query(
    "b15_object_counts",
    with_(CATALOG)
    + """SELECT split, count(DISTINCT db_id) AS databases, count(DISTINCT (db_id, table_name)) AS tables,
  count(*) AS columns FROM catalog GROUP BY split""",
)
def _(t: Tables):
    return cat.object_counts(inputs.catalog(t))


_EXAMPLES = "concat('db_', CAST(o_custkey + 3 AS STRING)) AS db_id, o_orderpriority AS question, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS evidence"


def _examples(t: Tables):
    return t.orders.selectExpr(
        "concat('db_', CAST(o_custkey + 3 AS STRING)) AS db_id", "o_orderpriority AS question",
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS evidence",
    )


@query(
    "b16_registry",
    with_(CATALOG, f"examples AS (SELECT {_EXAMPLES} FROM orders)")
    + """SELECT c.split, c.db_id, count(DISTINCT table_name) AS table_count, count(*) AS column_count,
  coalesce(any_value(n), 0) AS example_count FROM catalog c
LEFT JOIN (SELECT db_id, count(*) AS n FROM examples GROUP BY 1) e ON e.db_id = c.db_id GROUP BY 1, 2""",
)
def _(t: Tables):
    return cat.registry(inputs.catalog(t), _examples(t))


@query(
    "b16_registry_examples",
    with_(CATALOG, f"examples AS (SELECT {_EXAMPLES} FROM orders)")
    + """SELECT e.db_id, e.question, coalesce(e.evidence, '') AS evidence, k.split FROM examples e
JOIN (SELECT DISTINCT split, db_id FROM catalog) k ON k.db_id = e.db_id""",
)
def _(t: Tables):
    return cat.registry_examples(inputs.catalog(t), _examples(t))


@query(
    "b18_catalog_search",
    with_(CATALOG)
    + """SELECT db_id, table_name, table_display FROM catalog GROUP BY ALL
HAVING contains(lower(concat_ws(' ', table_name, table_display, string_agg(concat_ws(' ', column_name,
  column_display, declared_type), ' ' ORDER BY ordinal))), 'text col_2')""",
)
def _(t: Tables):
    return cat.search_tables(inputs.catalog(t), "TEXT col_2")


@query(
    "b18_database_search",
    with_(CATALOG) + "SELECT DISTINCT db_id FROM catalog WHERE contains(db_id, '_12')",
)
def _(t: Tables):
    return cat.search_databases(inputs.catalog(t), "_12")


@query(
    "b19_integrity",
    with_(CATALOG, CATALOG_FK)
    + """, pk AS (SELECT db_id, table_name, CASE WHEN part_ref % 8 = 0 THEN 'lost' ELSE column_name END AS column_name
    FROM catalog WHERE is_primary_key),
known AS (SELECT DISTINCT db_id, table_name, column_name FROM catalog)
SELECT db_id, 'duplicate_column' AS issue, concat_ws('.', table_name, column_name) AS name FROM catalog
  GROUP BY db_id, table_name, column_name HAVING count(*) > 1
UNION ALL SELECT db_id, 'target_does_not_exist', concat_ws('.', target_table, target_column) FROM catalog_fk k
  WHERE NOT EXISTS (SELECT 1 FROM known n WHERE n.db_id = k.db_id AND n.table_name = k.target_table
    AND n.column_name = k.target_column)
UNION ALL SELECT db_id, 'duplicate_foreign_key', concat_ws('.', source_table, source_column) FROM catalog_fk
  GROUP BY db_id, source_table, source_column, target_table, target_column HAVING count(*) > 1
UNION ALL SELECT db_id, 'primary_key_does_not_exist', concat_ws('.', table_name, column_name) FROM pk k
  WHERE NOT EXISTS (SELECT 1 FROM known n WHERE n.db_id = k.db_id AND n.table_name = k.table_name
    AND n.column_name = k.column_name)""",
)
def _(t: Tables):
    columns = inputs.catalog(t)
    primary = columns.where("is_primary_key").selectExpr(
        "db_id", "table_name",
        "CASE WHEN part_ref % 8 = 0 THEN 'lost' ELSE column_name END AS column_name",
    )
    return cat.integrity_issues(columns, inputs.catalog_fk(t), primary)


_RENDER = r"""lines AS (SELECT db_id, table_ordinal, table_name, any_value(table_display) AS table_display,
    count(*) FILTER (is_primary_key) AS keys,
    string_agg(concat('- "', column_name, '" ', upper(declared_type), '{PK', CAST(is_primary_key AS STRING), '}',
      CASE WHEN column_display <> column_name THEN concat(' -- ', trim(regexp_replace(column_display, '\s+', ' ', 'g')))
      ELSE '' END), chr(10) ORDER BY ordinal) AS body,
    string_agg(concat('"', column_name, '"'), ', ' ORDER BY ordinal) FILTER (is_primary_key) AS key_names
  FROM catalog GROUP BY 1, 2, 3),
tables_ AS (SELECT db_id, 0 AS part, table_ordinal AS place, concat('TABLE "', table_name, '"',
    CASE WHEN table_display <> table_name THEN concat(' -- ', table_display) ELSE '' END, chr(10),
    replace(replace(body, '{PKfalse}', ''), '{PKtrue}', CASE WHEN keys = 1 THEN ' [PRIMARY KEY]' ELSE '' END),
    CASE WHEN keys > 1 THEN concat(chr(10), 'PRIMARY KEY (', key_names, ')') ELSE '' END) AS section FROM lines),
fks AS (SELECT db_id, 1 AS part, 0 AS place, concat('FOREIGN KEY', chr(10), string_agg(concat('"', source_table,
    '"."', source_column, '" -> "', target_table, '"."', target_column, '"'), chr(10)
    ORDER BY table_ordinal, key_ordinal)) AS section FROM catalog_fk GROUP BY db_id)
SELECT db_id, md5(string_agg(section, chr(10) || chr(10) ORDER BY part, place)) AS schema_digest,
  CAST(sum(length(section)) + 2 * (count(*) - 1) AS INTEGER) AS schema_length
FROM (SELECT * FROM tables_ UNION ALL SELECT * FROM fks) GROUP BY db_id"""


@query("b20_schema_text", with_(CATALOG, CATALOG_FK, _RENDER))
def _(t: Tables):
    return cat.render(inputs.catalog(t), inputs.catalog_fk(t)).select(
        "db_id", F.md5("schema").alias("schema_digest"), F.length("schema").alias("schema_length")
    )


# Description rows: the file of every fourth table has another name; some rows repeat.
_DESCRIBED = (
    "db_id",
    "CASE WHEN table_ordinal % 4 = 0 THEN concat('notes_', CAST(table_ordinal AS STRING)) "
    "ELSE lower(table_name) END AS file",
    "CASE WHEN part_ref % 5 = 0 THEN '' ELSE upper(column_name) END AS original_column_name",
    "concat('about ', declared_type) AS column_description",
    "CASE WHEN part_ref % 3 = 0 THEN '' ELSE 'coded' END AS value_description",
    "declared_type AS data_format",
    "ordinal AS row_ordinal",
)
_REPEATS = [c for c in _DESCRIBED]
_REPEATS[3] = "'later note' AS column_description"
_REPEATS[6] = "ordinal + 1 AS row_ordinal"
_DESCRIBED_SQL = (
    f"described AS (SELECT {', '.join(_DESCRIBED)} FROM catalog UNION ALL "
    f"SELECT {', '.join(_REPEATS)} FROM catalog WHERE declared_type = 'date')"
)
_MAPPED = """tabs AS (SELECT DISTINCT db_id, table_name, table_ordinal FROM catalog),
exact AS (SELECT DISTINCT t.db_id, t.table_name, d.file FROM tabs t JOIN described d
  ON d.db_id = t.db_id AND lower(t.table_name) = lower(d.file)),
overlap AS (SELECT t.db_id, t.table_name, d.file, count(DISTINCT lower(c.column_name)) AS score
  FROM tabs t JOIN catalog c ON c.db_id = t.db_id AND c.table_name = t.table_name
  JOIN described d ON d.db_id = t.db_id AND lower(d.original_column_name) = lower(c.column_name)
  WHERE (t.db_id, t.table_name) NOT IN (SELECT (db_id, table_name) FROM exact)
    AND (d.db_id, d.file) NOT IN (SELECT (db_id, file) FROM exact) GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY db_id, table_name ORDER BY score DESC) AS rn,
  count(*) OVER (PARTITION BY db_id, table_name, score) AS ties FROM overlap),
mapped AS (SELECT *, 'name' AS how FROM exact UNION ALL
  SELECT db_id, table_name, file, 'overlap' FROM best WHERE rn = 1 AND ties = 1)"""


def _catalog(t: Tables):
    """The catalog from its joined rows, kept as the numbers it is derived from: several passes read it."""
    with shuffles_freed(t.spark):
        return inputs.derived_catalog(t.once("catalog rows", lambda: inputs.catalog_rows(t)))


def _described(columns):
    """Both kinds of rows in one pass over the columns."""
    kinds = F.expr(
        "CASE WHEN declared_type = 'date' THEN "
        f"array({_as_struct(_DESCRIBED)}, {_as_struct(_REPEATS)}) ELSE array({_as_struct(_DESCRIBED)}) END"
    )
    return columns.select(F.inline(kinds))


def _as_struct(fields) -> str:
    return f"struct({', '.join(fields)})"


@query("b21_description_files", with_(CATALOG, _DESCRIBED_SQL, _MAPPED) + "SELECT * FROM mapped")
def _(t: Tables):
    columns = _catalog(t)
    return cat.map_description_files(columns, _described(columns))


@query(
    "b21_files_not_mapped",
    with_(CATALOG, _DESCRIBED_SQL, _MAPPED)
    + """SELECT t.db_id, t.table_name, CASE WHEN max(b.ties) > 1 THEN 'ambiguous' ELSE 'no_match' END AS how
FROM tabs t LEFT JOIN best b ON b.db_id = t.db_id AND b.table_name = t.table_name AND b.rn = 1
WHERE (t.db_id, t.table_name) NOT IN (SELECT (db_id, table_name) FROM mapped) GROUP BY 1, 2""",
)
def _(t: Tables):
    columns = _catalog(t)
    choices = cat.description_choices(columns, _described(columns))
    return choices.where("file IS NULL").drop("file")


@query(
    "b22_column_descriptions",
    with_(CATALOG, _DESCRIBED_SQL, _MAPPED)
    + """, last_ AS (SELECT db_id, file, lower(original_column_name) AS k,
    arg_max(column_description, row_ordinal) AS cd, arg_max(value_description, row_ordinal) AS vd,
    arg_max(data_format, row_ordinal) AS df FROM described WHERE original_column_name <> '' GROUP BY 1, 2, 3)
SELECT c.db_id, c.table_name, c.ordinal, coalesce(l.cd, '') AS column_description,
  coalesce(l.vd, '') AS value_description, coalesce(l.df, '') AS data_format
FROM catalog c LEFT JOIN mapped m ON m.db_id = c.db_id AND m.table_name = c.table_name
LEFT JOIN last_ l ON l.db_id = m.db_id AND l.file = m.file AND l.k = lower(c.column_name)""",
)
def _(t: Tables):
    columns = _catalog(t)
    described = _described(columns)
    mapping = cat.map_description_files(columns, described)
    named = columns.select("db_id", "table_name", "ordinal", "column_name")
    return cat.column_descriptions(named, mapping, described).select(
        "db_id", "table_name", "ordinal", *cat.DESCRIPTION_FIELDS
    )
