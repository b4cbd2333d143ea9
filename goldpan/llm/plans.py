"""One registered query per operator, over its whole intended table, and the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, conversation_trie, decontaminate, fuzzy_lines, kdtree, line_dedup, mixing, piece_encoding, quality,
    ranked_search, simhash, token_files, topk,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: None of the ten can be told in DuckDB's SQL with the same hashes, models or formats except
#: those listed here; the others are tested against brute force.
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@_query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3
    )


@_query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=2)


@_query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"), share=1.5, most=2)


OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS t
  FROM items, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT rid, i, n, array_to_string(w[i + 1 : i + n], ' ') AS t
  FROM split, sizes, unnest(range(0, len(w) - n + 1)) AS u(i)),
hits AS (SELECT rid, i, n, item_id FROM places JOIN wins USING (n, t)),
words AS (
  SELECT rid, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS u(k) GROUP BY rid),
who AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN words USING (rid) LEFT JOIN who USING (rid)
"""


@_query("op4_decontaminate", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10
    )


@_query("op7_kdtree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.shard_documents(_table(spark, sf_dir, "documents"), ["lang", "n_chars"], shards=16)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
    AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5
"""


@_query("op8_topk", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
    (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
escaped AS (
  SELECT *, replace(regexp_replace(role, '<(~*)\|', '<\1~|', 'g'), chr(10), '<|nl|>') AS r,
    regexp_replace(text, '<(~*)\|', '<\1~|', 'g') AS t FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, r, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(r) + 1 + length(t) + 11) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@_query("op10_chat", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], table.schema)
    return chat.read_back(chat.text_messages(table.unionAll(extra)))


@_query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.round_trip(_table(spark, sf_dir, "documents"), vocabulary, end=2)


@_query("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated(_table(spark, sf_dir, "documents"), "sentence", least_words=16)


@_query("op3_fuzzy_lines")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.remove_fuzzy(_table(spark, sf_dir, "documents"), least_words=5, bands=True)


@_query("op12_pieces")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.digests(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, CAST(coalesce(role, '') AS VARCHAR) AS r, CAST(coalesce(text, '') AS VARCHAR) AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(list_reduce(range(0, 8 * strlen(CAST(conv_id AS VARCHAR))), lambda c, i:
      xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(CAST(conv_id AS VARCHAR), i // 8 + 1, 1))) ELSE c END) >> 1,
        3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(CAST(conv_id AS VARCHAR), i // 8 + 1, 1))) ELSE c END) & 1)),
      4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, b.p, b.r, b.x FROM convs c JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 5 AND b.p <= c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.r, t.x FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d,
    sha256(concat(length(r), ':', r, x)) AS k, strlen(x) AS b FROM rebuilt),
paths AS (
  SELECT conv_id, d, b, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT key, d, any_value(b) AS b, count(*) AS n, min(conv_id) AS id FROM paths GROUP BY key, d),
children AS (SELECT left(key, CAST(64 * (d - 1) AS BIGINT)) AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
valued AS (
  SELECT nodes.*, coalesce(children.n, 0) AS c, (nodes.n - 1) * b AS s FROM nodes LEFT JOIN children USING (key)),
sums AS (
  SELECT left(key, CAST(64 * i AS BIGINT)) AS key, sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) AS l, sum(s) AS s
  FROM valued, unnest(range(0, d + 1)) AS u(i) GROUP BY 1),
ends AS (
  SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS e
  FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM paths) WHERE d = last GROUP BY key)
SELECT v.id AS conv_id, v.d AS depth, up.id AS parent_conv_id, v.n AS n_convs, v.c AS n_children,
  CAST(sums.l AS BIGINT) AS n_leaves, CAST(sums.s AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM valued v JOIN sums USING (key) LEFT JOIN ends USING (key)
  LEFT JOIN nodes up ON v.d > 0 AND up.key = left(v.key, CAST(64 * (v.d - 1) AS BIGINT)) AND up.d = v.d - 1
"""


@_query("op13_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"), family=5, most=8)


OP11_SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, row_number() OVER () AS iid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
terms AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM split) GROUP BY rid, term),
counts AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
whole AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM split),
sizes AS (SELECT rid, doc_id, 100 - 25 + (25 * len(w) * whole.n) // whole.l AS m FROM split, whole WHERE len(w) > 0),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, whole),
asked AS (SELECT iid, item_id, unnest(w) AS term FROM items),
scores AS (
  SELECT iid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN terms USING (term) JOIN sizes USING (rid) GROUP BY ALL),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
    doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""


@_query("op11_lexical", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20
    )
