"""Extraction, prompt and token-array rules on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from goldpan.functions import arrays, text
from goldpan.operators import datasets

T = "```"
REASONING_CASES = [
    (f"<think>Orders hold the customer key.\nCount them.</think>\n\n{T}sql\nSELECT count(*)\nFROM orders\n{T}",
     "Orders hold the customer key.\nCount them.", "SELECT count(*)\nFROM orders", "reasoning_sql_fence", True),
    (f"{T}sql\nSELECT max(p_size) FROM part\n{T}", "", "SELECT max(p_size) FROM part", "sql_fence", False),
    (f"{T}\nSELECT r_name FROM region\n{T}", "", "SELECT r_name FROM region", "generic_fence", False),
    ("select o_orderkey from orders", "", "select o_orderkey from orders", "raw_sql", False),
    ("WITH big AS (SELECT * FROM part) SELECT p_name FROM big", "",
     "WITH big AS (SELECT * FROM part) SELECT p_name FROM big", "raw_sql", False),
    ("The table region has five rows.", "", "", "failed", False),
    ("\n \t", "", "", "failed", False),
    # a blank reasoning falls through to nothing weaker that matches
    (f"<think> </think>\n{T}sql\nSELECT 1\n{T}", "", "", "failed", False),
    (f"{T}sql\n{T}\nx\n{T}", "", "", "failed", False),
    (f" {T}SQL \r\nSELECT 2{T} \n", "", "SELECT 2", "sql_fence", False),
    ("selective", "", "", "failed", False),
]
PLAIN_CASES = [
    (f"{T}sql\nSELECT 1\n{T}", "SELECT 1", "sql_fence", True),
    (f"{T}\nSELECT 1\n{T}", "SELECT 1", "generic_fence", False),
    (f"{T}sql\nSELECT 1{T}", "", "failed", False),
    (f"{T}sql\n \n{T}", "", "failed", False),
    (f"{T}sql\nSELECT 1\n{T}\n{T}sql\nSELECT 2\n{T}", "", "failed", False),
    ("with x as (select 1) select * from x", "with x as (select 1) select * from x", "raw_sql", False),
    ("prose", "", "failed", False),
]


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "reasoning", "sql", "status", "compliant"), REASONING_CASES)
def test_reasoning_extraction(spark, raw, reasoning, sql, status, compliant):
    got = _one(spark, raw, text.extract_reasoning_sql)
    assert tuple(got) == (reasoning, sql, status, compliant)


@pytest.mark.parametrize(("raw", "sql", "status", "compliant"), PLAIN_CASES)
def test_plain_extraction(spark, raw, sql, status, compliant):
    got = _one(spark, raw, text.extract_sql)
    assert (got["predicted_sql"], got["extraction_status"], got["format_compliance"]) == (
        sql, status, compliant,
    )


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("<RATIONALE>\n1. a\n2. b\n</RATIONALE>", "1. a\n2. b"),
        (" <RATIONALE> \nx\n</RATIONALE>\n", "x"),
        ("<RATIONALE>\n \n</RATIONALE>", None),
        ("<RATIONALE>x</RATIONALE>", None),
        ("text <RATIONALE>\nx\n</RATIONALE>", None),
    ],
)
def test_rationale(spark, raw, expected):
    assert _one(spark, raw, text.extract_rationale) == expected


def test_query_phrases(spark):
    rows = spark.createDataFrame(
        [("Show me the Größe of café_bar, x 7", "list café Café __ _cafe_ the_end")], "question string, evidence string"
    )
    found = rows.select(text.query_phrases(F.col("question"), F.col("evidence")).alias("t")).first()["t"]
    assert [(r.term, r.tokens) for r in found] == [
        ("grösse", ["grosse"]), ("café_bar", ["cafe", "bar"]), ("7", ["7"]), ("café", ["cafe"]), ("cafe", ["cafe"]),
        ("the_end", ["the", "end"]),
    ]


def test_search_tokens_short_way(spark):
    assert _one(spark, "Ab-c_9 x\ty", text.search_tokens) == ["ab", "c", "9", "x", "y"]
    assert _one(spark, "Ab-c_9 É", text.search_tokens) == ["ab", "c", "9", "e"]
    assert _one(spark, "", text.search_tokens) == []


def test_identifier_folding_is_ascii_only(spark):
    assert _one(spark, "ÉA", text.ascii_fold) == "Éa"
    assert _one(spark, 'a"b', text.quote_identifier) == '"a""b"'
    assert _one(spark, " a b\n c ", text.one_line) == "a b c"


def test_sample_id_is_padded_but_never_cut(spark):
    ids = spark.createDataFrame([(7,), (1234567,)], "i bigint").select(
        text.sample_id(F.lit("train"), F.col("i")).alias("s")
    )
    assert [r["s"] for r in ids.collect()] == ["train_000007", "train_1234567"]


def test_prompt_leaves_empty_sections_out(spark):
    row = spark.createDataFrame([("S", " q ", "  ")], "schema string, question string, evidence string")
    content = row.select(
        datasets.user_content(F.col("schema"), F.col("question"), F.col("evidence"), F.array().cast("array<string>")).alias("c")
    ).first()["c"]
    assert content == "Database schema:\nS\n\nQuestion:\nq"


def test_token_arrays(spark):
    row = spark.createDataFrame([([1, 2], [1, 2, 9, 4], [])], "p array<bigint>, f array<bigint>, e array<bigint>")
    got = row.select(
        arrays.completion_labels(F.col("p"), F.col("f")).alias("labels"),
        arrays.is_strict_prefix(F.col("p"), F.col("f")).alias("good"),
        arrays.is_strict_prefix(F.col("f"), F.col("f")).alias("same"),
        arrays.supervised_count(arrays.completion_labels(F.col("e"), F.col("f"))).alias("shifted"),
        arrays.trim_at_end(F.col("f"), [9]).alias("trim"),
        arrays.completion_mask(F.col("f"), [7]).alias("none"),
        arrays.completion_mask(F.col("f"), [7], exclude_truncated=False).alias("all"),
        arrays.completion_mask(F.col("f"), [4, 9]).alias("mask"),
    ).first()
    assert got["labels"] == [-100, -100, 9, 4]
    assert got["good"] and not got["same"]
    assert got["shifted"] == 3
    assert tuple(got["trim"]) == ([1, 2, 9], False)
    assert got["none"] == [0, 0, 0, 0] and got["all"] == [1, 1, 1, 1]
    assert got["mask"] == [1, 1, 1, 0]


def test_mean_finite(spark):
    rows = spark.createDataFrame(
        [([-1.0, float("-inf"), None, -3.0],), ([float("nan")],), ([],)], "v array<double>"
    )
    assert [r[0] for r in rows.select(arrays.mean_finite(F.col("v"))).collect()] == [-2.0, None, None]
