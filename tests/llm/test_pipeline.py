"""The pipeline stage by stage against plain versions, each on its own input, and its contract."""

from __future__ import annotations

import collections
import os
import subprocess
import sys

from test_decontaminate import plain as plain_marks
from test_mixing import check_mix
from test_near_documents import plain_near
from test_token_files import plain_rows

import __spark_entry__
import corpus_pipeline
from goldpan.llm import mixing, plans, quality
from goldpan.session import written

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, FOLDER), name)
        kept[name] = (before.collect(), docs.collect())
        if name != "tokens":
            assert docs.columns == columns

    given, left = kept["quality"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_documents(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).collect()}
    assert sorted(r["doc_id"] for r in left) == sorted(r["doc_id"] for r in given if scores[r["doc_id"]] == 1)
    bad = {r["doc_id"] for r in labels.collect() if r["quality"] == 0}
    assert len(bad & {r["doc_id"] for r in left}) <= 0.25 * len(bad)

    given, left = kept["near_dedup"]
    roots = plain_near([(r["doc_id"], r["text"]) for r in given])
    assert sorted(r["doc_id"] for r in left) == sorted(set(roots.values()))

    given, left = kept["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    marks = {r[0]: r[5] for r in plain_marks([(r["doc_id"], r["text"]) for r in given], items)}
    assert sorted(r["doc_id"] for r in left) == sorted(d for d, hit in marks.items() if not hit)

    given, left = kept["mix"]
    frame = spark.createDataFrame(given, docs_schema(spark))
    mixed = mixing.mix_documents(frame).collect()
    check_mix([(r["doc_id"], r["text"], r["source"]) for r in given], mixed)
    times = collections.Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixed if r["taken"]})
    assert collections.Counter(r["doc_id"] for r in left) == times

    given, left = kept["tokens"]
    assert sorted(map(tuple, left)) == plain_rows([(r["doc_id"], r["text"]) for r in given])


def docs_schema(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").schema


def test_run_is_the_stages(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() > 0


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(plans.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_entry_imports_without_the_optional_parts():
    code = (
        "import sys; sys.modules['goldpan.llm'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; "
        "assert 'h01_result_vote' in e.queries() and not any(n.startswith('op1_') for n in e.queries())" % ROOT
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/tmp")
