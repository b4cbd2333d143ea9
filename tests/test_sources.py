"""Readers and writers on small files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from goldpan.sources import csvs, files, jsonl
from goldpan.streaming import logs


def test_issue_lines_and_torn_end(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_bytes(b'{"a": 1}\n\n{"a": 2}\n')
    bad = tmp_path / "bad.jsonl"
    bad.write_bytes('{"a": 1}\n\n{"a": \n[1]\n"x"\n{"a": "ü"}'.encode())
    issues = jsonl.jsonl_issues(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [(r["line_number"], r["issue"]) for r in issues] == [
        (3, "invalid_json"), (4, "not_an_object"), (5, "not_an_object"),
    ]
    state = {r["file"].rsplit("/", 1)[-1]: r for r in jsonl.torn_files(spark, str(tmp_path)).collect()}
    assert state["bad.jsonl"]["torn"] and not state["good.jsonl"]["torn"]
    assert state["bad.jsonl"]["blank_lines"] == 1 and state["bad.jsonl"]["bad_lines"] == 3


def test_line_numbers_across_blocks(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join("broken\n" if i % 1000 == 999 else f'{{"a": {i}}}\n' for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = [r["line_number"] for r in jsonl.jsonl_issues(spark, str(path)).orderBy("line_number").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [1000, 2000, 3000, 4000, 5000]


def test_fail_fast(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception):
        jsonl.scan_jsonl(spark, str(tmp_path), "a int").collect()


def test_description_csv_encodings(spark, tmp_path):
    body = 'original_column_name , column_description\nid,"two\nlines ""q"""\nprice,costs 5 €\n'
    (tmp_path / "new.csv").write_bytes(b"\xef\xbb\xbf" + body.encode())
    (tmp_path / "old.csv").write_bytes(body.encode("cp1252"))
    rows = csvs.scan_description_csv(spark, str(tmp_path)).collect()
    for name in ("new.csv", "old.csv"):
        got = {
            r["original_column_name"]: r["column_description"]
            for r in rows if r["file"].endswith(name)
        }
        assert got == {"id": 'two lines "q"', "price": "costs 5 €"}


def test_description_csv_records(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        b'x,x,"y, z"\r\n1,2,"a ""b"" c"\r\n\r\n"",say "hi",\n"never ended,4\nshort\n1,2,3,4'
    )
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_bytes(b"only,a,header\n")
    rows = csvs.scan_description_csv(spark, str(tmp_path)).collect()
    got = sorted((r["x"], r["y, z"]) for r in rows)
    assert got == sorted([("2", 'a "b" c'), ('say "hi"', ""), ("4", ""), ("", ""), ("2", "3")])
    with pytest.raises(FileNotFoundError):
        csvs.scan_description_csv(spark, str(tmp_path), "*.none")


def test_many_description_files_share_one_plan(spark, tmp_path):
    for i in range(400):
        name = f"h{i % 40}"
        (tmp_path / f"{i}.csv").write_text(f"original_column_name,{name}\ncol{i},v{i}\n", encoding="utf-8")
    rows = csvs.scan_description_csv(spark, str(tmp_path))
    assert len(rows.columns) == 42
    got = {r["original_column_name"]: {c for c in rows.columns[1:] if r[c]} for r in rows.collect()}
    assert got == {f"col{i}": {"original_column_name", f"h{i % 40}"} for i in range(400)}
    assert "Union" not in rows._jdf.queryExecution().toString()


def test_publish_switches_versions(spark, tmp_path):
    root = str(tmp_path)
    files.publish(spark.range(5), root, "numbers")
    files.publish(spark.range(9), root, "numbers")
    assert files.published(spark, root, "numbers").count() == 9
    assert files.differences(files.published(spark, root, "numbers"), spark.range(9)).isEmpty()


def test_publication_reads_its_source_once_and_numbers_it(spark, tmp_path):
    root = str(tmp_path)
    assert files.manifests(spark, root, "x").collect() == []
    # Another draw each time it is computed: only what was written counts.
    drawn = spark.range(50).select("id", F.expr("uuid()").alias("u"))
    assert files.publish(drawn, root, "x") == 1 and files.publish(drawn.limit(0), root, "x") == 2
    assert [(r.number, r["rows"]) for r in files.manifests(spark, root, "x").orderBy("number").collect()] == [(1, 50), (2, 0)]
    assert files.published(spark, root, "x").count() == 0
    with pytest.raises(LookupError):
        files.published(spark, root, "y")


def test_two_publications_keep_one_winner(spark, tmp_path):
    root = str(tmp_path)
    files.publish(spark.range(1), root, "x")
    with ThreadPoolExecutor(4) as pool:  # all have seen number 1
        tries = [pool.submit(files.publish, spark.range(10 + i), root, "x", 1) for i in range(4)]
    won = [i for i, t in enumerate(tries) if t.exception() is None]
    assert len(won) == 1 and tries[won[0]].result() == 2
    assert all(isinstance(t.exception(), files.PublicationConflict) for i, t in enumerate(tries) if i not in won)
    assert files.published(spark, root, "x").count() == 10 + won[0]
    with pytest.raises(files.PublicationConflict):
        files.publish(spark.range(3), root, "x", base=1)


def test_spoilt_versions_leave_the_old_one(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    files.publish(spark.range(5), root, "x")
    real = files.published

    def spoilt(*args):
        return real(*args).where("id <> 3")

    monkeypatch.setattr(files, "published", spoilt)  # what the name gives after the switch is short of a row
    with pytest.raises(RuntimeError, match="taken back"):
        files.publish(spark.range(9), root, "x")
    monkeypatch.setattr(files, "published", real)
    assert files.published(spark, root, "x").count() == 5
    assert files.publish(spark.range(7), root, "x") == 2
    # A version that loses its files later, and a manifest that was cut short.
    version = files.manifests(spark, root, "x").where("number = 2").first().version
    for part in (tmp_path / "x" / "versions" / version).glob("*.parquet"):
        part.unlink()
    (tmp_path / "x" / "manifest" / "000000000003.json").write_text('{"number": 3, "ver')
    assert files.published(spark, root, "x", verify=True).count() == 5


def test_replayed_batch_appends_nothing(spark, tmp_path):
    path = str(tmp_path)
    assert logs.logged_batches(spark, path, "id long").collect() == []
    assert logs.save_batch(spark.range(3), 0, path)
    assert not logs.save_batch(spark.range(3), 0, path) and not logs.save_batch(spark.range(9), 0, path)
    # Data without a ledger entry are no batch yet, and are written again.
    spark.range(4).write.json(f"{path}/data/batch=1")
    assert logs.logged_batches(spark, path, "id long").count() == 3
    assert logs.save_batch(spark.range(3, 5), 1, path)
    assert sorted((r.batch, r.id) for r in logs.logged_batches(spark, path, "id long").collect()) == [
        (0, 0), (0, 1), (0, 2), (1, 3), (1, 4)
    ]


def test_csv_export_quotes_everything(spark, tmp_path):
    rows = spark.createDataFrame([('a "b"', None, 1)], "x string, y string, z int")
    csvs.export_csv(rows.coalesce(1), str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ['"x","y","z"', '"a ""b""","","1"']


def test_request_log_goes_on_where_it_was(spark, tmp_path):
    def arrive(a, b):
        rows = spark.range(a, b).select(
            F.col("id").alias("request_id"), F.lit("2024-01-01").alias("ts"), F.lit("d").alias("db_id"),
            F.lit("fast").alias("mode"), F.when(F.col("id") % 2 == 0, "success").otherwise("sql_execution_failed").alias("status"),
            *[F.lit(1.23456).alias(c) for c in ("total_ms", "generation_ms", "execution_ms")],
        )
        files.append_records(rows, str(tmp_path / "in"))

    for a, b in ((0, 10), (10, 25)):
        arrive(a, b)
        stream = logs.log_record(logs.request_stream(spark, str(tmp_path / "in")))
        logs.write_log(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
        logs.append_batches(stream, str(tmp_path / "json"), str(tmp_path / "state2")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(r["request_id"] for r in log.collect()) == list(range(25))
    assert log.where("error_type IS NULL").count() == 13
    found = logs.logged_batches(spark, str(tmp_path / "json"), "request_id long, db_id string")
    assert sorted((r.batch, r.request_id) for r in found.collect()) == [(int(i >= 10), i) for i in range(25)]
