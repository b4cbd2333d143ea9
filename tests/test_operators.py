"""Edge rows of the operators: ties, nulls, empty groups, hot groups."""

from __future__ import annotations

import time

import random

import pytest
from pyspark.sql import functions as F

from goldpan.operators import audit, batch, catalog, index, metrics, ranks, scoring, screening, tokens, voting

CANDIDATE = (
    "s int, candidate_index bigint, is_greedy boolean, status string, empty_result boolean, "
    "result_key string, mean_logprob double"
)


def vote_one(spark, rows, minimum_support=2):
    data = [(1, i, i == 0, *row) for i, row in enumerate(rows)]
    return voting.result_vote(spark.createDataFrame(data, CANDIDATE), ["s"], minimum_support).first()


def ok(key, lp=-0.5):
    return ("success", key == "", key, lp)


BAD = ("execution_error", False, "", None)


@pytest.mark.parametrize(
    ("rows", "index_", "reason", "support", "used"),
    [
        # the published case: answers 1 (greedy), 1, 1, 2, 3, 4, 5, 6
        ([ok("1"), ok("1"), ok("1"), ok("2"), ok("3"), ok("4"), ok("5"), ok("6")],
         0, "unique_result_majority", 3, False),
        ([ok("1"), ok("2", -0.9), ok("2", -0.1)], 2, "unique_result_majority", 2, True),
        ([ok("1"), ok("1"), ok("2"), ok("2")], 0, "tied_majority_kept_greedy", 2, False),
        ([BAD, ok("1", -0.4), ok("1", -0.4), ok("2", -0.1), ok("2", -0.3)],
         3, "tied_majority_log_prob", 2, True),
        # one member without a log-probability makes its cluster weakest
        ([BAD, ok("1", -9.0), ok("1", -9.0), ok("2", -0.1), ok("2", None)],
         1, "tied_majority_log_prob", 2, True),
        # equal log-probabilities: the first-formed cluster
        ([BAD, ok("b", None), ok("a", None), ok("a", None), ok("b", None)],
         1, "tied_majority_log_prob", 2, True),
        ([ok("1", -9.0), ok("2", -0.1)], 0, "kept_greedy_without_majority", 1, False),
        ([BAD, ok("1", -9.0), ok("2", -0.1)], 2, "log_prob_fallback", 1, False),
        # empty results only vote when nothing else ran; an empty greedy does not vote
        ([ok(""), ok(""), ok("1", -2.0)], 2, "log_prob_fallback", 1, False),
        ([ok(""), ok(""), BAD], 0, "unique_result_majority", 2, False),
        ([BAD, BAD], None, "no_executable_candidate", 0, False),
    ],
)
def test_vote(spark, rows, index_, reason, support, used):
    got = vote_one(spark, rows)
    assert (got["chosen_index"], got["reason"], got["support"], got["used_vote"]) == (
        index_, reason, support, used,
    )


def python_vote(rows):
    """Plain restatement of the rules for random checks."""
    ran = [(i, r) for i, r in enumerate(rows) if r[0] == "success"]
    full = [x for x in ran if not x[1][1]]
    voters = full or ran
    if not ran:
        return None, "no_executable_candidate"
    groups = {}
    for i, r in voters:
        groups.setdefault(r[2], []).append((i, r))
    low = float("-inf")
    lp = lambda r: low if r[3] is None else r[3]
    mean = lambda g: low if any(r[3] is None for _, r in g) else round(sum(r[3] for _, r in g) / len(g), 12)
    size = max(map(len, groups.values()))
    top = [g for g in groups.values() if len(g) == size]
    mine = next((g for g in groups.values() if g[0][0] == 0), None)
    if size >= 2 and len(top) == 1:
        chosen, reason = top[0], "unique_result_majority"
    elif size >= 2 and mine in top:
        chosen, reason = mine, "tied_majority_kept_greedy"
    elif size >= 2:
        chosen, reason = max(top, key=mean), "tied_majority_log_prob"
    elif mine:
        chosen, reason = mine, "kept_greedy_without_majority"
    else:
        chosen, reason = max(top, key=mean), "log_prob_fallback"
    return max(chosen, key=lambda x: (x[0] == 0, lp(x[1]), -x[0]))[0], reason


def test_vote_against_plain_rules(spark):
    rng = random.Random(5)
    pool = [BAD, ok(""), *[ok(k, lp) for k in "abc" for lp in (-0.5, -0.25, None)]]
    samples = [[rng.choice(pool) for _ in range(rng.randint(1, 6))] for _ in range(400)]
    data = [(s, i, i == 0, *r) for s, rows in enumerate(samples) for i, r in enumerate(rows)]
    got = voting.result_vote(spark.createDataFrame(data, CANDIDATE), ["s"]).collect()
    assert {r["s"]: (r["chosen_index"], r["reason"]) for r in got} == {
        s: python_vote(rows) for s, rows in enumerate(samples)
    }


def test_row_sets_ignore_order_names_and_repeats(spark):
    match = lambda a, b: scoring.frames_match(spark.sql(a), spark.sql(b)).first()["official_ex"]
    assert match("SELECT 1 AS a, 'x' AS b", "SELECT 1.0D AS c, 'x' AS d") == 1
    assert match("SELECT * FROM VALUES (1), (2), (2)", "SELECT * FROM VALUES (2), (1)") == 1
    assert match("SELECT 1", "SELECT '1'") == 0
    assert match("SELECT NULL", "SELECT NULL") == 1
    assert match("SELECT 1 WHERE false", "SELECT 1, 2 WHERE false") == 1
    assert match("SELECT 1", "SELECT 1, 2") == 0
    assert match("SELECT -0.0D", "SELECT 0") == 1
    assert match("SELECT true", "SELECT 1") == 1


def test_partial_score_bounds(spark):
    columns = (
        "status string, official_ex int, table_f1 double, column_f1 double, column_count int, "
        "gold_column_count int, row_count int, gold_row_count int, result_jaccard double"
    )
    rows = [
        ("success", 1, 0.0, 0.0, 1, 2, 1, 2, 0.0),
        ("success", 0, 1.0, 1.0, 2, 2, 5, 5, 0.9),
        ("success", 0, 0.5, 0.0, 1, 2, 1, 2, 0.7),
        ("timeout", 0, 1.0, 1.0, 2, 2, 5, 5, 1.0),
    ]
    got = scoring.partial_score(spark.createDataFrame(rows, columns)).collect()
    assert [r["screening_score"] for r in got] == [1.0, 0.55, 0.15, 0.0]
    assert got[2]["result_jaccard"] == 0.0 and got[3]["table_f1"] == 0.0


def test_published_rates(spark):
    from goldpan.functions.numbers import percentage

    rows = spark.createDataFrame([(938, 1534), (2628, 5939), (0, 0)], "n int, d int")
    got = [r[0] for r in rows.select(percentage(F.col("n"), F.col("d"))).collect()]
    assert got == [61.15, 44.25, 0.0]


def test_screening_needs_variance(spark):
    schema = "s int, gold_status string, gold_empty boolean, truncated boolean, official_ex bigint, screening_score double"
    rows = [
        *[(1, "success", False, False, e, float(e)) for e in (1, 0)],
        *[(2, "success", False, False, 0, x) for x in (0.1, 0.3)],
        *[(3, "success", False, False, 0, 0.1) for _ in range(3)],
        (4, "success", False, False, 0, 0.1), (4, "success", False, True, 0, 0.5),
        (5, "timeout", False, False, 1, 1.0),
        (6, "success", True, False, 1, 1.0),
    ]
    got = {r["s"]: r for r in screening.screen_prompts(spark.createDataFrame(rows, schema), ["s"]).collect()}
    assert [got[i]["selection_reason"] for i in range(1, 7)] == [
        "exact_mixed", "zero_exact_partial_variance", None, None, None, None,
    ]
    assert got[5]["exclusion_reason"] == "gold_timeout" and got[6]["exclusion_reason"] == "empty_gold_result"
    assert got[5]["exact_pass_count"] == 0


def test_group_advantage(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 1.0)], "s int, reward double")
    got = sorted(r["advantage"] for r in screening.group_advantage(rows, ["s"]).collect())
    expected = 0.5 / (0.5**0.5 + 1e-4)
    assert got == pytest.approx([-expected, expected])


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_are_dense_for_repeated_keys(spark, partitions):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    got = ranks.with_position(rows.repartition(partitions), F.col("k"), F.col("id")).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(5000))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def test_values_at_uses_rounded_index(spark):
    values = [random.Random(3).choice([1.0, 2.0, 5.0, 9.0]) + i % 7 for i in range(1001)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranks.values_at(frame, "v", [50, 95, 99]).first().asDict()
    ordered = sorted(values)
    assert got == {f"p{p}": ordered[round(p / 100 * 1000)] for p in (50, 95, 99)}


def test_nearest_rank(spark):
    frame = spark.range(25).select(F.lit("a").alias("split"), F.col("id").alias("n"))
    row = ranks.nearest_rank(frame, ["split"], ["n"], [50, 90, 95, 99]).first()
    assert [row[c] for c in ("min", "p50", "p90", "p95", "p99", "max", "total")] == [0, 12, 22, 23, 24, 24, 300]


def test_first_per_group_is_exact_for_a_hot_group(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), "id")
    got = ranks.first_per_group(rows, ["g"], [F.col("id")], 1500).where("g = 'hot'")
    assert sorted(r["id"] for r in got.collect()) == [3 * i for i in range(1500)]


def test_bounded_scan_with_offset_keys_and_nulls(spark):
    rows = spark.range(3000).select(
        (F.col("id") + 10**12).alias("k"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("v"), "id")).alias("v")
    )
    got = index.bounded_scan(rows, "t", ["k"], ["v"], 50).orderBy("scan_order").collect()
    assert [r["value"] for r in got] == [f"v{2 * i + 1}" for i in range(50)]


def test_value_cap_stops_the_scan(spark):
    rows = [("t", "c", i + 1, v) for i, v in enumerate(["A", "a", " b ", "B", "c", "d"])]
    scanned = spark.createDataFrame(rows, "table_name string, column_name string, scan_order int, value string")
    kept = index.capped_values(index.distinct_values(index.normalized_values(scanned)), cap=3)
    assert [r["value"] for r in kept.orderBy("value_order").collect()] == ["A", "b", "c"]
    stats = index.value_statistics(scanned, kept, cap=3).first()
    assert (stats["scanned_values"], stats["indexed_unique_values"]) == (5, 3)


def test_name_matching(spark):
    ours = spark.createDataFrame([("d", n) for n in ["Id", "Name", "É", "Gone", "Amb"]], "scope string, name string")
    live = spark.createDataFrame([("d", n) for n in ["Id", "NAME", "é", "AMB", "amb", "New"]], "scope string, name string")
    got = {(r["name"], r["live_name"], r["how"]) for r in catalog.match_names(ours, live, ["scope"]).collect()}
    assert {g for g in got if g[2] in ("exact", "folded")} == {("Id", "Id", "exact"), ("Name", "NAME", "folded")}
    assert {g[0] for g in got if g[2] == "missing_in_live"} == {"É", "Gone", "Amb"}
    assert {g[1] for g in got if g[2] == "missing_in_catalog"} == {"é", "AMB", "amb", "New"}


def test_schema_text(spark):
    columns = spark.createDataFrame(
        [
            ("d", 0, "users", "users", 0, "id", "id", "integer", True),
            ("d", 0, "users", "users", 1, "name", "full \n name", "text", False),
            ("d", 1, "links", "user links", 0, "a", "a", "integer", True),
            ("d", 1, "links", "user links", 1, 'b"x', "", "integer", True),
        ],
        "db_id string, table_ordinal int, table_name string, table_display string, ordinal int, "
        "column_name string, column_display string, declared_type string, is_primary_key boolean",
    )
    keys = spark.createDataFrame(
        [("d", 1, 0, "links", "a", "users", "id")],
        "db_id string, table_ordinal int, key_ordinal int, source_table string, source_column string, "
        "target_table string, target_column string",
    )
    assert catalog.render(columns, keys).first()["schema"] == (
        'TABLE "users"\n- "id" INTEGER [PRIMARY KEY]\n- "name" TEXT -- full name\n\n'
        'TABLE "links" -- user links\n- "a" INTEGER\n- "b""x" INTEGER\nPRIMARY KEY ("a", "b""x")\n\n'
        'FOREIGN KEY\n"links"."a" -> "users"."id"'
    )


def test_description_files_go_in_table_order(spark):
    columns = spark.createDataFrame(
        [("d", "one", 0, c) for c in ("a", "b")] + [("d", "two", 1, c) for c in ("a", "b", "c")]
        + [("d", "Named", 2, c) for c in ("a", "z")] + [("d", "lost", 3, "q")],
        "db_id string, table_name string, table_ordinal int, column_name string",
    )
    described = spark.createDataFrame(
        [("d", "f1", c) for c in ("A", "B")] + [("d", "f2", c) for c in ("a", "c")]
        + [("d", "named", "a"), ("d", "named", "Z")],
        "db_id string, file string, original_column_name string",
    )
    got = {(r["table_name"], r["file"], r["how"]) for r in catalog.map_description_files(columns, described).collect()}
    # 'one' takes f1 first; 'two' ties on f1 and f2 until then.
    assert got == {("Named", "named", "name"), ("one", "f1", "overlap"), ("two", "f2", "overlap")}


def test_description_files_against_a_plain_loop(spark):
    rng = random.Random(11)
    names, described, expected = [], [], set()
    for db in range(40):
        tables = [(f"t{i}", {f"c{rng.randint(0, 5)}" for _ in range(3)}) for i in range(rng.randint(1, 6))]
        files_ = {f"f{i}": {f"c{rng.randint(0, 5)}" for _ in range(3)} for i in range(rng.randint(1, 7))}
        names += [(f"d{db}", t, i, c) for i, (t, cols) in enumerate(tables) for c in cols]
        described += [(f"d{db}", f, c) for f, cols in files_.items() for c in cols]
        left = dict(files_)
        for t, cols in tables:
            scores = {f: len(cols & other) for f, other in left.items()}
            top = max(scores.values(), default=0)
            best = [f for f, x in scores.items() if x == top and x > 0]
            if len(best) == 1:
                expected.add((f"d{db}", t, best[0]))
                del left[best[0]]
    got = catalog.map_description_files(
        spark.createDataFrame(names, "db_id string, table_name string, table_ordinal int, column_name string"),
        spark.createDataFrame(described, "db_id string, file string, original_column_name string"),
    )
    assert {(r["db_id"], r["table_name"], r["file"]) for r in got.collect()} == expected


def test_guard(spark):
    cases = {
        "SELECT 1": "ok",
        "  -- note\n SELECT ';' ;": "ok",
        "(SELECT 1) UNION (SELECT 2)": "ok",
        "WITH x AS (SELECT 1) SELECT * FROM x": "ok",
        "SELECT 'insert into t' AS s": "ok",
        "SELECT 1; DROP TABLE t": "unsafe_sql",
        "DELETE FROM t": "unsafe_sql",
        "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x": "unsafe_sql",
        "SELECT java_method('java.lang.System', 'exit', 1)": "unsafe_sql",
        "SELECT load_extension('x')": "unsafe_sql",
        "SELECT TRANSFORM (a) USING 'cat' FROM t": "unsafe_sql",
        "SELECT * FROM a JOIN b USING (k)": "ok",
        "": "invalid_sql",
        "/* x */ ;": "invalid_sql",
        "SELECT `reflect`('java.lang.System','getProperty','user.home')": "unsafe_sql",
        r"SELECT '\'', reflect('java.lang.System', 'getProperty', 'user.home')": "unsafe_sql",
        r"SELECT r'\', reflect('java.lang.System', 'getProperty', 'x')": "unsafe_sql",
        r"SELECT 'it\'s; ok'": "ok",
        "SELECT 1 -- don't\n, reflect('a', 'b')": "unsafe_sql",
        "SELECT 1 -- don't\n, 2": "ok",
        "SELECT '-- no; comment' AS `a;b`": "ok",
        "SELECT try_reflect /* x */ ('a', 'b')": "unsafe_sql",
        "SELECT 1 --\r, reflect('a', 'b') AS x": "unsafe_sql",
        "SELECT 1 --\r, load_extension('a')": "unsafe_sql",
        "SELECT 1 -- a\r\n, load_extension('a')": "unsafe_sql",
        "SELECT 1 -- '\r, load_extension('a') -- '": "unsafe_sql",
        "SELECT 1 -- a\\\n still load_extension('a')": "ok",
        "SELECT 1 -- a\\\r, load_extension('a')": "unsafe_sql",
        "SELECT 1 /* /* */ ' */ , load_extension('a') /* ' */": "unsafe_sql",
        "SELECT 1 /* /* */ load_extension('a') */ AS x": "ok",
        "SELECT 1 /* /* /* /* deep */ */ */ */ AS x": "ok",
        "SELECT 1 /* /* /* /* /* too deep */ */ */ */ */ AS x": "unsafe_sql",
        "SELECT 1 /* not ended , load_extension('a')": "unsafe_sql",
        "SELECT 'not ended": "unsafe_sql",
        "SELECT /*+ h(' */ ') */ load_extension('a') AS x": "unsafe_sql",
        "SELECT /*+ BROADCAST(t) */ * FROM t": "ok",
        "SELECT $$ ' $$, load_extension('a'), $$ ' $$": "unsafe_sql",
        "SELECT 1 /* reflect('a', 'b') */": "unsafe_sql",
        "SELECT '" + "a\\'" * 2000 + "' AS long": "ok",
        "SELECT 1 /* " + "x * / " * 3000 + "*/ AS long": "ok",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "sql string")
    got = {r["sql"]: r["v"] for r in rows.select("sql", audit.guard(F.col("sql")).alias("v")).collect()}
    assert got == cases


def test_statement_outcomes(spark):
    statements = spark.createDataFrame(
        [("d", s) for s in (
            "SELECT id FROM numbers", "SELECT id FROM numbers WHERE id < 0", "SELECT nope FROM numbers",
            "SELECT 1 / (id - id) FROM numbers", "DROP VIEW numbers",
        )],
        "db_id string, sql string",
    )

    def register(session, db_id):
        session.range(20).createOrReplaceTempView("numbers")

    got = {r["sql"]: r for r in audit.run_statements(statements, register, max_rows=20).collect()}
    assert got["SELECT id FROM numbers"]["row_count"] == 20
    assert got["SELECT id FROM numbers WHERE id < 0"]["empty_result"]
    assert got["SELECT nope FROM numbers"]["error_type"] == "missing_column"
    assert got["SELECT 1 / (id - id) FROM numbers"]["status"] == "execution_error"
    assert got["DROP VIEW numbers"]["status"] == "unsafe_sql"
    capped = audit.run_statements(statements.limit(1), register, max_rows=19).first()
    assert (capped["status"], capped["row_count"]) == ("row_limit", 20)


def test_number_keys_are_exact(spark):
    def key(expression):
        frame = spark.sql(f"SELECT {expression} AS v")
        return frame.select(scoring.cell_key(F.col("v"), frame.schema["v"].dataType)).first()[0]

    same = [
        ("CAST(1e16 AS DOUBLE)", "10000000000000000"), ("1.50BD", "CAST(1.5 AS DOUBLE)"),
        ("CAST(-0.0 AS DOUBLE)", "0"), ("CAST(0.00001 AS DOUBLE)", "0.000010BD"), ("-0.00BD", "0"),
        ("CAST(12345678.912 AS DOUBLE)", "12345678.912BD"), ("100BD", "100"), ("true", "1"),
    ]
    for a, b in same:
        assert key(a) == key(b), (a, b)
    other = [
        ("CAST('0.12345678901234567891' AS DECIMAL(38,20))", "CAST('0.12345678901234567892' AS DECIMAL(38,20))"),
        ("9007199254740993", "CAST(9007199254740992 AS DOUBLE)"), ("1", "'1'"), ("10BD", "1BD"),
    ]
    for a, b in other:
        assert key(a) != key(b), (a, b)


def test_empty_results_agree(spark):
    none = spark.createDataFrame([], "pair int, a string")
    one = spark.createDataFrame([(1, "x")], none.schema)
    pairs = spark.createDataFrame([(1,), (2,)], "pair int")
    counts = scoring.compare_row_sets(one, none, ["pair"], ["a"], pairs)
    got = counts.select("pair", scoring.execution_match(counts).alias("ex"), scoring.result_jaccard().alias("j")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0.0), (2, 1, 1.0)]


def test_databases_are_apart_and_runs_resume(spark, tmp_path):
    seen = []

    def register(session, db_id):
        seen.append(db_id)
        session.range(3 if db_id == "a" else 8).createOrReplaceTempView("numbers")

    one = spark.createDataFrame([("a", "SELECT id FROM numbers")], "db_id string, sql string")
    both = one.unionAll(spark.createDataFrame([("b", "SELECT id FROM numbers")], one.schema))
    path = str(tmp_path / "outcomes")
    assert audit.run_statements(one, register, path=path).count() == 1
    got = {r["db_id"]: r["row_count"] for r in audit.run_statements(both, register, path=path).collect()}
    assert got == {"a": 3, "b": 8} and seen == ["a", "b"]


def test_deadline_ends_the_statement(spark):
    slow = "SELECT max(a.id * b.id) AS m FROM numbers a JOIN numbers b ON a.id % 10 = b.id % 10"
    statements = spark.createDataFrame([("d", slow), ("d", "SELECT 1 AS x")], "db_id string, sql string")
    started = time.time()
    got = {
        r["sql"]: r["status"] for r in audit.run_statements(
            statements, lambda s, _: s.range(2_000_000).createOrReplaceTempView("numbers"), timeout_ms=3000
        ).collect()
    }
    assert got == {slow: "timeout", "SELECT 1 AS x": "success"} and time.time() - started < 60


def test_engine_errors_are_rows(spark, tmp_path):
    good, bad = tmp_path / "t", tmp_path / "secret.txt"
    spark.range(5).coalesce(1).write.parquet(str(good))
    bad.write_text("not for you")

    def register(session, db_id):
        session.read.schema("id long").parquet(str(good)).createOrReplaceTempView("t")
        for part in good.glob("*.parquet"):
            part.write_bytes(b"PAR1 broken")

    asked = {
        "SELECT id FROM t": "database_open_error",
        f"SELECT value FROM text.`{bad}`": "missing_table",
        "SELECT id FROM t WHERE (": "syntax_error",
    }
    statements = spark.createDataFrame([("d", s) for s in asked], "db_id string, sql string")
    got = {r["sql"]: r for r in audit.run_statements(statements, register).collect()}
    assert {s: r["status"] for s, r in got.items()} == dict.fromkeys(asked, "execution_error")
    assert all(r["error_message"] for r in got.values())
    assert got["SELECT id FROM t"]["error_type"] == "database_open_error"
    assert got["SELECT id FROM t WHERE ("]["error_type"] == "syntax_error"


def test_truncation_keeps_the_start(spark):
    frame = spark.createDataFrame([("train", 10, 5, 15), ("train", 3, 4, 7)], "split string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint")
    got = tokens.truncation(frame, [8, 16]).orderBy("max_length").collect()
    assert [tuple(r)[2:] for r in got] == [(1, 1, 1, 1, 4, 0.444444), (0, 0, 0, 0, 9, 1.0)]
    safe = tokens.minimum_safe_length(tokens.truncation(frame, [8, 16]), ["truncated_sample_count"]).first()
    assert safe["minimum_safe_length"] == 16


def test_seeded_order_pads_to_even(spark):
    ids = spark.range(7).select(F.col("id").alias("k"))
    first = batch.seeded_order(ids, "k", 3, 2).orderBy("position").collect()
    again = batch.seeded_order(ids.repartition(5), "k", 3, 2).orderBy("position").collect()
    assert first == again and len(first) == 8
    assert first[7]["k"] == first[6]["k"] and first[7]["repeated"]
    assert sorted(r["k"] for r in first[:7]) == list(range(7))


def test_compact_metrics_fills_the_count(spark):
    runs = spark.createDataFrame([(1534, None, 61.147, 98.305), (10, 3, 30.0, 50.0)], "sample_count int, correct_count bigint, official_ex double, executable_rate double")
    assert [r["correct_count"] for r in metrics.compact_metrics(runs).collect()] == [938, 3]


def test_contained_passages(spark):
    from goldpan.operators import constraints

    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    passage = lambda n: " ".join(rng.choices(words, k=n))
    passages = [(i, passage(rng.choice([3, 4, 5, 12]))) for i in range(40)]
    passages += [(90, None), (91, "  "), (92, "two words"), (93, "with\nline end and more"), (94, "never said anywhere at all")]
    texts = [(i, passage(40)) for i in range(60)]
    texts += [(100 + i, f"pre{passage(3)} x{p}y {passage(2)}") for i, (_, p) in enumerate(passages) if p]
    texts += [(300, None), (301, ""), (302, "with line end and more"), (303, "with\nline end and more")]
    found = constraints.contained_passages(
        spark.createDataFrame(texts, "doc int, text string").repartition(3), "doc",
        spark.createDataFrame(passages, "item int, text string"), "item",
    )
    expected = {
        (d, i) for d, t in texts for i, p in passages
        if t and p and len(p.split()) > 2 and p in t
    }
    got = [tuple(r) for r in found.collect()]
    assert set(got) == expected and len(got) == len(expected) and (303, 93) in expected and (302, 93) not in expected
    short = constraints.short_passages(spark.createDataFrame(passages, "item int, text string"), "item")
    assert [r.item for r in short.collect()] == [92]
    none = constraints.contained_passages(
        spark.createDataFrame([], "doc int, text string"), "doc", spark.createDataFrame([], "item int, text string"), "item"
    )
    assert none.collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000, 4099])
def test_permutation_is_bijective(spark, n):
    rows = batch.permuted(spark.range(n), "id", n, 7, "p").collect()
    assert sorted(r.p for r in rows) == list(range(n))
    if n > 90:
        moved = batch.permuted(spark.range(n), "id", n, 8, "p").collect()
        assert [r.p for r in rows] != [r.p for r in moved]
        assert sum(abs(r.p - r.id) for r in rows) > n * n / 5  # neighbours do not stay together


def test_seeded_order_does_not_sort(spark):
    ids = spark.range(5, 1006).withColumnRenamed("id", "k")
    plan = batch.seeded_order(ids, "k", 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in plan and "Exchange hashpartitioning" not in plan and "Sort" not in plan
    gaps = ids.where("k % 3 <> 0")
    got = batch.seeded_order(gaps, "k", 3, 2).where("NOT repeated").collect()
    assert sorted(r.position for r in got) == list(range(gaps.count())) and len({r.k for r in got}) == len(got)


def test_contiguous_range_by_bitmaps(spark):
    from goldpan.operators import constraints

    n = 100_000
    gone = {0, 1, 31, 32, 32767, 32768, 40000, 65535, 65536, 99_999} | set(range(70_000, 70_100))
    rows = [(i,) for i in range(n) if i not in gone] + [(5,), (5,), (-1,), (-1,), (n,), (2**40,), (None,)]
    df = spark.createDataFrame(rows, "id long")
    got = sorted(((r.id is None, r.id or 0), r.issue) for r in constraints.contiguous_range(df, "id", n).collect())
    want = [((False, i), "missing") for i in gone] + [((False, i), "unexpected") for i in (-1, n, 2**40)] + [((True, 0), "unexpected")]
    assert got == sorted(want)
    few = constraints.contiguous_range(df.where("id = 40001"), "id", 70_000)
    assert few.count() == 69_999 and constraints.contiguous_range(df.where("id IS NULL"), "id", 0).count() == 1


def test_prefix_gaps(spark):
    rng = random.Random(9)
    todo = [rng.randint(-70_000, 90_000) for _ in range(3000)]
    done = rng.sample(todo, 1500) + [10**7, None] + [todo[0]] * 5
    a = spark.createDataFrame([(i,) for i in todo] + [(None,)], "at long")
    b = spark.createDataFrame([(i,) for i in done], "at long")
    last = max(set(todo) & set(done))
    got = [r.at for r in batch.prefix_gaps(a, b, "at").collect()]
    assert sorted(got) == sorted(i for i in set(todo) - set(done) if i <= last)
    assert batch.prefix_gaps(a, b.where("at > 1000000"), "at").collect() == []
    same = batch.prefix_violations(a.distinct(), b, "at", "at").collect()
    assert sorted(r.at for r in same) == sorted(got)


def test_json_types_as_written(spark):
    from goldpan.operators import constraints

    cases = {
        '{"a":1}': "integer", '{"a":-0}': "integer", '{"a":1.0}': "float", '{"a":1e3}': "float", '{"a":true}': "boolean",
        '{"a":"1"}': "string", '{"a":null}': "null", '{"b":1}': "missing", '{"a":[1]}': "array", '{"a":{}}': "object",
        '{"a":123456789012345678901}': "integer", "nope": "malformed", "[1]": "missing", None: "malformed",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.t for r in rows.select("raw", constraints.json_type(F.col("raw"), "$.a").alias("t")).collect()}
    assert got == cases


def test_scan_of_any_keys(spark, tmp_path):
    import datetime

    rng = random.Random(4)
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randint(0, 900)) for _ in range(3000)]
    rows = [
        (f"k{rng.randint(0, 1500):04}", i, days[i], f"v{i}", f"s{i}" if i % 50 == 0 else None, None)
        for i in range(3000)
    ] + [(None, 1, None, "no key", "no key", None)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "k string, n int, d date, a string, b string, c string").sort("k").write.option(
        "parquet.block.size", 4096
    ).parquet(path)
    table = spark.read.parquet(path)
    frames = {
        "text": (table, ["k", "n"], ["a", "b", "c"]), "date": (table, ["d", "n"], ["a", "b"]),
        "number": (table, ["n"], ["a", "d"]), "nothing": (table, ["k"], []),
    }
    got = {(r[0], r[1], r[2]): r[3] for r in index.scan_tables(frames, 100).collect()}

    def wanted(keys, column):
        held = [r for r in rows if r[keys[0]] is not None and r[column] is not None]
        return {i + 1: str(r[column]) for i, r in enumerate(sorted(held, key=lambda r: [r[k] for k in keys])[:100])}

    places = {"k": 0, "n": 1, "d": 2, "a": 3, "b": 4, "c": 5}
    for name, (_, order, columns) in frames.items():
        for column in columns:
            mine = {o: v for (t, c, o), v in got.items() if (t, c) == (name, column)}
            want = wanted([places[k] for k in order], places[column])
            if order == ["n"]:  # repeated numbers: any order among them
                assert len(mine) == len(want)
            else:
                assert mine == want, (name, column)
    assert index.key_bounds(table, "k", ["a", "b", "c"], 100)["c"] is None
    plan = index.scanned_cells({"text": frames["text"]}, 100)[0]._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(k,k" in plan
