from __future__ import annotations

import os

from goldpan import session
from goldpan.operators import catalog as cat

COLUMNS = "db_id string, table_name string, table_ordinal long, ordinal long, column_name string"
DESCRIBED = (
    "db_id string, file string, original_column_name string, column_description string, "
    "value_description string, data_format string, row_ordinal long"
)


def rows(spark):
    columns, described = [], []
    for d in range(30):
        for t in range(4):
            for c in range(3):
                columns.append((f"db{d}", f"Table{t}", t, 10 * t + c, f"Col_{t}_{c}"))
                file = f"notes{t}" if t == 3 else f"table{t}"
                if t != 2:  # the third table has no file
                    described.append((f"db{d}", file, f"COL_{t}_{c}", f"first {d}", None, "text", c))
                    described.append((f"db{d}", file, f"col_{t}_{c}", f"last {d}", "coded", "int", c + 100))
    columns += [(None, "Table0", 0, 1, "Col_0_0"), ("db0", "Table0", 0, 1, None), ("db0", "Table0", 0, 99, "cOL_0_0"), ("db0", "Table0", 0, 98, "")]
    columns += columns[:2]
    described += [("db0", "table0", None, "x", "x", "x", 1), ("db0", "table0", "", "x", "x", "x", 1), (None, "table0", "Col_0_0", "x", "x", "x", 1)]
    described += [("db1", "table0", "Col_0_2", "no number", "", "", None)]
    want = []
    for db, table, _, ordinal, name in columns:
        known = db and table != "Table2" and name
        want.append((db, table, ordinal, name, *((f"last {db[2:]}", "coded", "int") if known else ("", "", ""))))
    return spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(described, DESCRIBED), sorted(want, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("db_id", "table_name", "ordinal", "column_name", *cat.DESCRIPTION_FIELDS).collect()), key=str)


def test_descriptions_leave_no_shuffles_behind(spark, monkeypatch):
    """F2, b22_column_descriptions: a large catalog is matched in slices whose shuffles are gone."""
    columns, described, want = rows(spark)
    mapping = cat.map_description_files(columns, described)
    assert {(r["table_name"], r["how"]) for r in mapping.collect()} == {("Table0", "name"), ("Table1", "name"), ("Table3", "overlap")}
    small = cat.column_descriptions(columns, mapping, described)
    assert found(small) == want
    monkeypatch.setattr(cat, "AT_ONCE", 5)
    large = cat.column_descriptions(columns, mapping, described)
    assert "Exchange" not in large._jdf.queryExecution().executedPlan().toString()
    assert found(large) == want


def test_columns_and_descriptions_meet_in_one_shuffle(spark):
    columns, described, _ = rows(spark)
    mapping = cat.map_description_files(columns, described)
    plan = cat.column_descriptions(columns, mapping, described)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_tables_that_nothing_reads_are_deleted(spark):
    columns, described, _ = rows(spark)
    before = len(session._SCRATCH.get(spark.sparkContext.applicationId, []))
    choices = cat.description_choices(columns, described)
    paths = session._SCRATCH[spark.sparkContext.applicationId][before:]
    assert len(paths) == 2 and all(os.path.isdir(p.removeprefix("file://")) for p in paths)
    assert choices.count() == 30 * 4 + 1
    session.discard(session.cut(spark.range(3)))
    assert len(session._SCRATCH[spark.sparkContext.applicationId]) == before + 2
