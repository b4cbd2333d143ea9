"""Run registered queries and their checking SQL side by side.

Usage: python tests/compare.py [scale folder] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def cell(value) -> str:
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return format(value + 0.0 if value else 0.0, ".9g")
    if isinstance(value, list):
        return str([cell(v) for v in value])
    return str(value)


def normal(columns: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(frame, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    kinds = [str(d[1]) for d in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    want = normal(names, expected)
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} vs {len(want)}\n   spark only {extra}\n   sql only   {missing}"
    spark_kinds = dict(frame.dtypes)
    loose = {"HUGEINT": "?", "DECIMAL": "?"}
    odd = [
        (n, k, spark_kinds[n])
        for n, k in zip(names, kinds)
        if k.startswith(tuple(loose))
        or (k == "BIGINT" and spark_kinds[n] != "bigint")
        or (k == "INTEGER" and spark_kinds[n] != "int")
        or (k == "DOUBLE" and spark_kinds[n] != "double")
    ]
    if odd:
        return f"types {odd}"
    if not got:
        return "no rows"
    return None


def main() -> None:
    from goldpan.plans import load
    from goldpan.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = load()
    bad = []
    for name in queries:
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in oracles:
                problem = difference(frame, con, oracles[name])
            else:
                problem = None if frame.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - started:.1f}s {'' if name in oracles else '(rows only)'}", flush=True)
        if problem:
            bad.append(name)
            print("   " + problem, flush=True)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
