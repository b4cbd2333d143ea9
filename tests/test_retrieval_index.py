from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from goldpan.operators import retrieval_index as ri

ROWS = (
    "split string, db_id string, row_id string, table_name string, column_name string, row_kind string, "
    "value string, search_text string"
)


def rows_of(texts):
    """(split, db, row id, text) as index rows."""
    return [(s, d, i, "t", "c", "value", x, x) for s, d, i, x in texts]


def stored(spark, tmp_path, texts):
    index = ri.StoredIndex(spark, f"file://{tmp_path}/index")
    index.refresh(spark.createDataFrame(rows_of(texts), ROWS), lambda rows: rows)
    return index


def brute(texts, questions, n):
    """Every row scored for every question, phrases found by walking the tokens."""
    split = [(s, d, i, x.split()) for s, d, i, x in texts]
    mean = sum(len(t) for *_, t in split) / len(split)

    def count(tokens, phrase):
        return sum(tokens[a : a + len(phrase)] == phrase for a in range(len(tokens) - len(phrase) + 1))

    out = {}
    for q, s, d, terms in questions:
        scores = []
        for s2, d2, i, tokens in split:
            if (s2, d2) != (s, d):
                continue
            total = 0.0
            for term in terms:
                phrase = term.split("_")
                df = sum(count(t, phrase) > 0 for *_, t in split)
                tf = count(tokens, phrase)
                if tf:
                    idf = math.log((len(split) - df + 0.5) / (df + 0.5))
                    idf = idf if idf > 0 else 1e-6
                    total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / mean))
            if total:
                scores.append((-round(total, 9), i))
        out[q] = [(i, r + 1, pytest.approx(x, abs=2e-9)) for r, (x, i) in enumerate(sorted(scores)[:n])]
    return out


def found(spark, index, questions, n):
    asked = spark.createDataFrame(
        [(q, s, d, " ".join(terms), "") for q, s, d, terms in questions],
        "q int, split string, db_id string, question string, evidence string",
    )
    got = ri.best_rows(ri.question_phrases(asked, "q"), index, "q", n).collect()
    out = {q: [] for q, *_ in questions}
    for r in sorted(got, key=lambda r: r.hit_rank):
        out[r.q].append((r.row_id, r.hit_rank, r.score))
    return out


@pytest.mark.parametrize("n", [5, 400])
def test_best_rows_against_brute_force(spark, tmp_path, n):
    rng = random.Random(n)
    words = ["red", "green", "blue", "ring", "widget", "steel", "brass", "tin", "rare"]
    weight = [30, 20, 10, 8, 5, 4, 3, 2, 1]
    texts = [
        (rng.choice(["train", "dev"]), f"d{rng.choice('000012')}", f"r{i:03}",
         " ".join(rng.choices(words, weight, k=rng.randint(1, 12))))
        for i in range(300)
    ]
    texts += [("train", "d0", f"same{i:02}", "red brass ring") for i in range(40)]
    questions = [
        (1, "train", "d0", ["red", "brass"]), (2, "train", "d0", ["red_brass"]), (3, "dev", "d1", ["rare", "red", "green"]),
        (4, "train", "d0", ["red", "green", "blue", "ring", "widget", "rare", "tin_tin"]), (5, "train", "d0", ["absent"]),
        (6, "train", "none", ["red"]), (7, "train", "d0", ["red_green_red", "green_absent"]),
        (8, "train", "d0", ["red", "brass"]),
    ]
    index = stored(spark, tmp_path, texts)
    assert found(spark, index, questions, n) == brute(texts, questions, n)


def test_phrase_needs_its_order_and_neighbourhood(spark, tmp_path):
    texts = [("s", "d", "1", "first name"), ("s", "d", "2", "name first"), ("s", "d", "3", "first and name"),
             ("s", "d", "4", "the first name first name"), ("s", "e", "5", "first name")]
    got = found(spark, stored(spark, tmp_path, texts), [(1, "s", "d", ["first_name"])], 9)
    assert [r[0] for r in got[1]] == ["4", "1"] or [r[0] for r in got[1]] == ["1", "4"]


def test_two_spellings_count_twice(spark, tmp_path):
    index = stored(spark, tmp_path, [("s", "d", str(i), "cafe" if i == 1 else "tea") for i in range(9)])
    asked = [(1, "s", "d", ["cafe"]), (2, "s", "d", ["cafe", "café"])]
    got = found(spark, index, asked, 3)
    assert got[2][0][2] == pytest.approx(2 * got[1][0][2], abs=2e-9)


def files(tmp_path, name):
    return {
        f"{os.path.relpath(folder, tmp_path)}/{file}"
        for folder, _, names in os.walk(f"{tmp_path}/index/{name}") for file in names if file.endswith(".parquet")
    }


def test_refresh_writes_changed_databases_alone(spark, tmp_path):
    texts = [("train", f"00{d}", f"{d}-{i}", f"word{i} of {d}") for d in range(4) for i in range(5)]
    index = stored(spark, tmp_path, texts)
    before = {n: files(tmp_path, n) for n in ("rows", "postings", "terms")}

    def again(new):
        changed = index.refresh(spark.createDataFrame(rows_of(new), ROWS), lambda rows: rows)
        return sorted(r.db_id for r in changed.collect())

    assert again(list(reversed(texts))) == [] and index.version() == 1
    # One text changes: only that partition has new files.
    new = [(s, d, i, x + " more" if i == "2-3" else x) for s, d, i, x in texts]
    assert again(new) == ["002"] and index.version() == 2
    for name, old in before.items():
        now = files(tmp_path, name)
        assert {f for f in now ^ old if "db_id=002" not in f} == set() and now != old
    assert {r.term for r in index.postings().where("row_id = '2-3'").collect()} == {"word3", "of", "2", "more"}
    # A database goes, one comes, one keeps rows but no token.
    new = [(s, d, i, "" if d == "001" else x) for s, d, i, x in new if d != "003"] + [("dev", "003", "9", "new")]
    assert again(new) == ["001", "003"]
    state = {(r.split, r.db_id): (r.written_by, r.row_count, r.token_count) for r in index.state().collect()}
    assert state == {("train", "000"): (1, 5, 15), ("train", "001"): (3, 5, 0), ("train", "002"): (2, 5, 16), ("dev", "003"): (3, 1, 1)}
    assert {r.db_id for r in index.postings().collect()} == {"000", "002", "003"}
    assert index.rows().count() == 16 and index.terms().where("db_id = '001'").count() == 0


def test_refresh_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    texts = [("s", d, f"{d}{i}", f"{d} word") for d in "ab" for i in range(3)]
    index = stored(spark, tmp_path, texts)
    new = [(s, d, i, x + " new" if d == "b" else x) for s, d, i, x in texts]
    frame = spark.createDataFrame(rows_of(new), ROWS)
    whole = ri.StoredIndex._write

    def broken(self, df, name, number, *order, **how):
        if name == "terms":
            raise RuntimeError("lost")
        whole(self, df, name, number, *order, **how)

    monkeypatch.setattr(ri.StoredIndex, "_write", broken)
    with pytest.raises(RuntimeError):
        index.refresh(frame, lambda rows: rows)
    assert index.version() == 1
    assert {(r.db_id, r.term) for r in index.postings().collect()} == {("a", "a"), ("a", "word")}  # nothing half-written
    monkeypatch.setattr(ri.StoredIndex, "_write", whole)
    assert [r.db_id for r in index.refresh(frame, lambda rows: rows).collect()] == ["b"]
    assert index.postings().where("term = 'new'").count() == 3


def test_bounds_keep_weak_terms_out_of_the_aggregate(spark, tmp_path):
    """A term that every row holds is only added to rows that rarer terms have brought in."""
    texts = [("s", "d", f"{i:04}", "common " * (1 + i % 3) + ("rare" if i % 40 == 0 else f"w{i}")) for i in range(2000)]
    index = stored(spark, tmp_path, texts)
    queries = spark.createDataFrame(
        [(1, "s", "d", "common", 1), (1, "s", "d", "rare", 1)], "_query int, split string, db_id string, phrase string, _times long"
    )
    scored = ri.scored_rows(queries, index, 10)
    assert 10 <= scored.count() <= 50  # of 2000 matching rows
    pruned = index.postings().where((F.col("split") == "s") & (F.col("db_id") == "d") & (F.col("term") == "rare"))
    plan = pruned._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,rare)" in plan
