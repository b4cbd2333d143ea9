from __future__ import annotations

import random

from pyspark.sql import functions as F

from goldpan.llm import line_dedup, plans


def cut_by_hand(text, unit):
    """(units, what stands behind each) without a pattern."""
    units, behind, start, at = [], [], 0, 0
    while at < len(text):
        end = at
        if unit == "sentence" and at and text[at - 1] in ".!?":
            while end < len(text) and text[end] in " \t":
                end += 1
        if end == at and text[at] == "\n":
            end = at + 1
        if end > at:
            units.append(text[start:at])
            behind.append(text[at:end])
            start = at = end
        else:
            at += 1
    return [*units, text[start:]], [*behind, ""]


def plain(rows, least, unit="line"):
    """One pass over the documents in rank order."""
    units = []
    for doc_id, text in {r: 0 for r in rows}:
        for place, part in enumerate(cut_by_hand(text or "", unit)[0]):
            clean = " ".join(part.lower().split())
            if clean:
                units.append((doc_id is None, doc_id or 0, place, (doc_id, text), clean))
    first = {}
    for *rank, doc, clean in sorted(units, key=lambda u: u[:3]):
        first.setdefault(clean, (doc, rank[2]))
    out = []
    for doc in rows:
        text = doc[1]
        if text is None:
            out.append((doc[0], [], None))
            continue
        cut, behind = cut_by_hand(text, unit)
        later = [
            bool(u.strip()) and first[" ".join(u.lower().split())] != (doc, p) for p, u in enumerate(cut)
        ]
        gone, run = set(), []
        for p in range(len(cut) + 1):
            if p < len(cut) and (later[p] or not cut[p].strip()):
                run.append(p)
                continue
            hit = [q for q in run if later[q]]
            if sum(len(cut[q].split()) for q in hit) >= least:
                gone.update(hit)
            run = []
        spans, at = [], 0
        for p, u in enumerate(cut):
            spans.append((at, at + len(u)))
            at += len(u) + len(behind[p])
        stay = [p for p in range(len(cut)) if p not in gone]
        rest = "".join(cut[p] + (behind[p] if p != stay[-1] else "") for p in stay)
        out.append((doc[0], [spans[p] for p in sorted(gone)], text if not gone else rest))
    return sorted(out, key=str)


def run(spark, rows, least, unit="line"):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("places", F.lit(1))
    found = line_dedup.remove_repeated(frame.repartition(4), unit, least_words=least).collect()
    for r in found:
        assert r["n_removed"] == len(r["removed"])
    return sorted(((r["doc_id"], [tuple(s) for s in r["removed"]], r["text"]) for r in found), key=str)


def test_against_one_pass(spark):
    rng = random.Random(1)
    pool = [" ".join(rng.choice("ab é Zz q".split()) for _ in range(rng.randint(1, 9))) for _ in range(30)] + ["", "  ", "\t"]
    rows = [(i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, pool[0] + "\nonly here"), (7, rows[7][1]), (103, rows[3][1])]
    for least in (0, 6, 50):
        assert run(spark, rows, least) == plain(rows, least)
    assert run(spark, [], 0) == []


def test_paragraphs(spark):
    text = "One two\nthree\n\nFour five \n \nsix"
    rows = [(1, text), (2, "x\n\none  two three\n\nsix"), (3, "Six")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in line_dedup.remove_repeated(frame, "paragraph", 0).collect()}
    assert found[1]["text"] == text and found[2]["text"] == "x" and found[3]["text"] == ""
    assert [text[a:b] for a, b in found[1]["kept"]] == ["One two\nthree", "Four five ", "six"]


def test_sentences_against_one_pass(spark):
    rng = random.Random(2)
    pool = ["One two.", "Is it?  ", "no end", "A b c d e f g h!", "", "...", "x. y", "Zz!\n", " \t", "mr. x said é."]
    rows = [(i, "".join(rng.choice(pool) + rng.choice([" ", "\n", "\t", ""]) for _ in range(rng.randint(0, 9)))) for i in range(90)]
    rows += [(100, None), (101, ""), (102, "."), (None, "One two. only here"), (7, rows[7][1])]
    for least in (0, 4, 16):
        assert run(spark, rows, least, "sentence") == plain(rows, least, "sentence")
    assert run(spark, [], 0, "sentence") == []


def test_planted_passages_go_and_clean_documents_stay(spark):
    """Passages of over 50 words amid other text, with other line breaks around and inside them."""
    rng = random.Random(5)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "lm", "")]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(5, 14))).capitalize() + "."
    passages = [[sentence() for _ in range(8)] for _ in range(12)]
    assert all(sum(len(s.split()) for s in p) > 50 for p in passages)
    rows, planted, clean = [], {}, set()
    for doc in range(240):
        body = [sentence() for _ in range(rng.randint(6, 20))] + ["All rights reserved."]
        if doc % 4 == 0:
            number, at = rng.randrange(len(passages)), rng.randrange(len(body))
            body[at:at] = passages[number]
            planted.setdefault(number, []).append(doc)
        else:
            clean.add(doc)
        rows.append((doc, "".join(s + rng.choice([" ", " ", " ", "\n"]) for s in body)))
    gone = {doc: text for doc, removed, text in run(spark, rows, 16, "sentence") if removed}
    later = [(number, doc) for number, docs in planted.items() for doc in sorted(docs)[1:]]
    assert len(later) > 40 and all(doc in gone for _, doc in later) and not clean & set(gone)
    for number, doc in later:
        assert not any(s in gone[doc] for s in passages[number])  # whole passages, not parts


def test_query_removes_repeated_sentences(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = plans.QUERIES["op6_line_dedup"](spark, folder).collect()
    got = sorted(((r["doc_id"], [tuple(s) for s in r["removed"]], r["text"]) for r in found), key=str)
    assert got == plain(rows, 16, "sentence")
