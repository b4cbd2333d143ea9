from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from goldpan.llm import piece_encoding as pe

PATH = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    "", " ", "   ", "a", " a", "a ", "two  spaces", "  lead and trail   ", "line\nbreak\tand\r\ntab", "▁", "x▁y ▁ z▁",
    "naïve café", "漢字かな交じり文", "😀👩‍👩‍👧 flags 🇩🇪", "ﬁne ①②③ Ａｂｃ ½ ㍿", "é combining ñ", "<s> </s> <unk> <0x41>",
    "\x00\x01\x7f control", " no break　wide​zero", "한국어 각", "ا العربية", "mixed 12345 67,89 a.b;c", "A" * 3000,
    "ß " * 500, "word " * 4000, "\U0010ffff end", "tab\t\t\tsp  ▁▁ x", "ｶﾞｷﾞ ﾊﾟ", "क्षि त्र",
]


def random_texts(n=300, seed=7):
    rng = random.Random(seed)
    marks = [" ", "  ", "\n", "\t", "▁", ".", "é", "é", "ﬁ", "漢", "😀", "　", "the", "of", "Ａ", "ｶﾞ", "½", "‍", "각"]
    return ["".join(rng.choice(marks + list("abcdef")) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def models():
    with open(PATH, "rb") as file:
        model = file.read()
    out = [("as it is", model)]
    for rule, trim in (("nmt_nfkc", True), ("nfkc_cf", False), ("identity", True)):
        made = sentencepiece.SentencePieceNormalizer(
            rule_name=rule, add_dummy_prefix=rule != "nfkc_cf", escape_whitespaces=True, remove_extra_whitespaces=trim
        )
        out.append((rule, pe.with_normalizer(model, made.serialized_normalizer_spec())))
    return out


@pytest.mark.parametrize("name,model", models(), ids=[n for n, _ in models()])
def test_equals_the_library(name, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    tool = pe.Encoder(model)
    for text in TEXTS + random_texts():
        ids, starts, ends = tool.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(starts.tolist(), ends.tolist())) == spans, repr(text)


def test_spans_follow_each_other():
    tool = pe.encoder(PATH)
    for text in TEXTS + random_texts(50, 3):
        _, starts, ends = tool.encode(text)
        if text:
            assert starts[0] == 0 and ends[-1] == len(text.encode())
            assert (starts[1:] == ends[:-1]).all()


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(pe, "CACHE", 20)
    with open(PATH, "rb") as file:
        tool = pe.Encoder(file.read())
    texts = random_texts(60, 5) + TEXTS
    together = tool.encode_all(texts)
    assert all((a[0] == tool.encode(t)[0]).all() for a, t in zip(together, texts))
    assert all(len(cut) <= pe.LONGEST for cut in tool.known)


def test_longest_entry_wins():
    made = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    spec = made.serialized_normalizer_spec()
    blob = next(v for n, v, _ in pe.fields(spec) if n == pe.CHARSMAP)
    entries = pe.character_map(blob)
    assert entries["ﬁ".encode()] == b"fi" and entries["é".encode()].decode() == "é"
    normal, origin = pe.Normalizer(spec, [], False)("xéﬁ")
    assert normal == "▁xéfi" and origin.tolist() == [0, 0, 0, 0, 1, 1, 4, 4, 7]


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(pe, "TEXT_BYTES", 64)
    texts = [*TEXTS, None, "same", "same", "long " * 40000]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "no id", "x", 0), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, decoded int").repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = {(i, t): library.encode(t or "") for i, t, *_ in rows}
    found = pe.encode_texts(docs, PATH).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"doc_id", "text", "decoded", "ids", "starts", "ends"}
    assert all(r.ids == ids[r.doc_id, r.text] for r in found)
    for row in found:
        raw = (row.text or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(row.starts, row.ends)) == raw

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    expected = sorted(
        (str(i), len(x), sha(",".join(map(str, x))), sha(library.decode(x) if x else "")) for (i, _), x in
        ((k, ids[k]) for k in ((i, t) for i, t, *_ in rows))
    )
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, pe.digests(docs, PATH).collect())) == expected
    assert pe.digests(docs.limit(0), PATH).collect() == []


def test_query_reads_whole_table(spark):
    from goldpan.llm import plans

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = plans.QUERIES["op12_pieces"](spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
