from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from goldpan.llm import token_files, tokenizing
from goldpan.llm.eliasfano import EliasFano

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], [2**63], [0, 2**64 - 1], *[np.sort(rng.integers(0, top, n)) for top, n in ((1, 300), (10, 2000), (10**6, 777), (10**12, 1025), (2**40, 3))]):
        values = np.array(values, dtype=np.uint64)
        raw = EliasFano.encode(values).to_bytes()
        code, used = EliasFano.from_bytes(memoryview(raw + b"more"))
        assert used == len(raw) and code.values().tolist() == values.tolist()
        assert [code.select(i) for i in range(len(values))] == values.tolist()
    dense = np.arange(0, 3_000_000, 300, dtype=np.uint64)
    assert len(EliasFano.encode(dense).to_bytes()) < len(dense) * 1.6


def texts():
    rng = random.Random(2)
    atoms = ["word", "Été", "straße", "x1", "don't", "...", ",", ".", "\n", "\t", " ", "  ", " ", " ", "\x1c", "\x85", "日本", "😀", "'s", "123", "a,b", "(", "###"]
    out = [None, "", " ", "  ", "\n ", " \n", "<|endoftext|>", "a <|endoftext|> b", "a\n <|endoftext|>", "a\n\n b", "x \n y", "end  ", "A" * 300]
    out += ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    out += [" ".join(rng.choice(atoms) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return out


def test_encoder_equals_the_library():
    plain, tool = Tokenizer.from_file(PATH), tokenizing.Encoder(PATH)
    for text in texts() * 2:
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(tool.encode(text), tool.kind).tolist() == want, text


def test_other_vocabularies_take_the_plain_way():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, tool = Tokenizer.from_file(path), tokenizing.Encoder(path)
    assert not tool.by_pieces
    for text in texts()[:60]:
        want = plain.encode(text, add_special_tokens=False).ids if text else []
        assert np.frombuffer(tool.encode(text), tool.kind).tolist() == want


def test_block_access():
    kind = np.dtype("<u2")
    bodies = [np.arange(n, dtype=kind).tobytes() for n in (3, 1, 700, 2)]
    block = token_files.Block(token_files.pack([None, -7, -7, 2**62], bodies, kind))
    assert block.keys() == [None, -7, -7, 2**62]
    assert [len(block.document(i)) for i in range(4)] == [3, 1, 700, 2]


def plain_rows(rows):
    tool = Tokenizer.from_file(PATH)
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tool.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, monkeypatch):
    rows = [(i * 7 - 300, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).repartition(4)
    key = lambda r: (r[1], str(r[0]))
    assert sorted(map(tuple, token_files.round_trip(docs, PATH).collect()), key=key) == plain_rows(rows)
    odd = [(None, "b"), (1, "same"), (1, "same"), (2, None), (2, None)]
    got = sorted(map(tuple, token_files.round_trip(spark.createDataFrame(odd, "doc_id long, text string"), PATH).collect()), key=key)
    assert got == plain_rows(odd)
    assert token_files.round_trip(docs.limit(0), PATH).count() == 0


def test_many_blocks_on_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, token_files.round_trip(docs.repartition(6), PATH).collect()))
    assert got == plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()])
