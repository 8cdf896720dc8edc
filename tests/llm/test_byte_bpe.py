"""Byte-level ids and texts against the tokenizer library itself."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from plumbline.llm import bytebpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "   ", "  \n \n x\n\n\ny  ", "it's we'll they've x'r 're ''s I'M", "<|endoftext|>hi<|endoftext|><|endoftext|> <|end", "aaaaaaaaaaaa" * 50, "a" * 4001, "日本語テキスト" * 300, "\x1c\x1d a\x85b\xa0 c  d",
    "🙂🙂 ﬁ ½ é é", "tab\tnew\nline\r\n", "123 4567 ٣٤ Ⅷ", "###***&&& a%%%", "\x00\x7f", " x" * 3000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return bytebpe.ByteBpe(PATH, table=50)


def same(bpe, library, texts):
    for text, got in zip(texts, bpe.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(got, "<i4")
        assert got.tolist() == ids, text[:80]
        assert bpe.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_odd_texts(bpe, library):
    same(bpe, library, ODD)
    for text in ODD:  # one by one, with a table that forgets
        same(bpe, library, [text])


def test_every_code_point(bpe, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a1{c}1 {c} {c}{c}#{c}# {c}" for c in points]
    for k in range(0, len(texts), 50_000):
        some = texts[k : k + 50_000]
        for text, got, e in zip(some, bpe.encode(some), library.encode_batch(some, add_special_tokens=False)):
            assert np.frombuffer(got, "<i4").tolist() == e.ids, text


def test_random_words_in_both_kinds_of_rounds(bpe, library, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("thenaior' .,1é#\n\t A") for _ in range(rng.randint(1, 800))) for _ in range(100)]
    texts += ["".join(rng.choice("abn") for _ in range(rng.randint(1, 1500))) for _ in range(60)]
    same(bpe, library, texts)
    monkeypatch.setattr(bytebpe, "LONG", 0)
    same(bytebpe.ByteBpe(PATH), library, texts)
    monkeypatch.setattr(bytebpe, "LONG", 1 << 30)
    same(bytebpe.ByteBpe(PATH), library, texts)


def test_any_ids_decode_as_in_the_library(bpe, library):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(30)]
        assert bpe.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(np.array([-1, 50_257, 1 << 30])) == ""


def test_very_long_words_take_little_time(bpe):
    import time

    rng = random.Random(7)
    began = time.perf_counter()
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    assert bpe.decode(np.frombuffer(bpe.encode([word])[0], "<i4")) == word
    assert time.perf_counter() - began < 30


def test_operators_on_odd_rows(spark, library):
    rows = [(k, t, 1, "x") for k, t in enumerate(ODD)] + [(None, None, 2, "y"), (3, ODD[3], 3, None), (3, ODD[3], 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int, source string")
    encoded = bytebpe.encode_texts(docs, PATH)
    assert encoded.columns == ["doc_id", "text", "source", "ids"]
    for r in bytebpe.decode_ids(encoded, PATH, out="again").collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["again"] == (r["text"] or "")
    given = spark.createDataFrame([(1, None), (2, []), (3, [None, 5, 99_999, -3])], "k int, ids array<long>")
    assert {r["k"]: r["text"] for r in bytebpe.decode_ids(given, PATH).collect()} == {1: "", 2: "", 3: library.decode([5])}
    assert bytebpe.decode_ids(bytebpe.encode_texts(docs.limit(0), PATH), PATH).count() == 0


def test_query(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op13_bpe_encoding(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
