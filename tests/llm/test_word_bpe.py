"""Ids and prefix counts against the tokenizer library itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import packing, queries, token_counts
from plumbline.llm.wordbpe import WordBpe

ODD = [
    "", "   ", "it's we'll they've x'r 're ''s", "<|endoftext|>hi<|startoftext|> <|end", "naïve CAFÉ é İstanbul ΣΑΣ\x85\xa0a", "x y\x1cz 12345 🙂🙂 ﬁ ½", "a" * 300 + " " + "ab" * 50, "日本語 テキスト　全角",
    "é égalit́e", "tab\tnew\nline\r\n", "'", "'S 'LL", "###***&&& a%%%",
]


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(queries.vocabulary(), cache=50)


@pytest.mark.parametrize("text", ODD)
def test_ids_and_every_prefix(bpe, text):
    ids = lambda t: bpe.library.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == ids(text)
    assert bpe.prefix_counts(text).tolist() == [len(ids(text[: i + 1])) for i in range(len(text))]


def test_primed_tables_are_the_same(bpe):
    random.seed(1)
    texts = ["".join(random.choice("thenaior' .,1é#") for _ in range(200)) for _ in range(20)]
    fresh = WordBpe(queries.vocabulary())
    fresh.prime(texts)
    for t in texts:
        assert fresh.prefix_counts(t).tolist() == [len(bpe.library.encode(t[: i + 1], add_special_tokens=False).ids) for i in range(len(t))]


def test_operator_on_odd_rows(spark, bpe):
    rows = [(k, t, None) for k, t in enumerate(ODD)] + [(None, None, 1), (3, ODD[3], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counts int")
    out = token_counts.with_prefix_counts(docs, queries.vocabulary()).collect()
    assert len(out) == len(rows)
    for r in out:
        text = r["text"] or ""
        n = len(bpe.library.encode(text, add_special_tokens=False).ids)
        assert token_counts.read_count(bytes(r["prefix_counts"]), 1 << 30) == n
    from pyspark.sql import functions as F

    measured = token_counts.with_prefix_counts(docs, queries.vocabulary()).select(
        token_counts.count_at(F.col("prefix_counts"), 5).alias("at5"), token_counts.longest_prefix_within(F.col("prefix_counts"), 3).alias("fit"), "text"
    )
    for r in measured.collect():
        ids = lambda t: len(bpe.library.encode(t, add_special_tokens=False).ids)
        text = r["text"] or ""
        assert r["at5"] == ids(text[:5])
        assert r["fit"] == max((i for i in range(1, len(text) + 1) if ids(text[:i]) <= 3), default=0)
    assert token_counts.with_prefix_counts(docs.limit(0), queries.vocabulary()).count() == 0


def test_query_counts(spark, sf_dir, bpe):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_token_counts(spark, sf_dir).collect():
        n = len(bpe.library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(docs[r["doc_id"]].encode()), n > 2048)


def test_pieces_and_packing(spark, sf_dir, bpe):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pieces = packing.cut(packing.token_pieces(docs, queries.vocabulary(), capacity=512), "pieces")
    for salt_rows in (2000, 3):
        out = packing.pack(pieces, 512, salt_rows=salt_rows).toPandas()
        for doc, rows in out.groupby("doc_id"):
            ids = np.array([*bpe.library.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4").tobytes()
            rows = rows.sort_values("piece")
            assert rows.start.tolist() == list(range(0, len(ids) // 4, 512))
            assert rows.ids_crc32.tolist() == [zlib.crc32(ids[4 * a : 4 * a + 2048]) for a in rows.start]
            assert rows.length.sum() == len(ids) // 4
        for _, rows in out.groupby("sequence_id"):
            rows = rows.sort_values("offset")
            assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]]
            assert rows.length.sum() <= 512
        assert out.sequence_id.nunique() <= packing.pack_one_by_one(out.length.tolist(), 512)
    assert packing.pack(pieces.limit(0), 512).count() == 0


def test_repeated_rows_are_packed_each(spark, monkeypatch):
    rows = [(7, "the same words again and again")] * 3000 + [(None, None)] * 500
    monkeypatch.setattr(packing.pack, "__defaults__", (4096, "length", ("doc_id", "piece"), 200))
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), queries.vocabulary(), 64).toPandas()
    assert len(out) == 3500 and not out.duplicated(["sequence_id", "offset"]).any()
    ends = (out.offset + out.length).groupby(out.sequence_id).max()
    assert (ends <= 64).all() and ends.sum() == out.length.sum()


def test_plan_is_that_of_single_pieces():
    from collections import Counter

    random.seed(3)
    for _ in range(200):
        capacity = random.choice([7, 30, 100, 4096])
        lengths = [random.randint(1, capacity if random.random() < 0.5 else max(1, capacity // 4)) for _ in range(random.randint(0, 200))]
        placements, n = packing.plan(dict(Counter(lengths)), capacity)
        held: dict[int, list] = {}
        for length, _, many, first, each, offset in placements:
            for j in range(many):
                held.setdefault(first + j // each, []).append((offset + j % each * length, length))
        assert sorted(x for v in held.values() for _, x in v) == sorted(lengths)
        assert set(held) == set(range(n))
        for v in held.values():
            at = 0
            for o, length in sorted(v):
                assert o == at
                at += length
            assert at <= capacity
        assert packing.lower_bound(lengths, capacity) <= n <= packing.pack_one_by_one(lengths, capacity)
