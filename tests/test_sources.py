"""Sources, sinks, archives and resumable streams on small files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import integrity, sampling
from plumbline.sources import jsonl, sinks
from plumbline.streaming import resume


def test_strict_and_lenient_scan(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n{"a": 2}\n')
    bad.write_text('{"a": 1}\n\n[3]\n{"a": 4}\n')
    assert [(r["line_no"], r["record"]["a"]) for r in jsonl.scan(spark, str(good), "a int").orderBy("line_no").collect()] == [(1, 1), (2, 2)]
    with pytest.raises(Exception, match="blank line at"):
        jsonl.scan(spark, str(bad)).collect()
    assert [r["line_no"] for r in jsonl.scan(spark, str(bad), strict=False).orderBy("line_no").collect()] == [1, 3, 4]
    assert jsonl.count_records(spark, str(bad), strict=False).first()["records"] == 3


def test_ledger_and_line_sets(spark, tmp_path):
    d = hashlib.sha256(b"x").hexdigest()
    (tmp_path / "sums").write_text(f"{d}  a/b c.txt\n")
    (tmp_path / "held").write_text(" k1 more\nk2\n\nk1 other\n")
    assert tuple(jsonl.ledger(spark, str(tmp_path / "sums")).first()) == ("a/b c.txt", d)
    assert sorted(r["key"] for r in jsonl.line_set(spark, str(tmp_path / "held"), True).collect()) == ["k1", "k2"]
    (tmp_path / "wrong").write_text("abc\n")
    with pytest.raises(Exception, match="no ledger line"):
        jsonl.ledger(spark, str(tmp_path / "wrong")).collect()


def test_image_union(spark):
    rows = spark.createDataFrame([('"a.png"',), ('["a.png", {"virtual_crop": true, "path": "a.png", "crop_xyxy": [1, 2, 3, 4]}]',)], "j string")
    out = [r["i"] for r in rows.select(jsonl.image_items(F.try_parse_json("j")).alias("i")).collect()]
    assert [len(x) for x in out] == [1, 2]
    assert out[1][1]["crop_xyxy"] == [1, 2, 3, 4] and out[0][0]["path"] == "a.png"


def test_image_size(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    row = spark.createDataFrame([(bytearray(png),), (bytearray(b"none"),)], "c binary").select(jsonl.image_size("c").alias("s")).collect()
    assert tuple(row[0]["s"]) == (640, 480)


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([("train", k, "x" * (k % 5) + "é") for k in range(40)], "split string, k int, t string")
    out = sinks.with_shards(rows, ["split"], ["k"], 200).orderBy("k").collect()
    held, shard = 0, 0
    for r in out:
        n = len(json.dumps({"split": r["split"], "k": r["k"], "t": r["t"]}, separators=(",", ":"))) + 1
        assert r["n_bytes"] == n
        if held > 0 and held + n > 200:
            held, shard = 0, shard + 1
        held += n
        assert r["shard"] == shard
    sinks.write_shards(rows, str(tmp_path / "out"), ["split"], ["k"], 200)
    assert spark.read.text(str(tmp_path / "out")).count() == 40


def test_stream_resumes(spark, tmp_path):
    source, store, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")
    source.mkdir()
    (source / "a.json").write_text('{"k": 1}\n{"k": 2}\n{"k": 2}\n')
    read = lambda: spark.readStream.schema("k long").json(str(source))
    double = lambda df: df.withColumn("v", F.col("k") * 2)
    resume.process_stream(spark, read(), double, store, "k", check)
    (source / "b.json").write_text('{"k": 2}\n{"k": 3}\n')
    resume.process_stream(spark, read(), double, store, "k", check)
    resume.process_stream(spark, read(), double, store, "k", check + "-lost")  # the checkpoint is gone: nothing is added twice
    rows = resume.stored(spark, store)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2), (2, 4), (3, 6)]
    resume.check_store(rows, "k")
    assert resume.certificate(rows, "k", 3)["complete"]
    # batches read the state and not the store: what is deleted there doesn't come back
    (source / "c.json").write_text('{"k": 1}\n{"k": 9}\n{"k": null}\n{"k": null}\n')
    files = len(list((tmp_path / "store").rglob("*.parquet")))
    resume.process_stream(spark, read(), double, store, "k", check)
    assert len(list((tmp_path / "store").rglob("*.parquet"))) > files
    assert sorted((tuple(r) for r in resume.stored(spark, store).collect()), key=str) == [(1, 2), (2, 4), (3, 6), (9, 18), (None, None)]
    # a store that has a key twice can't start a new checkpoint
    spark.createDataFrame([(3, 6)], "k long, v long").write.parquet(f"{store}/batch=by-hand")
    with pytest.raises(Exception, match="stored twice"):
        resume.process_stream(spark, read(), double, store, "k", check + "-new")


def test_checks_report_what_was_planted(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "z"), (4, "w")], "k int, v string")
    assert [tuple(r) for r in integrity.duplicate_keys(a, ["k"]).collect()] == [(2, 2)]
    assert sorted(tuple(r) for r in integrity.coverage(a.dropDuplicates(), b, "k", ["v"]).collect()) == [(2, "missing"), (3, "differs"), (4, "extra")]
    assert sorted(tuple(r) for r in integrity.multiset_difference(a, b, "k").collect()) == [(2, 2, 0), (4, 0, 1)]
    with pytest.raises(ValueError, match="twice"):
        integrity.require_empty(integrity.duplicate_keys(a, ["k"]), "stored twice")


def test_coverage_of_repeated_and_null_keys(spark):
    a = spark.createDataFrame([("u", "x"), ("u", "x"), ("u", "y"), ("v", "x"), ("v", "x"), (None, "x"), (None, "y")], "k string, v string")
    b = spark.createDataFrame([("u", "x"), ("u", "z"), ("v", "x"), ("v", "x"), ("v", "x"), (None, "x"), (None, "z")], "k string, v string")
    got = sorted((str(r["k"]), r["status"]) for r in integrity.coverage(a, b, "k", ["v"]).collect())
    assert got == [("None", "differs"), ("u", "differs"), ("u", "missing"), ("v", "extra")]
    many = a.limit(1).crossJoin(spark.range(10_000)).select("k", "v")
    assert integrity.coverage(many, b.limit(0), "k", ["v"]).groupBy("k", "status").count().collect() == [("u", "missing", 10_000)]


def test_water_fill(spark):
    files = spark.createDataFrame([("a", 7), ("b", 1000), ("c", 3), ("d", 12)], "path string, records long")
    take = lambda limit: [r["take"] for r in sampling.water_fill(files, limit).orderBy("path").collect()]
    assert take(8) == [2, 2, 2, 2]
    assert take(30) == [7, 10, 3, 10]
    assert take(31) == [7, 11, 3, 10]  # the earlier file has what is left over
    assert take(40) == [7, 18, 3, 12]
    assert take(0) == take(5000) == [7, 1000, 3, 12]


def test_rank_schedule_covers_all(spark):
    rows = spark.range(10).select(F.col("id").alias("pos"))
    out = sampling.rank_schedule(rows, "pos", 10, 2, 4).collect()
    assert sorted(r["pos"] for r in out) == sorted([*range(10), 0, 1])
    assert {(r["rank"], r["step"]) for r in out} == {(r, s) for r in range(4) for s in range(3)}
