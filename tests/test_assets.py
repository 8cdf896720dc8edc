"""Digests, the content-addressed sink and the directory walk on small trees."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from plumbline.sources import assets


def tree(root, files):
    for name, raw in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(raw)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_digests_cache_and_expected_values(spark, tmp_path):
    files = {"a/x.png": b"one", "b c/y.JPG": b"two", "z": b"", "big.bin": b"0123456789" * 600_000}
    tree(tmp_path, files)
    found = assets.trusted_digests(assets.listed(spark, str(tmp_path)))
    rows = found.collect()
    assert {r["path"].split(f"{tmp_path.name}/")[1]: (r["bytes"], r["sha256"]) for r in rows} == {n: (len(raw), sha(raw)) for n, raw in files.items()}
    # a cached digest counts where path, size and time are the same: a made-up one shows that the file isn't read again
    made_up = spark.createDataFrame([(r["path"], r["bytes"], r["modified"], "made up") for r in rows], assets.CACHE)
    again = assets.trusted_digests(assets.listed(spark, str(tmp_path)), made_up.unionByName(made_up))
    assert {r["sha256"] for r in again.collect()} == {"made up"} and again.count() == 4
    (tmp_path / "z").write_bytes(b"now more")
    changed = assets.trusted_digests(assets.listed(spark, str(tmp_path)), made_up)
    assert sorted(r["sha256"] for r in changed.collect()) == sorted(["made up"] * 3 + [sha(b"now more")])
    due = spark.createDataFrame([(r["path"], r["sha256"]) for r in rows], "path string, sha256 string")
    with pytest.raises(Exception, match="another digest than expected"):
        assets.trusted_digests(assets.listed(spark, str(tmp_path)), expected=due).collect()
    with pytest.raises(Exception, match="not there: gone"):
        assets.trusted_digests(assets.listed(spark, str(tmp_path)), expected=spark.createDataFrame([("gone", "x")], due.schema)).collect()


def test_each_content_is_stored_once(spark, tmp_path):
    files = {"a/x.PNG": b"one", "a/same.png": b"one", "b/y": b"two", "b/z.jpeg": b"three"}
    tree(tmp_path / "in", files)
    split = F.when(F.col("path").contains("/a/"), "train").otherwise("test")
    found = assets.targets(assets.trusted_digests(assets.listed(spark, str(tmp_path / "in"))), split)
    out = tmp_path / "out"
    report = {r["target"]: r["status"] for r in assets.materialise(found, str(out)).collect()}
    places = {f"images/train/{sha(b'one')[:2]}/{sha(b'one')}.png", f"images/test/{sha(b'two')[:2]}/{sha(b'two')}.img", f"images/test/{sha(b'three')[:2]}/{sha(b'three')}.jpeg"}
    assert report == dict.fromkeys(places, "written") and sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == sorted(places)
    assert {r["status"] for r in assets.materialise(found, str(out)).collect()} == {"there"}
    wrong = out / sorted(places)[0]
    wrong.write_bytes(b"xxx")
    with pytest.raises(Exception, match="another content"):
        assets.materialise(found, str(out)).collect()
    assert wrong.read_bytes() == b"xxx"
    wrong.unlink()
    assert sorted(r["status"] for r in assets.materialise(found, str(out)).collect()) == ["there", "there", "written"]
    kept = spark.createDataFrame(found.collect(), found.schema)
    (tmp_path / "in/b/y").write_bytes(b"new")
    (out / next(p for p in places if p.endswith(".img"))).unlink()
    with pytest.raises(Exception, match="changed since"):
        assets.materialise(kept, str(out)).collect()
    assert not [p for p in out.rglob("*.tmp")]
    with pytest.raises(Exception, match="several contents"):
        assets.materialise(kept.withColumn("target", F.lit("t")), str(out)).collect()
    assert assets.materialise(found.limit(0), str(out)).count() == 0


def test_walk(spark, tmp_path):
    tree(tmp_path / "r", {"b/c/d.txt": b"12", "a.txt": b"1", "b/skip/x.txt": b"", "skip/deep/y": b"", "b/c/z.log": b"", "é f/g": b"333", ".hidden/h": b""})
    os.symlink(tmp_path / "r/b", tmp_path / "r/link")
    os.symlink(tmp_path / "r/a.txt", tmp_path / "r/b/alias")
    (tmp_path / "r/empty").mkdir()
    locked = tmp_path / "r/skip/locked"
    locked.mkdir()
    got = [(r["path"], r["bytes"]) for r in assets.walk(spark, str(tmp_path / "r"), prune=("skip",), exclude=r"\.log$").collect()]
    assert got == [(".hidden/h", 0), ("a.txt", 1), ("b/c/d.txt", 2), ("é f/g", 3)]
    with pytest.raises(FileNotFoundError):
        assets.walk(spark, str(tmp_path / "none"))
    assert assets.walk(spark, str(tmp_path / "r/empty")).count() == 0
