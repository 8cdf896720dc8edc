"""The sink with a two-phase commit, and archives as streams."""

from __future__ import annotations

import hashlib
import io
import tarfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.sources import archives, ranges, staged

ROWS = [(f"p={k % 3}/part.jsonl", k, f'{{"k": {k}, "t": "é{k}"}}') for k in range(30)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "name string, k int, json string")


def write(spark, path, rows=ROWS, **how):
    return staged.write_lines(frame(spark, rows), str(path), F.col("name"), ["k"], F.col("json"), **how)


def stored(spark, path):
    return sorted((r["path"].split("part-")[0][-4:-1], r["line_no"], r["line"]) for r in ranges.numbered_lines(spark, staged.committed(str(path))).collect())


def due(rows=ROWS):
    held = {}
    for name, k, line in sorted(rows, key=lambda r: (r[0], r[1])):
        held.setdefault(name.split("/")[0], []).append(line)
    return sorted((n, i, x) for n, lines in held.items() for i, x in enumerate(lines, 1))


def test_commit_rerun_and_replace(spark, tmp_path):
    first = write(spark, tmp_path)
    assert first["number"] == 1 and [e["rows"] for e in first["files"]] == [10, 10, 10] and stored(spark, tmp_path) == due()
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")}
    again = write(spark, tmp_path, list(reversed(ROWS)))
    assert again["files"] == first["files"] and {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")} == before
    for e in first["files"]:
        raw = (tmp_path / e["stored"]).read_bytes()
        assert (hashlib.sha256(raw).hexdigest(), len(raw)) == (e["sha256"], e["bytes"])
    # a damaged file is found by its digest and written again, the others are left
    hurt = tmp_path / first["files"][1]["stored"]
    hurt.write_bytes(hurt.read_bytes().replace(b"k", b"x"))
    write(spark, tmp_path)
    assert stored(spark, tmp_path) == due() and sum(p.stat().st_mtime_ns != before[p] for p in before) == 1
    fewer = ROWS[:7]
    write(spark, tmp_path, fewer)
    assert stored(spark, tmp_path) == due(fewer)
    assert len(list(tmp_path.rglob("part-*"))) == 6 and len(staged.vacuum(str(tmp_path))) == 3 + 3
    assert stored(spark, tmp_path) == due(fewer) and staged.vacuum(str(tmp_path)) == []
    listed = staged.inventory(spark, str(tmp_path)).collect()
    assert [r["file"] for r in listed] == sorted({r[0] for r in fewer}) and sum(r["rows"] for r in listed) == 7


def test_append(spark, tmp_path):
    write(spark, tmp_path)
    more = [("p=9/part.jsonl", 1, "x")]
    write(spark, tmp_path, more, append=True)
    write(spark, tmp_path, more, append=True)  # the same again adds nothing
    assert stored(spark, tmp_path) == due(ROWS + more)
    with pytest.raises(Exception, match="already stored with other rows"):
        write(spark, tmp_path, [("p=9/part.jsonl", 1, "y")], append=True)
    assert stored(spark, tmp_path) == due(ROWS + more)


def test_failures_leave_the_old_rows(spark, tmp_path):
    write(spark, tmp_path)
    new = frame(spark).withColumn("json", F.when(F.col("k") == 29, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        staged.write_lines(new, str(tmp_path), F.col("name"), ["k"], F.col("json"))
    assert stored(spark, tmp_path) == due()
    # a task that ends, and a driver that dies before the commit
    batch = pa.RecordBatch.from_arrays([pa.array(["p=0/part.jsonl"] * 2), pa.array(["a", "b"])], names=["file", "line"])
    writer = staged.StagedWriter({"path": str(tmp_path)}, ["file", "line"])
    done = writer.write(iter([batch]))
    assert done.files[0]["rows"] == 2 and stored(spark, tmp_path) == due()
    twice = staged.Done(writer.write(iter([batch])).files)
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([done, twice, None])
    assert stored(spark, tmp_path) == due()
    writer.commit([done, None])
    assert stored(spark, tmp_path) == [("p=0", 1, "a"), ("p=0", 2, "b")]
    with pytest.raises(ValueError, match="no name"):
        writer.write(iter([pa.RecordBatch.from_arrays([pa.array(["../x"]), pa.array(["a"])], names=["file", "line"])]))


def test_empty_and_nothing(spark, tmp_path):
    assert staged.manifest(str(tmp_path / "none")) == {"number": 0, "files": []}
    assert write(spark, tmp_path, [])["files"] == [] and staged.inventory(spark, str(tmp_path)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [("x.tar", f"d{k % 3}/m{k:03}", bytes([k]) * (k * 37)) for k in range(60)] + [("y.tar", "a" * 150 + "/" + "b" * 120, b""), ("y.tar", "é", b"2"), ("y.tar", "null", None)]
    data = spark.createDataFrame([(a, p, c if c is None else bytearray(c)) for a, p, c in rows], "archive string, path string, content binary")
    made = staged.write_archives(data, str(tmp_path / "one"))
    other = staged.write_archives(data.orderBy(F.desc("path")).repartition(7), str(tmp_path / "two"))
    assert made["files"] == other["files"] and [e["rows"] for e in made["files"]] == [60, 3]
    with tarfile.open(staged.committed(str(tmp_path / "one"))[0]) as tar:
        assert [m.name for m in tar] == sorted(p for a, p, _ in rows if a == "x.tar")
        assert {(m.uid, m.gid, m.mtime, m.mode, m.uname) for m in tar} == {(0, 0, 0, 0o644, "")}
    want = sorted((p, len(c or b""), hashlib.sha256(c or b"").hexdigest(), c or b"") for _, p, c in rows)
    for split in (5000, archives.SPLIT):
        found = archives.members(spark, staged.committed(str(tmp_path / "one")), split_bytes=split)
        assert sorted((r["path"], r["bytes"], r["sha256"], bytes(r["content"])) for r in found.collect()) == want
    assert archives.members(spark, str(tmp_path / "one"), payload=False).filter("content is not null").count() == 0
    inventory = found.select("path", "bytes", "sha256").filter("path <> 'é'")
    assert [tuple(r) for r in archives.check_members(inventory, found).collect()] == [("é", "extra")]


def test_an_archive_above_2_gb(spark, tmp_path):
    big, at = 2_300_000_000, tmp_path / "big.tar"
    with open(at, "wb") as f:
        for name, data, size in (("a", b"first", 5), ("big", b"", big), ("z", b"last", 4)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf(tarfile.USTAR_FORMAT))
            f.write(data)
            f.seek(-f.tell() % 512 + size - len(data) if name == "big" else -f.tell() % 512, io.SEEK_CUR)
            f.seek(-f.tell() % 512, io.SEEK_CUR)
        f.write(bytes(1024))
    index = {r["path"]: (r["at"], r["bytes"]) for r in archives.member_index(spark, str(at)).collect()}
    assert index["big"] == (1536, big) and index["z"][0] > big
    found = {r["path"]: r for r in archives.members(spark, str(at)).collect()}
    zeros = hashlib.sha256()
    for _ in range(big // 10_000_000):
        zeros.update(bytes(10_000_000))
    assert found["big"]["sha256"] == zeros.hexdigest() and found["big"]["content"] is None
    assert bytes(found["z"]["content"]) == b"last" and bytes(found["a"]["content"]) == b"first"
    at.unlink()


def test_unsafe_and_cut_archives(spark, tmp_path):
    for name, what in (("../x", "unsafe"), ("/x", "unsafe")):
        with tarfile.open(tmp_path / "bad.tar", "w") as tar:
            tar.addfile(tarfile.TarInfo(name))
        with pytest.raises(Exception, match=what):
            archives.members(spark, str(tmp_path / "bad.tar")).collect()
    info = tarfile.TarInfo("long")
    info.size = 5000
    Path(tmp_path / "bad.tar").write_bytes(info.tobuf() + b"x" * 100)
    with pytest.raises(Exception, match="ends within|unexpected end"):
        archives.members(spark, str(tmp_path / "bad.tar")).collect()
