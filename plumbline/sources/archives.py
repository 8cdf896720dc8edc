"""Tar archives as streams: an index of members by hopping from header to header, payloads read by member ranges, and checks."""

from __future__ import annotations

import hashlib
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.ranges import MOST_TASKS, files
from plumbline.sources.store import CHUNK, open_store

#: Bytes of payload that a task reads, about; a member is never divided.
SPLIT = 64 << 20
#: A cell of a row holds less than 2 GB; larger payloads are hashed, but not returned.
MOST_CONTENT = (1 << 31) - 4096


def member_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``archive, path, at, bytes``: the regular members of archives and where their payloads begin.

    Only headers are read: the reader seeks over payloads, so an archive of any size costs its number of members. A member
    that leads out of the folder it is unpacked to is an error."""
    found = files(spark, paths).select("path")
    n = found.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("path").to_pylist():
                store, at = open_store(archive)
                names, places, sizes = [], [], []
                with store.open_input_file(at) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    while (m := tar.next()) is not None:
                        tar.members = []  # else the whole index stays in memory
                        if not m.isfile():
                            continue
                        if m.name.startswith("/") or ".." in m.name.split("/"):
                            raise ValueError(f"unsafe member {m.name!r} in {archive}")
                        names.append(m.name)
                        places.append(m.offset_data)
                        sizes.append(m.size)
                        if len(names) == 20_000:
                            yield _index(archive, names, places, sizes)
                            names, places, sizes = [], [], []
                yield _index(archive, names, places, sizes)

    return found.repartition(max(1, min(n, MOST_TASKS)), "path").mapInArrow(run, "archive string, path string, at long, bytes long")


def _index(archive: str, names: list, places: list, sizes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "path", "at", "bytes"])


def members(spark: SparkSession, paths: str | list[str], payload: bool = True, split_bytes: int = SPLIT) -> DataFrame:
    """``archive, path, bytes, sha256, content`` of the regular members of archives.

    Members are dealt to tasks by where they stand, about ``split_bytes`` of an archive a task, and read in place, in chunks. ``content`` is null without
    ``payload``, and for members that no cell can hold."""
    index = member_index(spark, paths)
    part = F.floor(F.col("at") / split_bytes)
    total = files(spark, paths).agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    dealt = index.withColumn("part", part).repartition(int(max(1, min(total, MOST_TASKS))), "archive", "part").sortWithinPartitions("archive", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for archive, path, at, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "path", "at", "bytes"))):
                if archive != name:
                    if file is not None:
                        file.close()
                    store, place = open_store(archive)
                    name, file = archive, store.open_input_file(place)
                file.seek(at)
                digest, kept, left = hashlib.sha256(), [] if payload and size <= MOST_CONTENT else None, size
                while left:
                    data = file.read(min(CHUNK, left))
                    if not data:
                        raise ValueError(f"{archive} ends within {path!r}")
                    digest.update(data)
                    left -= len(data)
                    if kept is not None:
                        kept.append(data)
                content = pa.array([None if kept is None else b"".join(kept)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([path]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()]), content], names=["archive", "path", "bytes", "sha256", "content"])
        if file is not None:
            file.close()

    return dealt.mapInArrow(run, "archive string, path string, bytes long, sha256 string, content binary")


def check_members(inventory: DataFrame, found: DataFrame) -> DataFrame:
    """Inventory rows and members that don't match exactly once: ``path, status``."""
    have = found.groupBy("path").agg(F.count("*").alias("n"), F.max("bytes").alias("got_bytes"), F.max("sha256").alias("got_sha"))
    joined = inventory.select("path", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha")).join(have, "path", "full_outer")
    status = (
        F.when(F.col("n").isNull(), "missing").when(F.col("want_sha").isNull(), "extra").when(F.col("n") > 1, "repeated").when((F.col("want_bytes") != F.col("got_bytes")) | (F.col("want_sha") != F.col("got_sha")), "differs")
    )
    return joined.select("path", status.alias("status")).filter(F.col("status").isNotNull())
