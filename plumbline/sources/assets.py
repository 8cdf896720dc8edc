"""Files by their contents: digests taken in parallel, a cache of digests, and a sink that stores each content once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import content_path, suffix
from plumbline.sources.ranges import MOST_TASKS
from plumbline.sources.store import CHUNK, open_store, sha256_of

CACHE = "path string, bytes long, modified timestamp, sha256 string"


def listed(spark: SparkSession, root: str, **how) -> DataFrame:
    """``path, bytes, modified`` of the files below ``root``, empty ones too, without reading them; ``how`` as in ``walk``."""
    return walk(spark, root, **how).withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")))


def _dealt(files: DataFrame, by: str) -> DataFrame:
    """A task for each few files, whatever the size of their rows."""
    return files.repartition(max(1, min(files.count(), MOST_TASKS)), by)


def digests(files: DataFrame) -> DataFrame:
    """``path, bytes, modified, sha256``: every file is read once, in chunks, so its size doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
                digest, read = sha256_of(*open_store(path))
                if read != size:
                    raise ValueError(f"{path} has {read} bytes, {size} were listed")
                found.append(digest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])

    return _dealt(files.select("path", "bytes", "modified"), "path").mapInArrow(run, CACHE)


def trusted_digests(files: DataFrame, cache: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """``path, bytes, modified, sha256``: digests from ``cache`` (rows as these) where path, size and time are the same, and new ones of the other
    files. ``expected`` (``path, sha256``): another digest is an error, and so is an expected file that isn't there."""
    cache = cache if cache is not None else files.sparkSession.createDataFrame([], CACHE)
    keys = ["path", "bytes", "modified"]
    kept = cache.select(*keys, "sha256").dropDuplicates(keys)
    known = files.select(*keys).join(kept, keys)
    every = known.unionByName(digests(files.select(*keys).join(kept, keys, "left_anti")))
    if expected is None:
        return every
    due = expected.select(F.col("path").alias("_path"), F.col("sha256").alias("_due"))
    both = every.join(due, F.col("path") == F.col("_path"), "full_outer")
    wrong = F.when(F.col("path").isNull(), F.concat(F.lit("not there: "), F.col("_path"))).when(F.col("_due") != F.col("sha256"), F.concat(F.lit("another digest than expected: "), F.col("path")))
    return both.select(F.when(wrong.isNull(), F.col("path")).otherwise(F.raise_error(wrong)).alias("path"), "bytes", "modified", "sha256")


def targets(files: DataFrame, split: Column, top: str = "images") -> DataFrame:
    """Add ``target``: the place of each file by its content, ``top/split/<first two digits>/<digest><suffix>``. Files with equal contents in a split get one
    place, with the first path's suffix."""
    named = files.withColumn("_split", split)
    first = named.groupBy("_split", "sha256").agg(F.min("path").alias("_first")).withColumnsRenamed({"_split": "_s", "sha256": "_d"})
    joined = named.join(first, (F.col("_split") == F.col("_s")) & (F.col("sha256") == F.col("_d")))
    return joined.withColumn("target", content_path(F.col("_split"), F.col("sha256"), suffix(F.col("_first")), top)).drop("_split", "_s", "_d", "_first")


def materialise(files: DataFrame, root: str) -> DataFrame:
    """Store the contents of ``files`` (``path, bytes, sha256, target``) below ``root``, each target once; ``target, sha256, bytes, status`` (``written`` or
    ``there``).

    A target that is there is read: with the right content it stays, with another it is an error and is left as it is. A copy is written beside its place, with the digest
    taken from what is written, and moved there; a task that is repeated finds it there. A source that changed since it was listed is an error. Run it with
    an action; the rows are the report."""
    one = files.groupBy("target").agg(F.min(F.struct("path", "bytes", "sha256")).alias("f"), F.count_distinct("sha256").alias("n"))
    clash = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several contents for "), F.col("target"))).cast("string")).otherwise(F.col("target"))
    chosen = one.select(clash.alias("target"), "f.*")
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("target", "path", "bytes", "sha256"))))
            status = [_store(f"{base}/{target}", path, size, digest) for target, path, size, digest in rows]
            columns = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (3, pa.string()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(status, pa.string())], names=["target", "sha256", "bytes", "status"])

    return _dealt(chosen, "target").mapInArrow(run, "target string, sha256 string, bytes long, status string")


def _store(target: str, path: str, size: int, digest: str) -> str:
    import hashlib

    from pyarrow import fs

    store, at = open_store(target)
    there = store.get_file_info(at)
    if there.type == fs.FileType.File:
        if (there.size, sha256_of(store, at)[0]) != (size, digest):
            raise ValueError(f"{target} is there with another content")
        return "there"
    source, place = open_store(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    temporary, taken = f"{at}.{uuid.uuid4().hex}.tmp", hashlib.sha256()
    with source.open_input_stream(place, compression=None) as i, store.open_output_stream(temporary, compression=None) as o:
        while data := i.read(CHUNK):
            taken.update(data)
            o.write(data)
    if taken.hexdigest() != digest:
        store.delete_file(temporary)
        raise ValueError(f"{path} changed since its digest was taken")
    store.move(temporary, at)
    return "written"


def walk(spark: SparkSession, root: str, prune: tuple[str, ...] = (), exclude: str | None = None, rounds: int = 10_000) -> DataFrame:
    """``path`` (relative to ``root``), ``bytes`` and ``modified`` of the files below ``root``, sorted by path.

    One round a level: the folders of a level are listed in parallel, a folder each. Folders with a name in ``prune`` are never listed, links never
    followed or returned; ``exclude`` is a pattern of paths of files to leave out. A root that isn't there is an error. Memory holds a folder; the levels are tables."""
    from plumbline.operators.ordered import stored

    store, base = open_store(root.rstrip("/"))
    if not store.get_file_info(base).type.value == 3:
        raise FileNotFoundError(f"no folder: {root}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("path").to_pylist():
                where, at = open_store(f"{root.rstrip('/')}/{folder}" if folder else root.rstrip("/"))
                rows = []
                for x in where.get_file_info(fs.FileSelector(at)):
                    is_folder = x.type == fs.FileType.Directory
                    if is_folder and x.base_name in prune or isinstance(where, fs.LocalFileSystem) and os.path.islink(x.path):
                        continue
                    rows.append((f"{folder}/{x.base_name}" if folder else x.base_name, is_folder, None if is_folder else x.size, x.mtime))
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "folder", "bytes", "modified"])

    level, every = spark.createDataFrame([("",)], "path string"), None
    for _ in range(rounds):
        found = stored(_dealt(level, "path").mapInArrow(run, "path string, folder boolean, bytes long, modified timestamp"), "level")
        files = found.filter("not folder").select("path", "bytes", "modified")
        every = files if every is None else every.unionByName(files)
        level = found.filter("folder").select("path")
        if level.isEmpty():
            break
    if exclude:
        every = every.filter(~F.col("path").rlike(exclude))
    return every.orderBy("path")
