"""Lines of text files, numbered while byte ranges of the files are read in parallel.

A file is cut into byte ranges. A line belongs to the range that has its first byte, so the lines of a range can be counted without knowing the
others; the counts, a row for each range, are summed up by file, and then each range is read again with the number of its first line. Line
ends are ``\\n`` or ``\\r\\n``; bytes are decoded only within whole lines, so neither a character nor a line end can be cut. A range that ends within a line reads on to the
line's end. Memory holds a chunk, or the longest line if that is longer.

Compressed files can't be entered in the middle: each is one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.store import CHUNK, open_store

SPLIT = 64 << 20
MOST_TASKS = 20_000
COMPRESSED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4"}


def _compression(path: str) -> str | None:
    return next((kind for end, kind in COMPRESSED.items() if path.endswith(end)), None)


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, bytes`` of files, of all files below folders, without reading them; a path that isn't there is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return found.select("path", F.col("length").alias("bytes"))


def byte_ranges(found: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """``path, bytes, first, last``: ranges ``[first, last)`` that cover each file; none for empty files."""
    plain = F.lit(True)
    for end in COMPRESSED:
        plain = plain & ~F.col("path").endswith(end)
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    ranges = found.filter("bytes > 0").select("path", "bytes", plain.alias("plain"), F.explode(F.when(plain, starts).otherwise(F.array(F.lit(0).cast("long")))).alias("first"))
    return ranges.select("path", "bytes", "first", F.when(F.col("plain"), F.least(F.col("first") + split_bytes, F.col("bytes"))).otherwise(F.col("bytes")).alias("last"))


def _dealt(ranges: DataFrame, n: int) -> DataFrame:
    """A number of tasks that is stated isn't lowered for rows that are small but stand for much work."""
    return ranges.repartition(max(1, min(n, MOST_TASKS)), "path", "first")


def count_starts(store, path: str, first: int, last: int) -> int:
    """How many lines begin in the bytes ``[first, last)`` of a plain file."""
    n, at = int(first == 0), max(0, first - 1)
    with store.open_input_file(path) as f:
        f.seek(at)
        while at < last - 1 and (data := f.read(min(CHUNK, last - 1 - at))):
            n += data.count(b"\n")
            at += len(data)
    return n


def lines_in(store, path: str, first: int, last: int, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The lines that begin in ``[first, last)``, in lists, without their ends."""
    packed = _compression(path)
    with store.open_input_stream(path, compression=packed) if packed else store.open_input_file(path) as f:
        at, inside, held = max(0, first - 1), bool(first), b""
        if not packed:
            f.seek(at)
        while True:
            data = f.read(max(chunk, len(held)))  # a line that is longer than this is met in few steps
            if not data:
                if held and not inside:
                    yield [held]
                return
            held += data
            if inside:  # of a line that began before
                end = held.find(b"\n")
                if end < 0:
                    at, held = at + len(held), b""
                    continue
                at, held, inside = at + end + 1, held[end + 1 :], False
            if not packed and at >= last:
                return
            if not packed and at + len(held) >= last and (end := held.find(b"\n", last - 1 - at)) >= 0:
                yield held[:end].split(b"\n")
                return
            end = held.rfind(b"\n")
            if end >= 0:
                yield held[:end].split(b"\n")
                at, held = at + end + 1, held[end + 1 :]


def _text(lines: list[bytes]) -> pa.Array:
    whole = pa.array([x[:-1] if x.endswith(b"\r") else x for x in lines], pa.binary())
    try:
        return whole.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8 become U+FFFD
        return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


def numbered_lines(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT) -> DataFrame:
    """``path, line_no, line``: every line of every file with its number from 1, the same for every ``split_bytes``."""
    ranges = byte_ranges(files(spark, paths), split_bytes)
    tasks = ranges.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for path, size, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = open_store(path)
                n.append(0 if _compression(path) or last == size else count_starts(store, at, first, last))  # nothing follows a last range
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n"])

    counted = _dealt(ranges, tasks).mapInArrow(count, "path string, bytes long, first long, last long, n long")
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    placed = counted.select("path", "first", "last", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last, no in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = open_store(path)
                for lines in lines_in(store, at, first, last):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), len(lines)), pa.array(range(no + 1, no + 1 + len(lines)), pa.int64()), _text(lines)], names=["path", "line_no", "line"])
                    no += len(lines)

    return _dealt(placed, tasks).mapInArrow(read, "path string, line_no long, line string")
