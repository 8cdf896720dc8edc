"""Helpers that the pipeline operators share: working folders, cuts of lineage, caches, batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, as the contracts define words: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"

#: Spark removes a query's shuffle files when the query ends, not when the driver next collects garbage, and Python workers
#: get batches of bounded bytes, whatever the rows hold.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where that is unset and Spark runs on this
    machine alone, one of our own; on a cluster an unset folder is an error."""
    set_for_us = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_for_us:
        return set_for_us.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='plumbline-')}")
    return str(spark.sparkContext.getCheckpointDir()).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def planned_with(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Queries planned inside have these settings; afterwards the session has its own again."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: later plans start there, so a lost
    executor costs a reread and never a recomputation of what came before. Hashes gain nothing from a strong ``codec``."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with planned_with(spark, WRITING):
        df.write.mode("error").option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote. Nothing that is still to run may read them."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def besides(columns: Iterable[str], *outs: str) -> list[str]:
    """The columns that stay beside new ones: a column with the name of a new one, in any case, is replaced by it."""
    return [c for c in columns if c.lower() not in {o.lower() for o in outs}]


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with so many underscores in front that none of ``columns`` has it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Recent(dict):
    """A bounded cache of ``make(key)`` in two generations: when the young one is full it becomes the old one,
    and keys still in use move over. Holds at most ``2 * limit`` entries."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about ``max_bytes`` of text, one row at least."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = np.cumsum(sizes) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
