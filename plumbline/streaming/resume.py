"""Resumable processing: a file stream whose batches add each key once, and totals rebuilt from what is stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.integrity import duplicate_keys, require_empty

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Lets the first row of each key through and remembers the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = next(rows)
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A key of the store. Rows come singly, so a second one finds the first."""
        if self.seen.exists():
            raise ValueError(f"a key was stored twice: {key}")
        self.seen.update((True,))

    def close(self) -> None:
        pass


def stored(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """What has been processed; nothing, with ``schema``, where the store doesn't exist yet."""
    try:
        rows = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
        return rows.drop("batch")
    except Exception as e:  # the store is made by the first batch
        if schema is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def check_store(rows: DataFrame, key: str) -> None:
    require_empty(duplicate_keys(rows, [key]), f"keys that were stored twice ({key})")


def first_of_batch(rows: DataFrame, key: str) -> DataFrame:
    """At most one row of a key from each Arrow batch: a key that has most rows doesn't send them all to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(key).dictionary_encode().indices.to_pylist()
            seen: set = set()
            keep = [k for k, v in enumerate(values) if not (v in seen or seen.add(v))]
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def process_stream(spark: SparkSession, source: DataFrame, process: Callable[[DataFrame], DataFrame], store: str, key: str, checkpoint: str) -> None:
    """Run all that is available of a streaming source through ``process`` and add the results to ``store``, each key once.

    The keys that went through are state, kept by key in RocksDB and the checkpoint: a batch looks up its own keys and never reads the store, so its
    cost doesn't grow with what is stored. A batch that is run again writes its own folder again. If the checkpoint is lost,
    the state starts from the keys of the store; a key that the store has twice is an error then. A null key is a key; of rows with
    the same key one counts. ``process`` gets rows with new keys only and must keep ``key``."""
    before = stored(spark, store, "`{}` {}".format(key, source.schema[key].dataType.simpleString())).select(key)
    known = None if before.isEmpty() else before.groupBy(key)
    fresh = first_of_batch(source, key).groupBy(key).transformWithState(FirstOfKey(), source.schema, "Append", "None", known)

    def batch(rows: DataFrame, number: int) -> None:
        query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")  # the checkpoint's own: a new checkpoint has another
        process(rows).write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={query}-{number}")

    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = fresh.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if own is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, own)


def certificate(rows: DataFrame, key: str, expected: int) -> dict[str, object]:
    """Whether a run is complete: as many different keys as expected, none twice."""
    n, different = rows.agg(F.count("*"), F.count_distinct(key)).first()
    return {"rows": n, "keys": different, "expected": expected, "complete": n == different == expected}
