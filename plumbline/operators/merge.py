"""Merging shards by key over bucketed tables: each side is bucketed once, and coverage, duplicates and the merge need no further shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.workspace import fresh_path


def bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """``rows`` as a table of ``buckets`` by ``key``, sorted within them, in the shared folder. Tables with the same number of buckets join by ``key`` as they
    stand. A bucket should fit a task: rows over buckets."""
    spark, name = rows.sparkSession, f"plumbline_{uuid.uuid4().hex}"
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", fresh_path(spark, "buckets")).saveAsTable(name)
    return spark.table(name)


def checked_merge(outputs: DataFrame, records: DataFrame, key: str, shard: str = "shard") -> DataFrame:
    """``key, status, shards, row``: the outputs of all shards against the records that were to be run, both bucketed by ``key``.

    ``status``: ``ok``, ``missing`` (no output), ``extra`` (no record) or ``repeated`` (several outputs, or several records); ``shards`` are those with an output, sorted; ``row`` is the output
    of ``ok`` keys. Rows of a key are adjacent in a bucket, so aggregation and join read the buckets alone. A null key is ``extra`` or ``missing``."""
    payload = F.struct(*[c for c in outputs.columns if c != key])
    per_key = outputs.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(shard)).alias("shards"), F.first(payload).alias("row"))
    due = records.groupBy(F.col(key).alias("_due")).agg(F.count("*").alias("due"))
    both = per_key.join(due, F.col(key) == F.col("_due"), "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "extra").when((F.col("n") > 1) | (F.col("due") > 1), "repeated").otherwise("ok")
    return both.select(F.coalesce(F.col(key), F.col("_due")).alias(key), status.alias("status"), F.coalesce("shards", F.array().cast("array<string>")).alias("shards"), F.when(status == "ok", F.col("row")).alias("row"))


def merged(outputs: DataFrame, records: DataFrame, key: str, shard: str = "shard", show: int = 20) -> DataFrame:
    """The outputs in the order of ``key``, if every record has exactly one; else an error with the first ``show`` keys that are wrong and their shards."""
    checked = checked_merge(outputs, records, key, shard)
    wrong = checked.filter("status <> 'ok'").select(key, "status", "shards").orderBy(key).limit(show).collect()
    if wrong:
        raise ValueError(f"shards don't merge: {[r.asDict() for r in wrong]}")
    return checked.select(key, "row.*").select(*outputs.columns).orderBy(key)
