"""Merging over buckets: what is wrong is named with its shards, and nothing is shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import merge


def tables(spark, outputs, records, buckets=4):
    out = spark.createDataFrame(outputs, "sample_key string, shard string, v int")
    return merge.bucketed(out, "sample_key", buckets), merge.bucketed(spark.createDataFrame(records, "sample_key string"), "sample_key", buckets)


def test_merge_in_order(spark):
    rows = [(f"k{k:03}", f"s{k % 3}", k) for k in range(200)]
    out, due = tables(spark, list(reversed(rows)), [(r[0],) for r in rows])
    assert [tuple(r) for r in merge.merged(out, due, "sample_key").collect()] == rows
    empty, none = tables(spark, [], [])
    assert merge.merged(empty, none, "sample_key").count() == 0


def test_what_is_wrong(spark):
    rows = [("a", "s0", 1), ("a", "s1", 1), ("b", "s0", 2), ("x", "s2", 3), (None, "s2", 4), ("r", "s0", 5)]
    out, due = tables(spark, rows, [("a",), ("b",), ("c",), ("r",), ("r",)])
    got = {r["sample_key"]: (r["status"], r["shards"], r["row"] and r["row"]["v"]) for r in merge.checked_merge(out, due, "sample_key").collect()}
    assert got == {"a": ("repeated", ["s0", "s1"], None), "b": ("ok", ["s0"], 2), "c": ("missing", [], None), "x": ("extra", ["s2"], None), None: ("extra", ["s2"], None), "r": ("repeated", ["s0"], None)}
    with pytest.raises(ValueError, match="'a', 'status': 'repeated'"):
        merge.merged(out.filter("sample_key is not null"), due, "sample_key")


def test_no_exchange(spark):
    out, due = tables(spark, [(str(k), "s", k) for k in range(5000)], [(str(k),) for k in range(5000)], 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = merge.checked_merge(out, due, "sample_key")
        assert checked.filter(F.col("status") != "ok").count() == 0
        plan = checked._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
