"""Nulls, empties and odd values in release reports and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import reports


def test_features_of_empty_records(spark):
    rows = spark.createDataFrame([(None, None, None, None, None), (["ab", None], ["<BOX>None</box>"], 3, [4, 5], []), ([], [], 0, [1, 2, 3], ["a", "b"])], "t array<string>, a array<string>, n int, s array<int>, i array<string>")
    c = F.col
    found = rows.select(*[v.alias(k) for k, v in reports.score_features(c("t"), c("a"), c("n"), c("s"), c("i")).items()]).collect()
    assert [tuple(r) for r in found] == [(0, 0, 0, 1, 0), (2, 3, 20, 0, 1), (0, 0, 0, 2, 0)]


def test_text_checks(spark):
    digest = "0123456789abcdef" * 4
    rows = spark.createDataFrame([(None,), ("<box>1",), ("<box><ref>",), ("x<box>",), (f"a/{digest}.png",), (digest,), (f"a/{digest.upper()}.png",), (f"{digest}/x.png",)], "s string")
    found = rows.select(reports.box_only(F.col("s")), reports.path_digest(F.col("s")), reports.placeholders(F.concat("s", F.lit("<image> <image>")))).collect()
    assert [r[0] for r in found][:4] == [False, True, False, False]
    assert [r[1] for r in found] == [None] * 4 + [digest, digest, None, None]
    assert [r[2] for r in found] == [0] + [2] * 7


def test_shares_and_presence_of_nothing(spark):
    rows = spark.createDataFrame([("a", None, True), ("a", True, None)], "g string, p boolean, q boolean")
    (r,) = reports.shares(rows, F.col("p"), F.col("q"), ["g"]).collect()
    assert (r.replay_records, r.dense_records, r.record_share, r.query_share) == (1, 1, 0.5, 0.0)
    assert reports.shares(rows.filter("q is null"), F.col("p"), F.col("q"), ["g"]).first().query_share is None
    labels = spark.createDataFrame([(None,), ("x",)], "label string")
    found = {r.label: (r.n, r.violation) for r in reports.class_presence(labels, "label", ["x", "y"], ["z"]).collect()}
    assert found == {"x": (1, False), "y": (0, True), "z": (0, False)}


def test_accounting_and_fill(spark):
    a = spark.createDataFrame([("p", 2), ("q", 1)], "k string, n long")
    b = spark.createDataFrame([("p", 2), ("r", 4)], "k string, n long")
    assert sorted(map(tuple, reports.accounting(a, b, "k", "n").collect())) == [("q", 1, 0), ("r", 0, 4)]
    assert [r.k for r in reports.fill(a, a.filter("k = 'p'"), ["k"], [F.asc("k")], 5).collect()] == ["q"]
    assert reports.roll_up({"y": a.select("n").limit(1), "x": b.select("k").limit(1)}).count() == 2
