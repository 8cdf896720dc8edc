"""Numbering of rows and comparison of labels."""

from pyspark.sql import functions as F

from plumbline.operators import matching, sampling


def test_places_are_gapless_with_further_columns(spark):
    n = 120_000
    rows = spark.range(n).select(F.xxhash64("id").alias("h"), F.col("id").alias("part"), F.lit("x").alias("at"), (F.col("id") % 7).alias("c0"))
    out = sampling.numbered(rows, ["h"])
    assert out.columns == ["h", "part", "at", "c0", "pos"]
    got = out.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()
    assert tuple(got) == (n, n, 0, n - 1)
    hashes = [r[0] for r in out.orderBy("pos").select("h").collect()]
    assert hashes == sorted(hashes)
    assert sampling.numbered(rows.limit(0), ["h"]).count() == 0


def test_labels_are_compared_in_canonical_form(spark):
    box = "named_struct('x1', 0D, 'y1', 0D, 'x2', 10D, 'y2', 10D)"
    row = spark.sql(
        f"SELECT array(named_struct('label', 'Small_Vehicle', 'box', {box}), named_struct('label', CAST(NULL AS STRING), 'box', {box})) AS t,"
        f" array(named_struct('label', ' small  vehicle', 'box', {box}, 'point', named_struct('x', 5D, 'y', 5D)), named_struct('label', CAST(NULL AS STRING), 'box', {box}, 'point', named_struct('x', 5D, 'y', 5D)),"
        f" named_struct('label', 'ship', 'box', {box}, 'point', named_struct('x', 5D, 'y', 5D))) AS p"
    )
    for counts in (matching.detection_counts, matching.pointing_counts):
        assert tuple(row.select(counts(F.col("t"), F.col("p")).alias("c")).first()["c"]) == (2, 1, 0)
