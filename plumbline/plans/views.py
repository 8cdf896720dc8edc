"""Derived tables that stand in for annotation data, in Spark and, with the same arithmetic, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as g


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, k, label, box``: a box per order line; ``k`` numbers an image's boxes."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    x, y = (F.col("l_partkey") % 97).cast("double"), (F.col("l_suppkey") % 89).cast("double")
    box = g.box(x, y, x + 8 + F.col("l_quantity") % 13, y + 8 + 2 * F.col("l_linenumber"))
    return rows.select(F.col("l_orderkey").alias("image_id"), (F.row_number().over(w) - 1).alias("k"), F.col("l_returnflag").alias("label"), box.alias("box"))


BOXES_SQL = """
b AS (
  SELECT l_orderkey AS image_id, l_returnflag AS label,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS k,
    CAST(l_partkey % 97 AS DOUBLE) AS x1, CAST(l_suppkey % 89 AS DOUBLE) AS y1,
    CAST(l_partkey % 97 AS DOUBLE) + 8 + l_quantity % 13 AS x2, CAST(l_suppkey % 89 AS DOUBLE) + 8 + 2 * l_linenumber AS y2
  FROM lineitem)"""


def crowded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``boxes``, but all lines on a few wide images."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 199).alias("image_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    w = Window.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    x, y = (F.col("l_partkey") * 31 % 211).cast("double"), (F.col("l_suppkey") * 17 % 223).cast("double")
    box = g.box(x, y, x + 8 + F.col("l_quantity") % 43, y + 8 + 7 * F.col("l_linenumber"))
    return rows.select("image_id", (F.row_number().over(w) - 1).alias("k"), F.col("l_returnflag").alias("label"), box.alias("box"))


CROWDED_SQL = """
b AS (
  SELECT l_orderkey % 199 AS image_id, l_returnflag AS label,
    row_number() OVER (PARTITION BY l_orderkey % 199 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS k,
    CAST(l_partkey * 31 % 211 AS DOUBLE) AS x1, CAST(l_suppkey * 17 % 223 AS DOUBLE) AS y1,
    CAST(l_partkey * 31 % 211 AS DOUBLE) + 8 + l_quantity % 43 AS x2, CAST(l_suppkey * 17 % 223 AS DOUBLE) + 8 + 7 * l_linenumber AS y2
  FROM lineitem)"""


def predicted(b: DataFrame) -> DataFrame:
    """Boxes moved by up to three pixels, without every fifth."""
    dx, dy = (F.col("k") % 3).cast("double"), (F.col("image_id") % 4).cast("double")
    moved = g.box(F.col("box.x1") + dx, F.col("box.y1") + dy, F.col("box.x2") + dx, F.col("box.y2") + dy)
    return b.filter((F.col("image_id") + F.col("k")) % 5 != 0).withColumn("box", moved)


PREDICTED_SQL = """
p AS (
  SELECT image_id, label, k, x1 + k % 3 AS x1, y1 + image_id % 4 AS y1, x2 + k % 3 AS x2, y2 + image_id % 4 AS y2
  FROM b WHERE (image_id + k) % 5 <> 0)"""


def grouped(b: DataFrame, by: list[str]) -> DataFrame:
    """Targets in order and predictions in falling ``k`` of each group, made by one aggregation. The predictions' labels are the
    same classes in another spelling."""
    items = F.sort_array(F.collect_list(F.struct("k", "image_id", "label", "box")))
    dx, dy = lambda r: (r["k"] % 3).cast("double"), lambda r: (r["image_id"] % 4).cast("double")
    moved = lambda r: F.struct(r["k"].alias("k"), F.concat(F.lit("_"), F.lower(r["label"]), F.lit(" ")).alias("label"), g.box(r["box"]["x1"] + dx(r), r["box"]["y1"] + dy(r), r["box"]["x2"] + dx(r), r["box"]["y2"] + dy(r)).alias("box"))
    made = b.groupBy(*by).agg(items.alias("targets"))
    kept = F.filter("targets", lambda r: (r["image_id"] + r["k"]) % 5 != 0)
    return made.withColumn("predictions", F.reverse(F.transform(kept, moved)))


def iou_sql(a: str, b: str) -> str:
    """The SQL of the overlap of two boxes with columns (or struct fields) x1, y1, x2, y2."""
    inter = f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda v: f"greatest(0.0, {v}.x2 - {v}.x1) * greatest(0.0, {v}.y2 - {v}.y1)"
    union = f"({area(a)} + {area(b)} - {inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0 END)"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record_id, reference, point, target, image, width, height``: addresses of all kinds from order lines."""
    b = boxes(spark, sf_dir)
    cx, cy = (F.col("image_id") * 37 + F.col("k") * 101) % 1001, (F.col("image_id") * 53 + F.col("k") * 211) % 1001
    half = (F.col("image_id") * 7 + F.col("k") * 29) % 90 + 1
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(1000), v)).cast("int")
    target = F.struct(clip(cx - half).alias("x1"), clip(cy - half).alias("y1"), clip(cx + half).alias("x2"), clip(cy + half).alias("y2"))
    return b.select(
        F.concat_ws("-", F.col("image_id").cast("string"), F.col("k").cast("string")).alias("record_id"), F.concat(F.lit("class "), F.col("label")).alias("reference"),
        F.struct(cx.cast("int").alias("x"), cy.cast("int").alias("y")).alias("point"), F.when((F.col("image_id") + F.col("k")) % 7 != 0, target).alias("target"),
        F.concat(F.lit("images/"), F.col("image_id").cast("string"), F.lit(".png")).alias("image"), F.lit(1024).alias("width"), F.lit(768).alias("height"),
    )


ADDRESSES_SQL = (
    BOXES_SQL
    + """,
a0 AS (
  SELECT image_id, k, label, CAST((image_id * 37 + k * 101) % 1001 AS INT) AS px, CAST((image_id * 53 + k * 211) % 1001 AS INT) AS py,
    CAST((image_id * 7 + k * 29) % 90 + 1 AS INT) AS half, (image_id + k) % 7 <> 0 AS pos FROM b),
a AS (
  SELECT concat(image_id, '-', k) AS record_id, 'class ' || label AS reference, px, py, pos,
    greatest(0, least(1000, px - half)) AS tx1, greatest(0, least(1000, py - half)) AS ty1,
    greatest(0, least(1000, px + half)) AS tx2, greatest(0, least(1000, py + half)) AS ty2, 1024 AS w, 768 AS h FROM a0)"""
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_custkey, answer``: token text from customers, with centres, repeats, unlabelled boxes and odd spacing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = lambda m, s: ((F.col("c_custkey") * m + s) % 1100).cast("string")
    label = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("_Zone "))
    return c.select(
        "c_custkey",
        F.concat(
            F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("<box><1><2></box>"))).otherwise(F.lit("")),
            F.lit("<ref>"), label, F.lit("</ref><box><"), n(7, 3), F.lit("><"), n(11, 5), F.lit("></box>"),
            F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<box><"), n(7, 3), F.lit("><"), n(11, 5), F.lit("></box>"))).otherwise(F.lit("")),
            F.lit("<REF>Nation "), F.col("c_nationkey").cast("string"), F.lit("</REF> <box> <"), n(3, 10), F.lit("> <"), n(5, 20), F.lit("> <"), n(13, 400), F.lit("> <"), n(17, 500), F.lit("> </box> tail"),
        ).alias("answer"),
    )


ANSWERS_SQL = """
ans AS (
  SELECT c_custkey, c_nationkey, concat(CASE WHEN c_custkey % 5 = 0 THEN '<box><1><2></box>' ELSE '' END,
    '<ref> ', lower(c_mktsegment), '_Zone </ref><box><', (c_custkey * 7 + 3) % 1100, '><', (c_custkey * 11 + 5) % 1100, '></box>',
    CASE WHEN c_custkey % 3 = 0 THEN concat('<box><', (c_custkey * 7 + 3) % 1100, '><', (c_custkey * 11 + 5) % 1100, '></box>') ELSE '' END,
    '<REF>Nation ', c_nationkey, '</REF> <box> <', (c_custkey * 3 + 10) % 1100, '> <', (c_custkey * 5 + 20) % 1100, '> <',
    (c_custkey * 13 + 400) % 1100, '> <', (c_custkey * 17 + 500) % 1100, '> </box> tail') AS answer
  FROM customer)"""
