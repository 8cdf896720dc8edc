"""Queries over the fields of records: points and targets that manifests supply, grammars, ontologies, manifests, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions import text as t
from plumbline.operators import expand, rules
from plumbline.plans.views import BOXES_SQL, boxes, table


def patch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of patches around grid points, on grids that are smaller than the window too."""
    b = boxes(spark, sf_dir).select("image_id", F.col("k").cast("long").alias("k"), F.struct(((F.col("image_id") * 37 + F.col("k")) % 1100 - 50).cast("int").alias("x"), ((F.col("image_id") * 53) % 1001).cast("int").alias("y")).alias("p"))
    w = g.patch_window(F.col("p"), (F.col("image_id") % 40 + 3).cast("int"), (F.col("k") * 9 + 5).cast("int"), 144, 14)
    return b.select("image_id", "k", w.alias("w")).select("image_id", "k", "w.*")


_SIDE = "CAST(round_even(144 / 14.0::DOUBLE, 0) AS INT)"
PATCH_SQL = f"""
WITH {BOXES_SQL}, c AS (
  SELECT image_id, k, CAST(image_id % 40 + 3 AS INT) AS gh, CAST(k * 9 + 5 AS INT) AS gw, greatest(0, least(1000, (image_id * 37 + k) % 1100 - 50)) AS x, (image_id * 53) % 1001 AS y FROM b),
d AS (SELECT *, least({_SIDE}, gh) AS h, least({_SIDE}, gw) AS w, least(gh - 1, CAST(floor(y * gh / 1000.0::DOUBLE) AS INT)) AS py, least(gw - 1, CAST(floor(x * gw / 1000.0::DOUBLE) AS INT)) AS px FROM c)
SELECT image_id, k, greatest(0, least(gh - h, py - h // 2)) AS y, greatest(0, least(gw - w, px - w // 2)) AS x, h, w, h * 14 AS pixels_h, w * 14 AS pixels_w FROM d"""


def supplied_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a manifest in both coordinate spaces, with repeats, aliases and ids of their own."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    point = lambda label, x, y, i: F.struct(label.alias("label"), F.array(x.cast("double"), y.cast("double")).alias("point"), i.alias("point_id"))
    none = F.lit(None).cast("string")
    x, y = k % 500, k * 3 % 400
    points = F.array(point(F.lower("c_mktsegment"), x, y, none), point(F.col("c_mktsegment"), x, y, F.lit("again")), point(F.lit("Old_Name"), x + 1, y, none), point(F.lit("new  name"), y, x, F.concat(F.lit("p"), k.cast("string"))))
    space = F.when(k % 3 == 0, "normalized_0_1000").when(k % 3 == 1, "pixel").otherwise(none)
    found = c.withColumn("p", F.explode(t.supplied_points(points, F.create_map(F.lit("old name"), F.lit("New_Name")), space, F.lit(800), F.lit(600))))
    return found.select("c_custkey", "p.label", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"), "p.nx", "p.ny", "p.point_id")


SUPPLIED_SQL = """
WITH c AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, CAST(c_custkey % 500 AS DOUBLE) AS x, CAST(c_custkey * 3 % 400 AS DOUBLE) AS y FROM customer),
p AS (
  SELECT k, 0 AS i, seg AS label, x, y, NULL AS pid FROM c UNION ALL SELECT k, 1, seg, x, y, 'again' FROM c UNION ALL SELECT k, 2, 'new name', x + 1, y, NULL FROM c
  UNION ALL SELECT k, 3, 'new name', y, x, 'p' || k FROM c),
q AS (SELECT k, i, label, pid, CASE WHEN k % 3 = 0 THEN x / 1000.0::DOUBLE * 800 ELSE x END AS x, CASE WHEN k % 3 = 0 THEN y / 1000.0::DOUBLE * 600 ELSE y END AS y FROM p),
n AS (SELECT *, greatest(0, least(1000, CAST(round_even(x / 800 * 1000, 0) AS INT))) AS nx, greatest(0, least(1000, CAST(round_even(y / 600 * 1000, 0) AS INT))) AS ny FROM q)
SELECT k AS c_custkey, label, round(x, 9) AS x, round(y, 9) AS y, nx, ny, coalesce(pid, concat(label, ':', nx, ':', ny, ':', i)) AS point_id FROM n
QUALIFY row_number() OVER (PARTITION BY k, label, nx, ny ORDER BY i) = 1"""


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets as labelled pixel boxes, from both coordinate spaces."""
    b = boxes(spark, sf_dir)
    target = F.array(F.struct(F.concat(F.lit(" Class_"), F.col("label")).alias("label"), F.array("box.x1", "box.y1", "box.x2", "box.y2").alias("hbox")))
    made = t.ground_truth(target, F.create_map(F.lit("class a"), F.lit("First")), F.when(F.col("k") % 2 == 0, "normalized_0_1000").otherwise(""), F.lit(640), F.lit(480))
    found = b.withColumn("t", F.explode(made))
    return found.select("image_id", F.col("k").cast("long").alias("k"), "t.label", *[F.round(f"t.box.{n}", 9).alias(n) for n in ("x1", "y1", "x2", "y2")])


TRUTH_SQL = f"""
WITH {BOXES_SQL}
SELECT image_id, k, CASE WHEN label = 'A' THEN 'first' ELSE 'class ' || lower(label) END AS label,
  {", ".join(f"round(CASE WHEN k % 2 = 0 THEN {v} / 1000.0::DOUBLE * {e} ELSE {v} END, 9) AS {v}" for v, e in (("x1", 640), ("y1", 480), ("x2", 640), ("y2", 480)))} FROM b"""


def compact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammar of compact prompts and answers, where some break it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("label"))
    k = F.col("c_custkey")
    prompt = F.concat(F.lit("<image><image>\nLocate the single "), F.col("label"), F.lit(" containing point <box><"), (k % 1000).cast("string"), F.lit("><5></box> in horizontal box format. Return None if absent"), F.when(k % 7 == 0, "!").otherwise("."))
    answer = F.concat(F.lit("<ref>"), F.when(k % 5 == 0, "other").otherwise(F.col("label")), F.lit("</ref><box>"), F.when(k % 3 == 0, "None").when(k % 11 == 0, "<1><2><3>").otherwise("<1><2><3><4>"), F.lit("</box>"))
    broken = rules.check(c.withColumns({"prompt": prompt, "answer": answer}), rules.compact_rules(F.col("prompt"), F.col("answer")))
    return broken.select("c_custkey", F.explode("violations").alias("violation"))


COMPACT_SQL = """
WITH c AS (SELECT c_custkey AS k, c_custkey % 7 = 0 AS p, c_custkey % 3 <> 0 AND c_custkey % 11 = 0 AS a, c_custkey % 5 = 0 AS o FROM customer)
SELECT k AS c_custkey, unnest(list_filter([CASE WHEN p THEN 'prompt_grammar' END, CASE WHEN a THEN 'answer_grammar' END, CASE WHEN (p OR a OR o) AND NOT (p AND a) THEN 'labels_differ' END], lambda x: x IS NOT NULL)) AS violation FROM c"""


def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose brand and type no class of the ontology has, by class."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("label"))
    known = p.filter("p_partkey % 10 = 0").select("label")
    return rules.outside_ontology(p.filter("p_partkey % 3 = 0 or p_partkey % 10 = 0"), known).groupBy("label").agg(F.count("*").alias("n"))


UNKNOWN_SQL = """
WITH p AS (SELECT p_partkey AS k, concat(p_brand, ' ', p_type) AS label FROM part)
SELECT label, count(*) AS n FROM p WHERE (k % 3 = 0 OR k % 10 = 0) AND label NOT IN (SELECT label FROM p WHERE k % 10 = 0) GROUP BY label"""


def usable_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as arrays of numbers, some cut short, turned round, or with no number in them."""
    b = boxes(spark, sf_dir)
    k, v = F.col("image_id") + F.col("k"), F.array("box.x1", "box.y1", "box.x2", "box.y2")
    spoilt = F.when(k % 9 == 0, F.slice(v, 1, 3)).when(k % 9 == 1, F.array("box.x2", "box.y1", "box.x1", "box.y2")).when(k % 9 == 2, F.array(F.col("box.x1"), F.col("box.y1"), F.lit(float("nan")), F.col("box.y2")))
    spoilt = spoilt.when(k % 9 == 3, F.array(F.col("box.x1"), F.col("box.y1"), F.lit(None).cast("double"), F.col("box.y2"))).when(k % 9 == 4, F.array(F.col("box.x1"), F.col("box.y1"), F.lit(float("inf")), F.col("box.y2"))).when(k % 9 == 5, F.lit(None).cast("array<double>")).otherwise(v)
    return b.groupBy("label", g.valid_box(spoilt).alias("valid")).agg(F.count("*").alias("n"))


USABLE_SQL = f"WITH {BOXES_SQL} SELECT label, (image_id + k) % 9 > 5 AS valid, count(*) AS n FROM b GROUP BY ALL"


def reentry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of second-round records, each broken by some."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    box = lambda a, b, c, d: F.lit(f"<box><{a}><{b}><{c}><{d}></box>")
    local = k % 2 == 0
    answer = F.when(k % 17 == 1, F.lit("<box>None</box>")).when(k % 17 == 2, F.concat(box(1, 1, 9, 9), box(1, 1, 9, 9))).when(k % 17 == 3, box(400, 400, 1001, 600)).when(k % 17 == 4, box(600, 400, 500, 600))
    answer = answer.when(k % 17 == 5, F.concat(F.lit("<ref>x</ref>"), box(400, 400, 600, 600))).when(k % 17 == 6, box(501, 400, 600, 600)).otherwise(box(400, 400, 600, 600))
    point = F.array(F.lit(500), F.lit(500))
    item = lambda virtual: F.struct(F.lit("a.png").alias("path"), F.lit(virtual).alias("virtual_crop"))
    meta = F.struct(
        F.lit("reentry").alias("route"), F.when(k % 17 == 7, "sideways").when(local, "local_first").otherwise("global_fallback").alias("round2_route"), F.lit("hbb").alias("geometry_mode"), F.when(k % 17 == 8, 0).otherwise(1).alias("target_count"),
        F.when(~local, point).alias("global_point"), F.when(local, point).alias("local_point"), (k % 17 != 9).alias("fully_contained"),
    )
    images = F.when(local & (k % 17 != 10), F.array(item(False), item(True))).when(k % 17 == 11, F.array(item(False), item(False))).otherwise(F.array(item(False)))
    made = o.select("o_orderkey", answer.alias("answer"), meta.alias("meta"), images.alias("images"))
    found = rules.record_rules(F.col("answer"), F.col("meta"), F.col("images"), F.size("images") > 1)
    return rules.check(made, found).select("o_orderkey", F.explode("violations").alias("violation"))


REENTRY_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 17 AS m, o_orderkey % 2 = 0 AS l FROM orders),
f AS (
  SELECT k, unnest(list_filter([
    CASE WHEN m = 2 THEN 'needs_one_box_or_none' END, CASE WHEN m = 3 THEN 'box_outside_grid' END, CASE WHEN m = 4 THEN 'degenerate_box' END,
    CASE WHEN m IN (4, 6) OR m = 2 THEN 'address_outside_target' END, CASE WHEN m IN (1, 2, 8) THEN 'target_count_mismatch' END, CASE WHEN m = 7 THEN 'unknown_round2_route' END,
    CASE WHEN l AND m = 10 THEN 'local_needs_image_and_crop' END, CASE WHEN NOT l AND m = 11 THEN 'fallback_needs_one_image' END,
    CASE WHEN m = 5 THEN 'reentry_with_reference' END, CASE WHEN l AND m = 9 THEN 'local_box_not_contained' END], lambda x: x IS NOT NULL)) AS violation, m, l FROM o)
SELECT k AS o_orderkey, violation FROM f WHERE NOT (violation = 'address_outside_target' AND m = 7)"""


def detection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows of a detection set, with raw names where there are any."""
    b = boxes(spark, sf_dir)
    o = F.struct("k", F.when(F.col("k") % 2 == 0, F.concat(F.lit(" "), F.col("label"))).otherwise("").alias("raw_class_name"), F.when(F.col("k") % 2 == 0, "other").otherwise(F.col("label")).alias("class_name"), F.array("box.x1", "box.y1", "box.x2", "box.y2").alias("hbox"))
    rows = b.groupBy("image_id").agg(F.sort_array(F.collect_list(o)).alias("objects")).select(F.col("image_id").cast("string").alias("image_id"), F.concat(F.lit("images/"), F.col("image_id").cast("string")).alias("image_path"), "objects")
    made = expand.detection_manifest(rows, "wharf", ["A", "N", "R"], "three")
    one = lambda x: F.concat_ws(":", x["label"], F.array_join(F.transform(x["hbox"], lambda v: v.cast("long").cast("string")), " "))
    return made.select("sample_key", "image", "class_ontology", "gt_coordinate_space", F.array_join("classes", ",").alias("classes"), F.array_join(F.transform("gt", one), ";").alias("gt"))


DETECTION_SQL = f"""
WITH {BOXES_SQL}
SELECT 'wharf:detection:' || image_id AS sample_key, 'images/' || image_id AS image, 'three' AS class_ontology, 'pixel' AS gt_coordinate_space, 'A,N,R' AS classes,
  string_agg(concat(label, ':', CAST(x1 AS BIGINT), ' ', CAST(y1 AS BIGINT), ' ', CAST(x2 AS BIGINT), ' ', CAST(y2 AS BIGINT)), ';' ORDER BY k) AS gt FROM b GROUP BY image_id"""


def strict_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows with mandatory raw labels, and the listing that has their images."""
    b = boxes(spark, sf_dir).withColumns({"image_id": F.col("image_id").cast("string"), "o": F.struct("k", F.concat(F.col("label"), F.lit(" ")).alias("raw_class_name"), F.array("box.x1", "box.y1", "box.x2", "box.y2").alias("hbox"))})
    rows = b.groupBy("image_id").agg(F.sort_array(F.collect_list("o")).alias("objects")).withColumn("image_path", F.concat(F.lit("images/"), F.col("image_id")))
    made = expand.strict_manifest(rows, "wharf-100", ["A", "N", "R"], "three", {"A": "first"}, {"a": "A"}, rows.select(F.col("image_path").alias("path")))
    return made.select("sample_key", "image", "gt_label_field", F.to_json("class_prompts").alias("prompts"), F.to_json("label_aliases").alias("aliases"), F.size("gt").alias("objects"), F.array_join(F.transform("gt", lambda x: x["label"]), "").alias("labels"))


STRICT_SQL = f"""
WITH {BOXES_SQL}
SELECT concat('wharf-100:', image_id) AS sample_key, concat('images/', image_id) AS image, 'raw_class_name' AS gt_label_field, '{{"A":"first"}}' AS prompts, '{{"a":"A"}}' AS aliases, CAST(count(*) AS INT) AS objects,
  string_agg(label, '' ORDER BY k) AS labels FROM b GROUP BY image_id"""


def first_existing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's file from an ordered list of candidates, against a listing that lacks many."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    name = lambda top: F.concat(F.lit(f"{top}/"), F.col("o_orderkey").cast("string"))
    files = o.filter("o_orderkey % 3 = 0").select(name("raw").alias("path")).union(o.filter("o_orderkey % 4 = 0").select(name("cache"))).union(o.filter("o_orderkey % 5 = 0").select(name("raw")))
    return expand.first_existing(o, "o_orderkey", F.array(name("cache"), F.lit(None).cast("string"), name("raw"), name("raw"), name("none")), files)


EXISTING_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'cache/' || o_orderkey WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'raw/' || o_orderkey END AS path FROM orders"""


def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three orders of each customer: what the first-N policy takes."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return expand.first_n(o, ["o_custkey"], [F.col("o_orderkey")], 3)


FIRST_SQL = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3"


QUERIES = {
    f.__name__: f
    for f in (patch_windows, supplied_points, ground_truth, compact_violations, unknown_labels, usable_boxes, reentry_violations, detection_manifest, strict_manifest, first_existing_paths, first_of_each)
}
ORACLES = {
    "patch_windows": PATCH_SQL, "supplied_points": SUPPLIED_SQL, "ground_truth": TRUTH_SQL, "compact_violations": COMPACT_SQL, "unknown_labels": UNKNOWN_SQL, "usable_boxes": USABLE_SQL,
    "reentry_violations": REENTRY_SQL, "detection_manifest": DETECTION_SQL, "strict_manifest": STRICT_SQL, "first_existing_paths": EXISTING_SQL, "first_of_each": FIRST_SQL,
}
