"""Queries of release reports, rankings and evaluation cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import reports
from plumbline.plans.views import BOXES_SQL, PREDICTED_SQL, boxes, predicted, table


def release_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return reports.histograms(o, {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "decade": (F.col("o_custkey") % 10)})


HISTOGRAMS_SQL = """
SELECT 'status' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'decade', (o_custkey % 10)::VARCHAR, count(*) FROM orders GROUP BY 2"""


def replay_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return reports.shares(li, F.when(F.col("l_partkey") % 7 != 0, F.col("l_returnflag") == "R"), F.col("l_linenumber") == 1, ["l_linestatus"])


SHARES_SQL = """
WITH r AS (SELECT l_linestatus, coalesce(CASE WHEN l_partkey % 7 <> 0 THEN l_returnflag = 'R' END, false) AS replay, l_linenumber = 1 AS q FROM lineitem),
c AS (SELECT l_linestatus, count(*) FILTER (replay) AS replay_records, count(*) FILTER (NOT replay) AS dense_records,
  count(*) FILTER (replay AND q) AS replay_queries, count(*) FILTER (NOT replay AND q) AS dense_queries FROM r GROUP BY 1)
SELECT *, replay_records / nullif(replay_records + dense_records, 0) AS record_share, replay_queries / nullif(replay_queries + dense_queries, 0) AS query_share FROM c"""


def declared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines differ in number from what a manifest declares, which is wrong for every 50th and lacks every 70th."""
    observed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n"))
    declared = observed.filter("key % 70 <> 0").select("key", (F.col("n") + F.when(F.col("key") % 50 == 0, 1).otherwise(0)).alias("n"))
    return reports.accounting(observed, declared, "key", "n")


DECLARED_SQL = """
WITH o AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1)
SELECT key, n AS observed, CASE WHEN key % 70 = 0 THEN 0 ELSE n + 1 END AS declared FROM o WHERE key % 70 = 0 OR key % 50 = 0"""


def class_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.class_presence(boxes(spark, sf_dir), "label", ["A", "N", "Z"], ["R", "Y"])


CLASSES_SQL = """
WITH l(label, rule) AS (VALUES ('A', 'required'), ('N', 'required'), ('Z', 'required'), ('R', 'forbidden'), ('Y', 'forbidden'))
SELECT label, rule, count(l_returnflag) AS n, CASE WHEN rule = 'required' THEN count(l_returnflag) = 0 ELSE count(l_returnflag) > 0 END AS violation
FROM l LEFT JOIN lineitem ON l_returnflag = label GROUP BY label, rule"""


def rank_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers as metrics, so that sums are exact in any order."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("loss"), F.when(F.col("l_linenumber") != 2, F.col("l_partkey").cast("double")).alias("hits"))
    return reports.means_across_ranks(li, ["loss", "hits"])


MEANS_SQL = """
SELECT sum(l_quantity::DOUBLE) / count(*) AS loss, sum(CASE WHEN l_linenumber <> 2 THEN l_partkey::DOUBLE ELSE 0 END) / count(*) AS hits, count(*) AS n FROM lineitem"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    said = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), F.concat("text", F.lit(" <BOX>none</box>"))).otherwise(F.col("text"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", said.alias("text")))), lambda x: x["text"])
    spoken = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", said.alias("text"))))), lambda x: x["text"])
    rows = c.groupBy("conv_id").agg(turns.alias("turns"), spoken.alias("assistant"), F.count("*").alias("target_count"))
    size = F.when(F.col("conv_id") % 3 != 0, F.array(F.col("conv_id") % 640, F.col("conv_id") % 480)).otherwise(F.array(F.col("conv_id")))
    images = F.when(F.col("conv_id") % 4 != 0, F.sequence(F.lit(1), (F.col("conv_id") % 4).cast("int")))
    features = reports.score_features(F.col("turns"), F.col("assistant"), F.col("target_count"), size, images)
    return rows.select(F.concat(F.lit("src"), (F.col("conv_id") % 7).cast("string")).alias("source"), F.col("conv_id").alias("line"), *[v.alias(k) for k, v in features.items()])


_CANDIDATES_SQL = """
c AS (SELECT *, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN text || ' <BOX>none</box>' ELSE text END AS said FROM conversations),
f AS (
  SELECT 'src' || (conv_id % 7) AS source, conv_id AS line, sum(coalesce(length(said), 0))::BIGINT AS conversation_chars, count(*) AS target_count,
    CASE WHEN conv_id % 3 <> 0 THEN (conv_id % 640) * (conv_id % 480) ELSE 0 END AS source_image_area,
    CASE WHEN conv_id % 4 <> 0 THEN conv_id % 4 ELSE 1 END AS visual_inputs,
    coalesce(max(CASE WHEN role = 'assistant' AND contains(lower(said), '<box>none</box>') THEN 1 ELSE 0 END), 0)::BIGINT AS explicit_none
  FROM c GROUP BY conv_id)"""


def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


FEATURES_SQL = f"WITH {_CANDIDATES_SQL} SELECT * FROM f"


def hard_candidates_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest images that have an explicit none, then the 15 with most visual inputs among all others."""
    rows = _candidates(spark, sf_dir)
    chosen = rows.filter("explicit_none = 1").orderBy(*reports.hardness("source_image_area")).limit(10)
    more = reports.fill(rows, chosen, ["source", "line"], reports.hardness("visual_inputs"), 15)
    return chosen.withColumn("why", F.lit("none")).unionByName(more.withColumn("why", F.lit("fill"))).select("source", "line", "why")


_THEN = "conversation_chars DESC, target_count DESC, source, line"
FILL_SQL = f"""
WITH {_CANDIDATES_SQL}, x AS (SELECT * FROM f WHERE explicit_none = 1 ORDER BY source_image_area DESC, {_THEN} LIMIT 10),
y AS (SELECT * FROM f WHERE (source, line) NOT IN (SELECT (source, line) FROM x) ORDER BY visual_inputs DESC, {_THEN} LIMIT 15)
SELECT source, line, 'none' AS why FROM x UNION ALL SELECT source, line, 'fill' FROM y"""


def allowed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of an image whose class the image asks for, and the first of them, which a single-object protocol scores."""
    items = F.sort_array(F.collect_list(F.struct("k", "label")))
    made = predicted(boxes(spark, sf_dir)).groupBy("image_id").agg(items.alias("points"))
    classes = F.when(F.col("image_id") % 2 == 0, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array(F.lit("R")))
    kept = made.select("image_id", reports.allowed(F.col("points"), classes).alias("points"))
    return kept.select("image_id", F.size("points").cast("long").alias("n"), reports.first_valid(F.col("points"))["k"].cast("long").alias("first_k"))


ALLOWED_SQL = f"""
WITH {BOXES_SQL}, {PREDICTED_SQL}, m AS (SELECT image_id, k, CASE WHEN image_id % 2 = 0 THEN label IN ('A', 'N') ELSE label = 'R' END AS ok FROM p)
SELECT image_id, count(*) FILTER (ok) AS n, min(k) FILTER (ok) AS first_k FROM m GROUP BY image_id"""


def recipe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part once, where the orders, as groups of paths, first name it."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return reports.ordered_distinct(li, "l_partkey", ["l_orderkey", "l_linenumber"])


PATHS_SQL = """
SELECT l_partkey, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1"""


def prompt_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders and box-only answers of prompts and answers made from conversations."""
    c = table(spark, sf_dir, "conversations")
    prompt = F.concat(F.repeat(F.lit("<image>"), (F.col("conv_id") % 4).cast("int")), F.col("text"))
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<box>"), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<box><ref>"), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", reports.placeholders(prompt).alias("images"), reports.box_only(answer).alias("box_only"))


SHAPES_SQL = """
SELECT conv_id, turn, CASE WHEN text IS NULL THEN 0 ELSE conv_id % 4 + (length(text) - length(replace(text, '<image>', ''))) // 7 END AS images,
  coalesce(turn % 3 = 0 AND NOT contains(text, '<ref>') OR turn % 3 = 2 AND starts_with(text, '<box>') AND NOT contains(text, '<ref>'), false) AS box_only FROM conversations"""


def addressed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests in names of files of three kinds: named by a digest, by one with more behind it, by none."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("h", F.lit(".png"))).when(F.col("doc_id") % 3 == 1, F.concat("h", F.lit("0.png"))).otherwise(F.concat(F.lit("x-"), "h"))
    return d.select("doc_id", reports.path_digest(F.concat(F.lit("images/"), name)).alias("digest"))


ADDRESSED_SQL = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(doc_id::VARCHAR) END AS digest FROM documents"


def grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest orders of each status and priority, in the grid's order: all 15 cells."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    dimensions = {"o_orderstatus": ["O", "F", "P"], "o_orderpriority": ["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH", "4-NOT SPECIFIED"]}
    top = reports.grid_rankings(o, dimensions, [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)
    return top.select("cell", F.col("place").cast("long").alias("place"), "o_orderkey")


GRID_SQL = """
WITH s(s, i) AS (VALUES ('O', 0), ('F', 1), ('P', 2)), p(p, j) AS (VALUES ('5-LOW', 0), ('1-URGENT', 1), ('3-MEDIUM', 2), ('2-HIGH', 3), ('4-NOT SPECIFIED', 4)),
r AS (SELECT CAST(i * 5 + j AS BIGINT) AS cell, row_number() OVER (PARTITION BY i, j ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey FROM orders JOIN s ON o_orderstatus = s JOIN p ON o_orderpriority = p)
SELECT cell, place, o_orderkey FROM r WHERE place <= 5"""


def zipped_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order against its output by place; every 11th order lacks its last output, every 13th has one too many."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    w = Window.partitionBy("key")
    placed = li.withColumn("pos", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")).withColumn("last", F.count("*").over(w))
    outputs = placed.filter("key % 11 <> 0 or pos < last").select("key", F.explode(F.when((F.col("key") % 13 == 0) & (F.col("pos") == F.col("last")), F.array("pos", F.col("pos") + 1)).otherwise(F.array("pos"))).alias("pos"), F.col("l_suppkey").alias("output"))
    return reports.zipped(placed.select("key", "pos", F.col("l_partkey").alias("address")), outputs, "key", "pos")


ZIPPED_SQL = """
WITH o AS (
  SELECT l_orderkey AS key, l_partkey AS address, l_suppkey AS output, count(*) OVER (PARTITION BY l_orderkey) AS n,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem)
SELECT key, pos, address, CASE WHEN key % 11 <> 0 OR pos < n THEN output END AS output, key % 11 <> 0 OR pos < n AS paired FROM o
UNION ALL SELECT key, n + 1, NULL, output, false FROM o WHERE pos = n AND key % 13 = 0 AND key % 11 <> 0"""


def benchmark_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return reports.roll_up({"lines": li.agg(F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("most")), "orders": o.agg(F.count("*").alias("n"))})


ROLL_UP_SQL = """
SELECT 'lines' AS benchmark, count(*) AS n, max(l_linenumber)::BIGINT AS most FROM lineitem UNION ALL SELECT 'orders', count(*), NULL FROM orders"""


QUERIES = {f.__name__: f for f in (release_histograms, replay_shares, declared_counts, class_contract, rank_means, candidate_features, hard_candidates_fill, allowed_points, recipe_paths, prompt_shapes, addressed_paths, grid_order, zipped_outputs, benchmark_roll_up)}
ORACLES = {
    "release_histograms": HISTOGRAMS_SQL,
    "replay_shares": SHARES_SQL,
    "declared_counts": DECLARED_SQL,
    "class_contract": CLASSES_SQL,
    "rank_means": MEANS_SQL,
    "candidate_features": FEATURES_SQL,
    "hard_candidates_fill": FILL_SQL,
    "allowed_points": ALLOWED_SQL,
    "recipe_paths": PATHS_SQL,
    "prompt_shapes": SHAPES_SQL,
    "addressed_paths": ADDRESSED_SQL,
    "grid_order": GRID_SQL,
    "zipped_outputs": ZIPPED_SQL,
    "benchmark_roll_up": ROLL_UP_SQL,
}
