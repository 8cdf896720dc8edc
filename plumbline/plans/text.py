"""Queries over labels, answers, prompts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions import text as t
from plumbline.operators import expand, rules
from plumbline.plans.views import ANSWERS_SQL, BOXES_SQL, answers, boxes, table

_TOKENS_SQL = f"""
WITH {ANSWERS_SQL},
tk AS (SELECT c_custkey, c_nationkey, unnest(list_zip(range(1, len(ts) + 1), ts)) AS z FROM (
  SELECT c_custkey, c_nationkey, regexp_extract_all(answer, '(?is)<ref>.*?</ref>|<box>\\s*<\\d+>\\s*<\\d+>(?:\\s*<\\d+>\\s*<\\d+>)?\\s*</box>') AS ts FROM ans)),
tv AS (SELECT c_custkey, c_nationkey, z[1] AS pos, z[2] AS t FROM tk),
lb AS (
  SELECT *, CASE WHEN lower(t[1:5]) = '<ref>' THEN trim(regexp_replace(replace(lower(regexp_extract(t, '(?is)<ref>(.*?)</ref>', 1)), '_', ' '), '\\s+', ' ', 'g')) END AS ref,
    list_transform(regexp_extract_all(t, '<(\\d+)>', 1), lambda x: CAST(x AS BIGINT)) AS v FROM tv),
cf AS (SELECT *, last_value(ref IGNORE NULLS) OVER (PARTITION BY c_custkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS label FROM lb)"""


def parse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).select("c_custkey", F.explode(t.parse_points(F.col("answer"), 1024, 768)).alias("p"))
    return a.select("c_custkey", "p.point_id", "p.label", "p.nx", "p.ny", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"), "p.source")


PARSE_SQL = (
    _TOKENS_SQL
    + """,
pt AS (
  SELECT c_custkey, pos, label, CASE WHEN len(v) = 2 THEN 'point' ELSE 'box_center_fallback' END AS source,
    CAST(greatest(0, least(1000, CASE WHEN len(v) = 2 THEN v[1] ELSE round_even((v[1] + v[3]) / 2, 0) END)) AS INT) AS nx,
    CAST(greatest(0, least(1000, CASE WHEN len(v) = 2 THEN v[2] ELSE round_even((v[2] + v[4]) / 2, 0) END)) AS INT) AS ny
  FROM cf WHERE ref IS NULL AND label IS NOT NULL AND label <> ''),
u AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, label, nx, ny ORDER BY pos) AS k FROM pt)
SELECT c_custkey, concat(label, ':', nx, ':', ny) AS point_id, label, nx, ny, round(nx / 1000.0::DOUBLE * 1024, 9) AS x, round(ny / 1000.0::DOUBLE * 768, 9) AS y, source FROM u WHERE k = 1"""
)


def parse_single_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("want"))
    a = answers(spark, sf_dir).join(c, F.col("c_custkey") == F.col("key"))
    b = a.select("c_custkey", t.parse_single_box(F.col("answer"), F.col("want"), 1024, 768).alias("b"))
    return b.select("c_custkey", *[F.round(f"b.{n}", 9).alias(n) for n in ("x1", "y1", "x2", "y2")])


SINGLE_SQL = (
    _TOKENS_SQL
    + """,
q AS (
  SELECT c_custkey, least(1000, v[1]) AS a, least(1000, v[2]) AS b, least(1000, v[3]) AS c, least(1000, v[4]) AS d FROM cf WHERE ref IS NULL AND len(v) = 4 AND label = concat('nation ', c_nationkey)),
s AS (SELECT c_custkey, least(a, c) AS p, least(b, d) AS q, greatest(a, c) AS r, greatest(b, d) AS s FROM q),
o AS (SELECT c_custkey, round(p / 1000.0::DOUBLE * 1024, 9) AS x1, round(q / 1000.0::DOUBLE * 768, 9) AS y1, round(r / 1000.0::DOUBLE * 1024, 9) AS x2, round(s / 1000.0::DOUBLE * 768, 9) AS y2 FROM s WHERE r > p AND s > q)
SELECT customer.c_custkey, x1, y1, x2, y2 FROM customer LEFT JOIN o USING (c_custkey)"""
)


def answer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("c_custkey", t.count_tokens(F.col("answer")).alias("n")).select("c_custkey", "n.*")


COUNTS_SQL = (
    "WITH "
    + ANSWERS_SQL
    + """
SELECT c_custkey, CAST(len(regexp_extract_all(answer, '(?is)<ref>.*?</ref>')) AS INT) AS refs, CAST(len(regexp_extract_all(answer, '(?i)<box>\\s*<\\d+>\\s*<\\d+>\\s*</box>')) AS INT) AS points,
  CAST(len(regexp_extract_all(answer, '(?i)<box>\\s*<\\d+>\\s*<\\d+>\\s*<\\d+>\\s*<\\d+>\\s*</box>')) AS INT) AS boxes, CAST(len(regexp_extract_all(answer, '(?i)<box>\\s*none\\s*</box>')) AS INT) AS nones FROM ans"""
)


def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("__x\t \n"), F.col("c_name")).alias("raw"))
    aliases = F.create_map(F.lit("Building x"), F.lit("House_1"), F.lit("none"), F.lit("other"))
    short = F.regexp_extract("raw", r"(?s)^\s*(\S+?__x)", 1)
    return c.select("c_custkey", t.canonical_label(F.col("raw")).alias("label"), t.row_label(short, aliases).alias("aliased"))


LABELS_SQL = """
SELECT c_custkey, trim(regexp_replace(replace(lower(concat('  ', c_mktsegment, '__x', chr(9), ' ', chr(10), c_name)), '_', ' '), '\\s+', ' ', 'g')) AS label,
  CASE WHEN lower(c_mktsegment) = 'building' THEN 'house 1' ELSE lower(c_mktsegment) || ' x' END AS aliased FROM customer"""


def prompts_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    p = g.point_to_grid(g.point((F.col("c_custkey") % 500).cast("double"), (F.col("c_nationkey") * 7).cast("double")), F.lit(500), F.lit(200))
    r = F.lower("c_mktsegment")
    return c.select(
        "c_custkey", *[t.prompt(k, r, p).alias(k) for k in t.PROMPTS], t.discovery_prompt(F.array("c_mktsegment", F.lit("Small_Thing"))).alias("discovery"),
        t.box_token(F.when(F.col("c_custkey") % 2 == 0, F.struct(F.lit(1).alias("x1"), p["x"].alias("y1"), F.lit(3).alias("x2"), p["y"].alias("y2")))).alias("token"),
    )


def _prompt_sql(kind: str) -> str:
    text = t.PROMPTS[kind].replace("'", "''")
    return "concat('" + text.replace("{p}", "', p, '").replace("{r}", "', r, '") + f"') AS {kind}"


PROMPTS_SQL = f"""
WITH c AS (
  SELECT c_custkey, c_mktsegment, lower(c_mktsegment) AS r, CAST(least(1000, round_even((c_custkey % 500)::DOUBLE / 500 * 1000, 0)) AS INT) AS x, CAST(least(1000, round_even((c_nationkey * 7)::DOUBLE / 200 * 1000, 0)) AS INT) AS y FROM customer),
d AS (SELECT *, concat('<box><', x, '><', y, '></box>') AS p FROM c)
SELECT c_custkey, {", ".join(_prompt_sql(k) for k in t.PROMPTS)}, concat('{t.DISCOVERY}', lower(c_mktsegment), '</c>small thing.') AS discovery,
  CASE WHEN c_custkey % 2 = 0 THEN concat('<box><1><', x, '><3><', y, '></box>') ELSE '<box>None</box>' END AS token FROM d"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def conversation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit(""))))
    return _turns(spark, sf_dir).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(turns, "\n").alias("conversation"))


FLATTEN_SQL = "SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, ': ', coalesce(text, '')), chr(10) ORDER BY turn, role, text) AS conversation FROM conversations GROUP BY conv_id"


def role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _turns(spark, sf_dir)
    return c.select("conv_id", t.turns_text(F.col("turns"), role="role", value="text").alias("assistant"), F.size(F.filter("turns", lambda x: x["role"] == "system")).cast("long").alias("n_system"))


ROLE_SQL = "SELECT conv_id, coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (WHERE lower(role) IN ('gpt', 'assistant')), '') AS assistant, count(*) FILTER (WHERE role = 'system') AS n_system FROM conversations GROUP BY conv_id"


def violations_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    checks = [
        rules.Rule("short", F.col("n_chars") < 100),
        rules.Rule("unknown_language", ~F.col("lang").isin("en", "de", "fr")),
        rules.Rule("has_license", F.col("text").contains("Licensed under")),
        rules.Rule("control_characters", F.col("text").rlike("[\\x00-\\x08]")),
        rules.Rule("length_mismatch", F.length("text") != F.col("n_chars")),
    ]
    return rules.check(d, checks).select("doc_id", F.explode("violations").alias("violation"))


VIOLATIONS_SQL = r"""
SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unknown_language' END,
  CASE WHEN contains(text, 'Licensed under') THEN 'has_license' END, CASE WHEN regexp_matches(text, '[\x00-\x08]') THEN 'control_characters' END,
  CASE WHEN length(text) <> n_chars THEN 'length_mismatch' END], lambda x: x IS NOT NULL)) AS violation FROM documents"""


def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record rules over answers as discovery records with one image each."""
    a = answers(spark, sf_dir).withColumns(
        {
            "meta": F.struct(
                F.when(F.col("c_custkey") % 50 == 0, "other").otherwise("discovery").alias("route"), F.lit(None).cast("string").alias("round2_route"), F.when(F.col("c_custkey") % 40 == 0, "OBB").alias("geometry_mode"),
                F.lit(2).alias("target_count"), F.lit(None).cast("array<int>").alias("global_point"), F.lit(None).cast("array<int>").alias("local_point"), F.lit(None).cast("boolean").alias("fully_contained"),
            ),
            "images": F.array(F.struct(F.lit("a.png").alias("path"), F.lit(False).alias("virtual_crop"))),
        }
    )
    found = rules.record_rules(F.col("answer"), F.col("meta"), F.col("images"), F.lit(False))
    return rules.check(a, found).select("c_custkey", F.explode("violations").alias("violation"))


RECORDS_SQL = (
    "WITH "
    + ANSWERS_SQL
    + """,
n AS (
  SELECT *, len(regexp_extract_all(answer, '(?i)<box>\\s*<\\d+>\\s*<\\d+>\\s*</box>')) AS points, c_custkey % 50 <> 0 AS disc,
    greatest((c_custkey * 7 + 3) % 1100, (c_custkey * 11 + 5) % 1100) > 1000 AS off FROM ans)
SELECT c_custkey, unnest(list_filter([CASE WHEN NOT disc THEN 'unknown_route' END, CASE WHEN c_custkey % 40 = 0 THEN 'oriented_boxes' END,
  CASE WHEN disc AND points < 2 THEN 'reference_without_points' END, CASE WHEN disc AND off THEN 'point_outside_grid' END,
  CASE WHEN CASE WHEN disc THEN points ELSE 1 END <> 2 THEN 'target_count_mismatch' END], lambda x: x IS NOT NULL)) AS violation FROM n"""
)


def pointing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select("image_id", F.sha2(F.col("image_id").cast("string"), 256).alias("digest"), F.col("label").alias("class_name"), "box", F.lit(130).alias("width"), F.lit(120).alias("height"), F.col("k").alias("ord"))
    return expand.pointing_answers(b).withColumn("target_count", F.col("target_count").cast("long"))


POINTING_SQL = f"""
WITH {BOXES_SQL}, c AS (
  SELECT image_id, label, k, CAST(round_even((x1 + x2) / 2 / 130 * 1000, 0) AS INT) AS x, CAST(round_even((y1 + y2) / 2 / 120 * 1000, 0) AS INT) AS y FROM b)
SELECT image_id, label AS class_name, concat('<ref>', label, '</ref>', string_agg(concat('<box><', x, '><', y, '></box>'), '' ORDER BY k)) AS answer, count(*) AS target_count,
  substr(sha256(encode(concat(sha256(CAST(image_id AS VARCHAR)), chr(0), label))), 1, 24) AS record_id FROM c GROUP BY image_id, label"""


def evaluation_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"), F.lit(None).cast("string").alias("image_id"), F.concat(F.lit("images/"), F.col("doc_id").cast("string")).alias("image_path"),
        F.concat(F.lit(" "), F.col("text"), F.lit("..")).alias("query"), F.array(F.lit(1.0), F.lit(2.0), F.col("n_chars").cast("double"), F.lit(9.0)).alias("gt_hbox"),
    )
    m = expand.grounding_manifest(d, "DOCS")
    return m.select("sample_key", "image_id", "image", "task", "point_prompt", F.get("classes", 0).alias("class"), F.get(F.get("gt", 0)["hbox"], 2).alias("x2"))


MANIFEST_SQL = f"""
WITH q AS (SELECT *, regexp_replace(regexp_replace(concat(' ', text, '..'), '^\\s+', ''), '\\.+$', '') AS query FROM documents)
SELECT concat('DOCS:grounding:', doc_id) AS sample_key, CAST(doc_id AS VARCHAR) AS image_id, concat('images/', doc_id) AS image, 'grounding' AS task,
  concat('{t.SINGLE}', query, '.') AS point_prompt, query AS class, CAST(n_chars AS DOUBLE) AS x2 FROM q"""


QUERIES = {
    f.__name__: f
    for f in (
        parse_points, parse_single_box, answer_token_counts, canonical_labels, prompts_rendered, conversation_flatten, role_filter, violations_report, record_violations, pointing_answers,
        evaluation_manifest,
    )
}
ORACLES = {
    "parse_points": PARSE_SQL,
    "parse_single_box": SINGLE_SQL,
    "answer_token_counts": COUNTS_SQL,
    "canonical_labels": LABELS_SQL,
    "prompts_rendered": PROMPTS_SQL,
    "conversation_flatten": FLATTEN_SQL,
    "role_filter": ROLE_SQL,
    "violations_report": VIOLATIONS_SQL,
    "record_violations": RECORDS_SQL,
    "pointing_answers": POINTING_SQL,
    "evaluation_manifest": MANIFEST_SQL,
}
