"""Queries over tables of records: set checks, counters, numbering, sampling, packing, schedules and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import numbers as n
from plumbline.functions import text as t
from plumbline.operators import integrity, metrics, ordered, sampling
from plumbline.plans.views import table
from plumbline.sources import sinks
from plumbline.sources.workspace import fresh_path
from plumbline.streaming import resume


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    first = integrity.first_by_key(d.select("digest", "doc_id", "source", "n_chars"), ["digest"], ["doc_id"])
    return first.groupBy("source").agg(F.count("*").alias("unique_texts"), F.sum("n_chars").alias("chars"), F.min("digest").alias("first_digest"))


DEDUP_SQL = """
WITH d AS (SELECT doc_id, source, n_chars, sha256(text) AS digest, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents)
SELECT source, count(*) AS unique_texts, sum(n_chars)::BIGINT AS chars, min(digest) AS first_digest FROM d WHERE k = 1 GROUP BY source"""


def holdout_overlap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text another source has too, as the held-out one of a pair of sources."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    held = d.filter("source = 'src0'").select(F.col("digest").alias("held"))
    return integrity.overlap(d.filter("source <> 'src0'"), held, "digest", "held").select("doc_id", "source")


EXACT_SQL = "SELECT doc_id, source FROM documents WHERE source <> 'src0' AND text IN (SELECT text FROM documents WHERE source = 'src0')"


def holdout_overlap_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return integrity.contained(d, b.select("item_id", F.col("text").alias("item")), "text", "item", "doc_id", "item_id").select(F.col("row_id").alias("doc_id"), F.col("holdout_id").alias("item_id"))


CONTAINED_SQL = "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0"


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train").alias("split"))
    return integrity.leakage(d).select("digest", F.array_join("splits", ",").alias("splits"))


LEAKAGE_SQL = """
SELECT sha256(text) AS digest, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM (SELECT text, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS s FROM documents)
GROUP BY text HAVING count(DISTINCT s) > 1"""


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return integrity.unprocessed(e.select("event_id", "event_type"), e.filter("event_id % 3 = 0").select("event_id"), "event_id")


def merge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    predictions = e.filter("event_id % 7 <> 0").select("event_id", "event_type")
    executions = e.filter("event_id % 11 <> 0").select("event_id", F.when(F.col("event_id") % 13 == 0, "changed").otherwise(F.col("event_type")).alias("event_type"))
    return integrity.coverage(predictions, executions, "event_id", ["event_type"])


COVERAGE_SQL = """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing' WHEN event_id % 7 = 0 THEN 'extra' ELSE 'differs' END AS status FROM events
WHERE NOT (event_id % 7 = 0 AND event_id % 11 = 0) AND (event_id % 7 = 0 OR event_id % 11 = 0 OR (event_id % 13 = 0 AND event_type <> 'changed'))"""


def ledger_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", "page_id", F.sha2("html", 256).alias("digest"))
    ledger = p.filter("coalesce(page_id % 9 <> 0, true)").select("url", F.when(F.col("page_id") % 8 == 0, F.sha2(F.col("url"), 256)).otherwise(F.col("digest")).alias("digest"))
    return integrity.coverage(p.select("url", "digest"), ledger, "url", ["digest"])


LEDGER_SQL = "SELECT url, CASE WHEN page_id % 9 = 0 THEN 'missing' ELSE 'differs' END AS status FROM pages WHERE page_id % 9 = 0 OR page_id % 8 = 0"


def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = d.join(lab.select("doc_id"), "doc_id", "left_semi").select("source")
    return integrity.multiset_difference(d.filter("lang = 'en'").select("source"), labelled, "source")


MULTISET_SQL = """
WITH a AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source)
SELECT source, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS extra FROM a FULL JOIN b USING (source) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""


def manifest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    sets = d.groupingSets([[], ["lang"], ["lang", "source"], ["quality"]], "lang", "source", "quality")
    return sets.agg(F.count("*").alias("records"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


COUNTERS_SQL = """
SELECT lang, source, quality, count(*) AS records, sum(n_chars)::BIGINT AS chars, GROUPING(lang, source, quality)::BIGINT AS level
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (lang, source), (quality))"""


def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("records")).withColumn("path", F.concat_ws("/", "source", "lang"))


_SIG_SQL = "sig AS (SELECT source, lang, count(*) AS records, concat(source, '/', lang) AS path FROM documents GROUP BY source, lang)"


def loss_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each task: its share of source queries by its share of all records; the mean weight is one."""
    s = _signature(spark, sf_dir)
    by = s.groupBy("lang").agg(F.sum("records").alias("flat"), F.sum(F.when(F.col("source").isin("src0", "src1", "src2"), F.col("records")).otherwise(0)).alias("queries"))
    whole = Window.partitionBy()  # a row per task
    w = (F.col("queries") / F.sum("queries").over(whole)) / (F.col("flat") / F.sum("flat").over(whole))
    return by.select("lang", "flat", "queries", F.round(w, 9).alias("weight"))


WEIGHTS_SQL = f"""
WITH {_SIG_SQL}, b AS (SELECT lang, sum(records)::BIGINT AS flat, sum(CASE WHEN source IN ('src0', 'src1', 'src2') THEN records ELSE 0 END)::BIGINT AS queries FROM sig GROUP BY lang)
SELECT lang, flat, queries, round((queries / sum(queries) OVER ()) / (flat / sum(flat) OVER ()), 9) AS weight FROM b"""


def weight_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = sampling.offsets(_signature(spark, sf_dir).select("path", "records"))
    places = table(spark, sf_dir, "documents").select((F.col("doc_id") * 3 + 1).alias("pos"))
    return ordered.range_lookup(places, ranges).select("pos", "path")


RANGE_SQL = f"""
WITH {_SIG_SQL}, r AS (SELECT path, sum(records) OVER (ORDER BY path) - records AS a, sum(records) OVER (ORDER BY path) AS b FROM sig)
SELECT doc_id * 3 + 1 AS pos, path FROM documents LEFT JOIN r ON doc_id * 3 + 1 >= a AND doc_id * 3 + 1 < b"""


def order_of_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many ranges as orders, each as wide as the order's part of the year; scattered places, many of them in no range or in the same."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 11).alias("records"), F.lit(0).alias("all"))
    placed = ordered.running(o, "all", ["o_orderkey"], "records", before="start")
    ranges = placed.select("o_orderkey", "start", (F.col("start") + F.col("records") - F.when(F.col("records") > 5, 1).otherwise(0)).alias("end"))
    places = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 3 == 0, 7).otherwise(F.col("l_orderkey") * 3 + F.col("l_linenumber")).alias("pos"))
    found = ordered.range_lookup(places, ranges)
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


PLACES_SQL = """
WITH r AS (
  SELECT o_orderkey, s - records AS a, s - CASE WHEN records > 5 THEN 1 ELSE 0 END AS b
  FROM (SELECT o_orderkey, o_orderkey % 11 AS records, sum(o_orderkey % 11) OVER (ORDER BY o_orderkey) AS s FROM orders)),
p AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_orderkey * 3 + l_linenumber END AS pos FROM lineitem)
SELECT o_orderkey, count(*) AS n, sum(pos)::BIGINT AS places FROM p LEFT JOIN r ON pos >= a AND pos < b GROUP BY o_orderkey"""


def pad_and_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("records"))
    return o.select("o_custkey", n.padding(F.col("records"), 8).alias("padding"), n.steps(F.col("records"), 8).alias("steps"))


PAD_SQL = "SELECT o_custkey, (8 - count(*) % 8) % 8 AS padding, (count(*) + (8 - count(*) % 8) % 8) // 8 AS steps FROM orders GROUP BY o_custkey"


def stress_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("lines", F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    scores = {"longest": F.col("n_chars"), "most_lines": F.col("lines"), "license": F.when(F.col("text").contains("icense"), F.lit(1))}
    found = sampling.argmax_per_reason(d.select("source", "doc_id", "n_chars", "lines", "text", "lang"), "source", "doc_id", scores, ["n_chars", "lang"])
    return found.select("source", "doc_id", "n_chars", "lang", F.array_join("reasons", ",").alias("reasons"))


STRESS_SQL = """
WITH d AS (SELECT *, length(text) - length(replace(text, chr(10), '')) AS lines FROM documents),
r AS (SELECT source, 'longest' AS reason, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM d GROUP BY source
  UNION ALL SELECT source, 'most_lines', arg_max(doc_id, (lines, -doc_id)) FROM d GROUP BY source
  UNION ALL SELECT source, 'license', min(doc_id) FROM d WHERE contains(text, 'icense') GROUP BY source)
SELECT r.source, r.doc_id, any_value(n_chars) AS n_chars, any_value(lang) AS lang, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r JOIN d USING (doc_id) GROUP BY r.source, r.doc_id"""


def hard_smoke_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.col("text").contains("icense").alias("license"))
    order = [F.desc("n_chars"), F.asc("doc_id")]
    rankings = [(F.col("lang") == x, order) for x in ("de", "en", "es", "fr")] + [(F.lit(True), order), (F.lit(True), [F.asc("n_chars"), F.asc("doc_id")]), (F.col("license"), order)]
    return sampling.interleaved(d, "doc_id", rankings, 24).select("slot", "doc_id", "lang", "n_chars").withColumn("slot", F.col("slot").cast("long"))


SMOKE_SQL = """
WITH d AS (SELECT doc_id, lang, n_chars, contains(text, 'icense') AS lic FROM documents),
r AS (
  SELECT doc_id, 0 AS rk, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS depth FROM d WHERE lang = 'de'
  UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM d WHERE lang = 'en'
  UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM d WHERE lang = 'es'
  UNION ALL SELECT doc_id, 3, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM d WHERE lang = 'fr'
  UNION ALL SELECT doc_id, 4, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM d
  UNION ALL SELECT doc_id, 5, row_number() OVER (ORDER BY n_chars, doc_id) FROM d
  UNION ALL SELECT doc_id, 6, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM d WHERE lic),
f AS (SELECT doc_id, min(depth * 10 + rk) AS turn_ FROM r GROUP BY doc_id ORDER BY 2 LIMIT 24)
SELECT row_number() OVER (ORDER BY turn_) - 1 AS slot, doc_id, lang, n_chars FROM f JOIN d USING (doc_id)"""


def stratified_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sampling.offsets(sampling.water_fill(_signature(spark, sf_dir).select("path", "records"), 100))
    return files.select("path", "take", F.explode(sampling.bin_midpoints(F.col("records"), F.col("take"))).alias("place"), "start").select("path", "take", (F.col("place") + F.col("start")).alias("pos"))


MONITOR_SQL = f"""
WITH RECURSIVE {_SIG_SQL}, f AS (SELECT path, records, sum(records) OVER (ORDER BY path) - records AS start, row_number() OVER (ORDER BY path) AS i FROM sig),
lv AS (SELECT 0 AS level UNION ALL SELECT level + 1 FROM lv WHERE (SELECT sum(least(records, level + 1)) FROM f) <= least(100, (SELECT sum(records) FROM f)) AND level < 200),
b AS (SELECT f.*, least(records, (SELECT max(level) FROM lv)) AS base FROM f),
k AS (SELECT *, base + CASE WHEN records > base AND sum(CASE WHEN records > base THEN 1 ELSE 0 END) OVER (ORDER BY path) <= least(100, sum(records) OVER ()) - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM b),
u AS (SELECT path, take, start, records, unnest(range(take)) AS s FROM k)
SELECT path, take::BIGINT AS take, (start + CASE WHEN take = records THEN s ELSE least(records - 1, ((2 * s + 1) * records) // (2 * take)) END)::BIGINT AS pos FROM u"""


def round_robin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders over seven shards, or as many as there are orders."""
    o = ordered.running(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], "o_orderkey", place="pos")
    total = o.groupBy("o_custkey").agg(F.count("*").alias("total"))
    dealt = o.join(total, "o_custkey").withColumn("shard", sampling.round_robin(F.col("pos"), 7, F.col("total")))
    return dealt.groupBy("o_custkey", "shard").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


SHARDS_SQL = """
SELECT o_custkey, CAST((k - 1) % least(7, n) AS INT) AS shard, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) GROUP BY o_custkey, 2"""


def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with further columns kept."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sampling.numbered(o, [F.desc("o_totalprice"), "o_orderkey"])


POSITIONS_SQL = "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders"


def rank_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    total = o.count()
    pad = -total % 16
    return sampling.rank_schedule(sampling.numbered(o, ["o_orderkey"]), "pos", total, pad, 16).select("o_orderkey", "rank", "step")


SCHEDULE_SQL = """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders),
p AS (SELECT o_orderkey, k FROM o UNION ALL SELECT o_orderkey, k + n FROM o WHERE k < (16 - n % 16) % 16)
SELECT o_orderkey, CAST(k % 16 AS INT) AS rank, k // 16 AS step FROM p"""


def resumed_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a schedule after its first fifty steps, without its last ten."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    total = o.count()
    pad = -total % 16
    return sampling.rank_schedule(sampling.numbered(o, ["o_orderkey"]), "pos", total, pad, 16, 50, (total + pad) // 16 - 10).select("o_orderkey", "rank", "step")


RESUMED_SQL = SCHEDULE_SQL + " WHERE k // 16 >= 50 AND k // 16 < (SELECT max(k) // 16 + 1 FROM p) - 10"


def next_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    packed = ordered.next_fit(d, "source", ["doc_id"], "n_chars", 20_000)
    return packed.groupBy("source", "pack").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"), F.min("doc_id").alias("first"))


def archive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of each source and language, planned in parallel."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "lang").alias("scope"), "doc_id", "n_chars")
    packed = ordered.next_fit(d, "scope", ["doc_id"], "n_chars", 15_000)
    name = F.format_string("images-%s-part-%05d.tar", "scope", "pack")
    return packed.groupBy(name.alias("archive")).agg(F.count("*").alias("members"), F.sum("n_chars").alias("bytes"))


def _fit_sql(group: str, where: str, target: int, out: str) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT {group} AS g, doc_id, n_chars, row_number() OVER (PARTITION BY {group} ORDER BY doc_id) AS k FROM documents {where}),
s AS (
  SELECT g, k, doc_id, n_chars, 0 AS pack, n_chars AS held FROM d WHERE k = 1
  UNION ALL
  SELECT d.g, d.k, d.doc_id, d.n_chars, CASE WHEN s.held > 0 AND s.held + d.n_chars > {target} THEN s.pack + 1 ELSE s.pack END, CASE WHEN s.held > 0 AND s.held + d.n_chars > {target} THEN d.n_chars ELSE s.held + d.n_chars END
  FROM s JOIN d ON d.g = s.g AND d.k = s.k + 1)
{out}"""


FIT_SQL = _fit_sql("source", "", 20_000, "SELECT g AS source, CAST(pack AS INT) AS pack, count(*) AS n, sum(n_chars)::BIGINT AS bytes, min(doc_id) AS first FROM s GROUP BY g, pack")
ARCHIVE_SQL = _fit_sql("concat(source, '-', lang)", "", 15_000, "SELECT format('images-{}-part-{:05d}.tar', g, pack) AS archive, count(*) AS members, sum(n_chars)::BIGINT AS bytes FROM s GROUP BY g, pack")


def selection_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.selection_digest(table(spark, sf_dir, "documents").select("source", "doc_id"), ["doc_id"], F.col("doc_id"), by=("source",))


DIGEST_SQL = "SELECT source, sha256(string_agg(CAST(doc_id AS VARCHAR), '' ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY source"


def single_valued_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("fixed", F.lit("v1"))
    return integrity.several_values(e, ["event_type", "fixed", "user_id"])


SINGLE_VALUED_SQL = "SELECT 'event_type' AS field, count(DISTINCT event_type) AS n_values FROM events UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events"


def contract_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("v"))
    saved = r.filter("n_name not like '%1'").select(F.col("n_name").alias("name"), F.when(F.col("n_name").like("%2"), "changed").otherwise(F.col("v")).alias("value"))
    return integrity.contract_difference(r.select(F.col("n_name").alias("name"), F.col("v").alias("value")), saved)


CONTRACT_SQL = "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS expected, CASE WHEN n_name LIKE '%2' THEN 'changed' END AS saved FROM nation WHERE n_name LIKE '%1' OR n_name LIKE '%2'"


def curve_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curve rows of each user up to the checkpoint's step."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    limit = e.groupBy("user_id").agg((F.max("event_id") - 1000).alias("checkpoint"))
    return e.join(limit, "user_id").filter("event_id <= checkpoint").groupBy("user_id").agg(F.count("*").alias("kept"), F.min_by("event_id", F.struct("value", "event_id")).alias("best"))


TRUNCATE_SQL = """
SELECT user_id, count(*) AS kept, arg_min(event_id, (value, event_id)) AS best FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) - 1000 AS c FROM events) WHERE event_id <= c GROUP BY user_id"""


def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sampling.keep_latest(o, "o_orderkey", 50, F.col("o_totalprice") > 440_000)


LATEST_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 440000 OR o_orderkey IN (SELECT DISTINCT o_orderkey FROM orders ORDER BY 1 DESC LIMIT 50)"


def sample_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", n.sample_seed(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), 20260901).alias("seed"))


SEED_SQL = "SELECT doc_id, (20260901 + ('0x' || substr(sha256(concat('doc:', doc_id)), 1, 8))::BIGINT) % 2147483648 AS seed FROM documents"


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(n.warmup_cosine(F.col("o_orderkey") % 12000, 10000, 500), 9).alias("factor"))


LR_SQL = """
SELECT o_orderkey, round(CASE WHEN s < 500 THEN (s + 1) / 500.0::DOUBLE ELSE 0.1 + 0.9 * 0.5 * (1 + cos(least(1.0, (s - 500) / 9500.0::DOUBLE) * pi())) END, 9) AS factor FROM (SELECT o_orderkey, o_orderkey % 12000 AS s FROM orders)"""


def token_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    ids = F.array(*[F.lit(x).cast("long") for x in (5, 90, 91, 91, 92)], F.col("o_orderkey") + 1000, F.lit(7).cast("long"))
    positions = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda x: x.cast("long"))
    out = o.select("o_orderkey", n.insert_image(ids, ids, positions, 91, 90, 92, 2).alias("s"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return out.select("o_orderkey", text("s.ids").alias("ids"), text("s.labels").alias("labels"), text("s.positions").alias("positions"))


SPLICE_SQL = """
SELECT o_orderkey, concat('5 90 91 91 92 90 91 91 92 ', o_orderkey + 1000, ' 7') AS ids, concat('5 90 91 91 92 -100 -100 -100 -100 ', o_orderkey + 1000, ' 7') AS labels, '0 1 2 3 4 5 6 7 8 9 10' AS positions FROM orders"""


def soft_argmax_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", n.soft_argmax(F.col("embedding")).alias("place"))


ARGMAX_SQL = """
WITH e AS (SELECT vec_id, i, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k, max(v) OVER (PARTITION BY vec_id) AS m FROM e)
SELECT vec_id, CAST(greatest(0, least(1000, round_even(sum(exp(v - m) * i) / sum(exp(v - m)), 0))) AS INT) AS place FROM t WHERE k <= 5 GROUP BY vec_id"""


def merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the merged log, a row per task; every eleventh row has no metric."""
    e = table(spark, sf_dir, "events").select(F.element_at(F.array(F.lit("detection"), F.lit("pointing"), F.lit("grounding"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int")).alias("task"), "event_id", "user_id")
    metric = F.when(F.col("event_id") % 11 != 0, F.struct((F.col("event_id") % 5).cast("int").alias("tp"), (F.col("event_id") % 3).cast("int").alias("fp"), (F.col("user_id") % 4).cast("int").alias("fn"), ((F.col("event_id") % 101) / 100).alias("iou")))
    s = metrics.summary(e.withColumns({"metric": metric, "seconds": F.when(F.col("event_id") % 2 == 0, 0.5)}))
    return s.withColumns({c: F.round(c, 9) for c in ("acc_0_5", "acc_0_7", "mean_iou", "precision", "recall", "f1", "seconds")})


SUMMARY_SQL = """
WITH e AS (SELECT CASE event_id % 4 WHEN 1 THEN 'pointing' WHEN 2 THEN 'grounding' ELSE 'detection' END AS task, event_id % 11 <> 0 AS has, event_id % 5 AS tp, event_id % 3 AS fp, user_id % 4 AS fn, (event_id % 101) / 100 AS iou, CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END AS sec FROM events),
s AS (SELECT task, count(*) AS samples, sum(tp) FILTER (WHERE has)::BIGINT AS tp, sum(fp) FILTER (WHERE has)::BIGINT AS fp, sum(fn) FILTER (WHERE has)::BIGINT AS fn,
  round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE has), 9) AS acc_0_5, round(avg(CASE WHEN iou >= 0.7 THEN 1.0 ELSE 0 END) FILTER (WHERE has), 9) AS acc_0_7, round(avg(iou) FILTER (WHERE has), 9) AS mean_iou, round(sum(sec), 9) AS seconds FROM e GROUP BY task)
SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s"""


def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda x: x.cast("long")).alias("ids"))
    p = c.select("conv_id", n.left_pad(F.col("ids"), 12, -1).alias("p"))
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), " ")
    return p.select("conv_id", text("p.row").alias("row"), text("p.mask").alias("mask"))


PADDED_SQL = """
WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS ids FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_concat(list_transform(range(greatest(12 - len(ids), 0)), lambda x: -1), ids), ' ') AS row, array_to_string(list_concat(list_transform(range(greatest(12 - len(ids), 0)), lambda x: 0), list_transform(ids, lambda x: 1)), ' ') AS mask FROM c"""


def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    files = sampling.offsets(d.groupBy("source").agg(F.count("*").alias("records")), order="source")
    placed = sampling.numbered(d, ["source", "doc_id"])
    return placed.join(files, "source").select("doc_id", "source", (F.col("pos") - F.col("start") + 1).alias("line"), "pos")


INDEX_SQL = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos FROM documents"


def path_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", F.lit("train"), F.when(F.col("page_id") % 2 == 0, "detection").otherwise("pointing"), F.lit("part-0.jsonl")).alias("path"), "url")
    return p.select("page_id", t.scope_of_path(F.col("path"), ("detection", "grounding", "pointing")).alias("task"), t.suffix(F.col("url")).alias("suffix"), t.safe_member(F.col("path")).alias("safe"), t.is_digest(F.sha2("url", 256)).alias("digest"))


SCOPES_SQL = """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'detection' ELSE 'pointing' END AS task,
  CASE WHEN regexp_matches(lower(url), '\\.(jpg|jpeg|png|bmp|tif|tiff|webp)$') THEN lower(regexp_extract(url, '(\\.[^./\\\\]+)$', 1)) ELSE '.img' END AS suffix, true AS safe, true AS digest FROM pages"""


def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("split"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    return d.dropDuplicates(["split", "digest"]).groupBy("split").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / (1 << 30), 9).alias("gib"))


INVENTORY_SQL = "SELECT split, count(*) AS files, sum(bytes)::BIGINT AS bytes, round(sum(bytes) / 1073741824, 9) AS gib FROM (SELECT DISTINCT source AS split, text, octet_length(encode(text)) AS bytes FROM documents) GROUP BY split"


def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same samples: which fields differ."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    other = e.withColumns({"event_type": F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("event_type")), "user_id": F.col("user_id") + F.when(F.col("event_id") % 34 == 0, 1).otherwise(0)})
    out = integrity.changed_fields(e, other, ["event_id"], ["event_type", "user_id"])
    return out.select("event_id", F.array_join("changed", ",").alias("changed"))


ARMS_SQL = "SELECT event_id, CASE WHEN event_id % 34 = 0 THEN 'event_type,user_id' ELSE 'event_type' END AS changed FROM events WHERE event_id % 17 = 0"


def recipe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a view in reading order (task, route, path) with their numbers."""
    s = _signature(spark, sf_dir).select(F.col("lang").alias("task"), F.when(F.col("source").like("%1"), "round1").otherwise("round2").alias("route"), "path", "records")
    ordered = sinks.recipe(s, ["fr", "de", "en", "es"], ["round1", "round2"])
    w = Window.orderBy(F.array_position(F.array(*[F.lit(x) for x in ("fr", "de", "en", "es")]), F.col("task")), "route", "path")
    return ordered.withColumn("slot", F.row_number().over(w).cast("long"))


RECIPE_SQL = f"""
WITH {_SIG_SQL}, s AS (SELECT lang AS task, CASE WHEN source LIKE '%1' THEN 'round1' ELSE 'round2' END AS route, path, records FROM sig)
SELECT *, row_number() OVER (ORDER BY list_position(['fr', 'de', 'en', 'es'], task), route, path) AS slot FROM s"""


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed twice (the second time as after a lost checkpoint): every key is stored once."""
    path, store = f"{sf_dir}/events.parquet", fresh_path(spark, "stream-store")
    # as a pattern: a stream takes a plain path for a folder
    source = lambda: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace("events.", "event[s].")).select("event_id", "event_type")
    for attempt in range(2):
        resume.process_stream(spark, source(), lambda rows: rows.withColumn("n", F.length("event_type")), store, "event_id", fresh_path(spark, f"stream-{attempt}"))
    return resume.stored(spark, store).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("keys"))


STREAM_SQL = "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY event_type"


QUERIES = {
    f.__name__: f
    for f in (
        content_dedup, holdout_overlap_exact, holdout_overlap_contained, split_leakage, duplicate_keys, resume_anti_join, merge_coverage, ledger_check, multiset_difference, manifest_counters,
        loss_weights, weight_range_lookup, order_of_place, pad_and_steps, stress_argmax, hard_smoke_selection, stratified_monitor, round_robin_shards, rank_schedule, resumed_schedule, next_fit_shards, archive_plan,
        selection_digest, single_valued_contract, contract_difference, curve_truncate, keep_latest, sample_seed, lr_schedule, token_splice, soft_argmax_top5, merge_summary, padded_rows,
        global_index, order_positions, path_scopes, inventory_totals, paired_arms, recipe_order, stream_resume,
    )
}
ORACLES = {
    "content_dedup": DEDUP_SQL,
    "holdout_overlap_exact": EXACT_SQL,
    "holdout_overlap_contained": CONTAINED_SQL,
    "split_leakage": LEAKAGE_SQL,
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "resume_anti_join": "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0",
    "merge_coverage": COVERAGE_SQL,
    "ledger_check": LEDGER_SQL,
    "multiset_difference": MULTISET_SQL,
    "manifest_counters": COUNTERS_SQL,
    "loss_weights": WEIGHTS_SQL,
    "weight_range_lookup": RANGE_SQL,
    "order_of_place": PLACES_SQL,
    "pad_and_steps": PAD_SQL,
    "stress_argmax": STRESS_SQL,
    "hard_smoke_selection": SMOKE_SQL,
    "stratified_monitor": MONITOR_SQL,
    "round_robin_shards": SHARDS_SQL,
    "rank_schedule": SCHEDULE_SQL,
    "resumed_schedule": RESUMED_SQL,
    "next_fit_shards": FIT_SQL,
    "archive_plan": ARCHIVE_SQL,
    "selection_digest": DIGEST_SQL,
    "single_valued_contract": SINGLE_VALUED_SQL,
    "contract_difference": CONTRACT_SQL,
    "curve_truncate": TRUNCATE_SQL,
    "keep_latest": LATEST_SQL,
    "sample_seed": SEED_SQL,
    "lr_schedule": LR_SQL,
    "token_splice": SPLICE_SQL,
    "soft_argmax_top5": ARGMAX_SQL,
    "merge_summary": SUMMARY_SQL,
    "padded_rows": PADDED_SQL,
    "global_index": INDEX_SQL,
    "order_positions": POSITIONS_SQL,
    "path_scopes": SCOPES_SQL,
    "inventory_totals": INVENTORY_SQL,
    "paired_arms": ARMS_SQL,
    "recipe_order": RECIPE_SQL,
    "stream_resume": STREAM_SQL,
}
