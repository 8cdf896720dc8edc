"""Queries through files: rows written by the sinks, found and read again by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import merge, ordered
from plumbline.plans.corpus import _fit_sql
from plumbline.plans.views import table
from plumbline.sources import archives, assets, jsonl, sinks, staged
from plumbline.sources.workspace import fresh_path


def numbered_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a line of a bounded shard, and the lines numbered while the shards are read in small ranges."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text", "n_chars")
    packed = ordered.next_fit(d, "source", ["doc_id"], "n_chars", 200_000, out="shard")
    file = F.format_string("source=%s/shard-%05d.jsonl", "source", "shard")
    path = fresh_path(spark, "json-lines")
    staged.write_lines(packed, path, file, ["doc_id"], sinks.json_line(F.struct("doc_id", "n_chars", "text")))
    lines = jsonl.scan(spark, staged.committed(path), "doc_id long, n_chars long, text string", split_bytes=1 << 16)
    place = F.regexp_extract("path", r"source=([^/]*)/shard-(\d+)", 1), F.regexp_extract("path", r"source=([^/]*)/shard-(\d+)", 2).cast("int")
    return lines.select(place[0].alias("source"), place[1].alias("shard"), F.col("line_no").alias("line_no"), "record.doc_id", F.sha2("record.text", 256).alias("sha256"))


LINES_SQL = _fit_sql("source", "", 200_000, "SELECT g AS source, CAST(pack AS INT) AS shard, row_number() OVER (PARTITION BY g, pack ORDER BY s.doc_id) AS line_no, s.doc_id, sha256(text) AS sha256 FROM s JOIN documents USING (doc_id)")


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as members of archives, read back by member ranges."""
    pages = table(spark, sf_dir, "pages").select(F.format_string("pages-%d.tar", F.col("page_id") % 5).alias("archive"), F.format_string("html/%08d.html", "page_id").alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    path = fresh_path(spark, "archives")
    staged.write_archives(pages, path)
    found = archives.members(spark, staged.committed(path), split_bytes=1 << 18)
    own = F.regexp_replace(F.element_at(F.split("archive", "/"), -1), "-[0-9a-f]{16}(?=\\.tar$)", "")
    return found.select(own.alias("archive"), "path", "bytes", "sha256", F.octet_length("content").cast("long").alias("read"))


MEMBERS_SQL = """
SELECT concat('pages-', page_id % 5, '.tar') AS archive, concat('html/', lpad(CAST(page_id AS VARCHAR), 8, '0'), '.html') AS path, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes, sha256(coalesce(html, '')) AS sha256,
  octet_length(encode(coalesce(html, '')))::BIGINT AS read FROM pages"""


def committed_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last commit of a table lists, after a first commit, a rerun and an append."""
    o = table(spark, sf_dir, "orders").select(F.format_string("status=%s/priority=%s.csv", "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("file"), "o_orderkey", "o_custkey")
    path, line = fresh_path(spark, "inventory"), F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    first = o.filter("file like 'status=F%'")
    for rows, append in ((first, False), (first, False), (o.filter("file not like 'status=F%'"), True)):
        staged.write_lines(rows, path, F.col("file"), ["o_orderkey"], line, append=append)
    return staged.inventory(spark, path).select("file", "sha256", "bytes", "rows")


INVENTORY_SQL = """
SELECT concat('status=', o_orderstatus, '/priority=', substr(o_orderpriority, 1, 1), '.csv') AS file, sha256(string_agg(concat(o_orderkey, ',', o_custkey, chr(10)), '' ORDER BY o_orderkey)) AS sha256,
  sum(length(concat(o_orderkey, ',', o_custkey)) + 1)::BIGINT AS bytes, count(*) AS rows FROM orders GROUP BY 1"""


def content_addressed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found by a walk, digested, and stored once for each content; every list of orders exists twice."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 16).alias("m"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("copy"))
    path = fresh_path(spark, "files")
    staged.write_lines(o, path, F.format_string("%s/list-%02d.txt", "copy", "m"), ["k"], F.col("k").cast("string"))
    found = assets.trusted_digests(assets.listed(spark, path, prune=("_staging",), exclude="^_manifest"))
    placed = assets.targets(found, F.lit("train"), top="lists")
    return assets.materialise(placed, fresh_path(spark, "contents"))


CONTENTS_SQL = """
SELECT concat('lists/train/', substr(h, 1, 2), '/', h, '.img') AS target, h AS sha256, b::BIGINT AS bytes, 'written' AS status
FROM (SELECT sha256(string_agg(concat(o_orderkey, chr(10)), '' ORDER BY o_orderkey)) AS h, sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS b FROM orders GROUP BY o_custkey % 16)"""


def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of seven shards against the orders that were due, over buckets; some outputs are lost, some came twice, some have no order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    shards = F.when(k % 50 == 0, F.array().cast("array<bigint>")).when(k % 51 == 0, F.array(k % 7, (k + 1) % 7)).otherwise(F.array(k % 7))
    outputs = o.withColumn("shard", F.explode(shards)).withColumn("shard", F.concat(F.lit("shard-"), F.col("shard").cast("string")))
    due = o.filter("o_orderkey % 53 <> 0").select("o_orderkey")
    found = merge.checked_merge(merge.bucketed(outputs, "o_orderkey", 8), merge.bucketed(due, "o_orderkey", 8), "o_orderkey")
    return found.select("o_orderkey", "status", F.array_join("shards", ",").alias("shards"), "row.o_custkey")


MERGED_SQL = """
WITH x AS (SELECT o_orderkey AS k, o_custkey, unnest(CASE WHEN o_orderkey % 50 = 0 THEN [] WHEN o_orderkey % 51 = 0 THEN [o_orderkey % 7, (o_orderkey + 1) % 7] ELSE [o_orderkey % 7] END) AS s FROM orders),
g AS (SELECT k, count(*) AS n, string_agg('shard-' || s, ',' ORDER BY s) AS shards, min(o_custkey) AS c FROM x GROUP BY k),
d AS (SELECT o_orderkey AS d FROM orders WHERE o_orderkey % 53 <> 0)
SELECT coalesce(k, d) AS o_orderkey, CASE WHEN k IS NULL THEN 'missing' WHEN d IS NULL THEN 'extra' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS status, coalesce(shards, '') AS shards,
  CASE WHEN k IS NOT NULL AND d IS NOT NULL AND n = 1 THEN c END AS o_custkey FROM g FULL JOIN d ON k = d"""


QUERIES = {f.__name__: f for f in (numbered_json_lines, archive_members, committed_inventory, content_addressed_files, merged_shards)}
ORACLES = {"numbered_json_lines": LINES_SQL, "archive_members": MEMBERS_SQL, "committed_inventory": INVENTORY_SQL, "content_addressed_files": CONTENTS_SQL, "merged_shards": MERGED_SQL}
