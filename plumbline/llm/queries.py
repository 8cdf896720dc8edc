"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bytebpe, clustering, decontaminate, hard_negatives, jaccard, line_dedup, packing, quality_model, quality_rules, secret_scan, token_counts, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "word_bpe_49k.json"

#: Rules that the site owners gave, and hosts known for spam: ``(rule, action, list)``.
URL_LIST = (
    ("org/", "allow", "1-owners"),
    ("example.org/es/", "block", "1-owners"),
    ("example.org/en/1", "block", "1-owners"),
    ("com/fr/", "allow", "1-owners"),
    ("com/de/", "block", "1-owners"),
    ("spam-farm.example.org/", "block", "2-spam"),
    ("spam-farm.example.com/", "block", "2-spam"),
    ("spam-farm.example.net/", "block", "2-spam"),
    ("cheap-pills.example.com/", "block", "2-spam"),
    ("cheap-pills.example.net/", "block", "2-spam"),
    ("cheap-pills.example.org/", "block", "2-spam"),
)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("matches", lambda m: m["item_id"]))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("item_ids"), F.to_json("matches").alias("matches"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_prefix_counts(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), vocabulary(), keep=["doc_id", "n_bytes"])
    rows = counted.select("doc_id", "n_bytes", token_counts.count_at(F.col("prefix_counts"), (1 << 31) - 1).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(URL_LIST, "rule string, action string, list string")
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed)
    rule = F.when(F.col("list") == "1-owners", F.col("rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")


OP6_SQL = r"""
WITH rules(rule, action, list) AS (VALUES """ + ", ".join(f"('{r}', '{a}', '{n}')" for r, a, n in URL_LIST) + r"""),
p AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (
  SELECT r, rule, action, list, row_number() OVER (PARTITION BY r ORDER BY list, length(rule) DESC, rule) AS k
  FROM h JOIN rules ON (host = split_part(rule, '/', 1) OR suffix(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT page_id, host, path, CASE WHEN list = '1-owners' THEN rule END AS rule, coalesce(action, 'allow') AS verdict
FROM h LEFT JOIN m ON h.r = m.r AND m.k = 1
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.with_score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    records = warc.read_archives(spark, path)
    whole = F.col("record_type") == "response"  # of these the payload itself was read back
    return records.select(
        warc.page_id(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        warc.page_id(F.col("refers_to")).alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
FROM m
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    n = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    return line_dedup.dedup_lines(docs).select("doc_id", (n("before") - n("text")).alias("n_chars_removed"), "text")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted), anchors=F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
p AS (
  SELECT a, b AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, positive_id ORDER BY score DESC, b) AS INTEGER) AS rank,
  b AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = clustering.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return clustering.with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64) -> str:
    """Each round as two common table expressions: the nearest centroid of every vector, and the floored means."""
    steps = [f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dimensions}),
x AS MATERIALIZED (SELECT r, unnest(range({dimensions})) AS i, unnest(v) AS x FROM e),
c0 AS MATERIALIZED (
  SELECT k, unnest(range({dimensions})) AS i, unnest(v) AS c FROM (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM e) WHERE k < {clusters})"""]  # fmt: skip
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, k, d FROM (SELECT r, k, sum((x - c) * (x - c)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c{n}.k, c{n}.i, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
    SELECT k, i, CAST((s - (s % n + n) % n) // n AS BIGINT) AS c FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY k, i)) m
  ON m.k = c{n}.k AND m.i = c{n}.i)""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN e USING (r) JOIN (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k) h ON h.k = a.k"""


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bytebpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=["doc_id"])
    both = bytebpe.decode_ids(encoded, path)
    listed = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filters": op6_url_filters,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_hard_negative_mining": op11_hard_negative_mining,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_bpe_encoding": op13_bpe_encoding,
}

ORACLES: dict[str, str] = {
    "op5_quality_rules": quality_rules.REPORT_SQL,
    "op6_url_filters": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op11_hard_negative_mining": OP11_SQL,
    "op12_centroid_clustering": _op12_sql(),
}
