"""Line-delimited JSON and text sources with explicit line numbers and an explicit policy for blank and bad lines."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.assets import walk
from plumbline.sources.ranges import SPLIT, numbered_lines


def blank(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"(?U)\s+", "")) == 0


def scan(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, strict: bool = True, split_bytes: int = SPLIT) -> DataFrame:
    """``path, line_no`` and the record, as ``record`` (variant, or a struct with ``schema``).

    Strict: a blank line, bad JSON or a line that is no object is an error with its place. Lenient: blank lines are skipped
    and keep their numbers; a bad line has a null record."""
    lines = numbered_lines(spark, paths, split_bytes)
    if not strict:
        lines = lines.filter(~blank(F.col("line")))
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    place = F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    if strict:
        wrong = F.when(blank(F.col("line")), F.concat(F.lit("blank line at "), place)).when(~is_object, F.concat(F.lit("no JSON object at "), place))
        parsed = parsed.withColumn("v", F.when(wrong.isNull(), F.col("v")).otherwise(F.raise_error(wrong).cast("variant")))
    record = F.col("v") if schema is None else F.from_json("line", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "PERMISSIVE"})
    if schema is not None and strict:
        record = F.when(F.col("v").isNotNull(), record)
    return parsed.select("path", "line_no", record.alias("record"))


def count_records(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """``path, records``; strictly a blank line is an error."""
    lines = numbered_lines(spark, paths)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("blank line at "), F.col("path"), F.lit(":"), F.col("line_no").cast("string")))
        one = F.when(blank(F.col("line")), wrong.cast("int")).otherwise(F.lit(1))
    else:
        one = F.when(blank(F.col("line")), 0).otherwise(1)
    return lines.groupBy("path").agg(F.sum(one).alias("records"))


def curriculum_plan(spark: SparkSession, root: str) -> DataFrame:
    """One row for the JSONL files below ``root``: ``files, bytes, gib, records``; blank lines don't count, empty files do."""
    found = walk(spark, root).filter(F.col("path").endswith(".jsonl"))
    sizes = found.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    lines = numbered_lines(spark, root).filter(F.col("path").endswith(".jsonl") & ~blank(F.col("line")))
    return sizes.crossJoin(lines.agg(F.count("*").alias("records"))).select("files", "bytes", (F.col("bytes") / 1024**3).alias("gib"), "records")  # a row and a row


def line_set(spark: SparkSession, paths: str | list[str], first_word: bool = False) -> DataFrame:
    """``key``: the different lines of text files, stripped; with ``first_word``, what stands before the first white space."""
    text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    key = F.get(F.split(text, r"(?U)\s+"), 0) if first_word else text
    return spark.read.text(paths).select(key.alias("key")).filter(F.length("key") > 0).distinct()


def ledger(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, digest`` from lines ``<64 hex>  <path>``; another form is an error, and so is a path that comes twice."""
    rows = spark.read.text(paths).filter(F.length(F.trim("value")) > 0)
    ok = F.col("value").rlike(r"^[0-9a-f]{64}  .+$")
    checked = F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no ledger line: "), F.col("value"))))
    parts = rows.select(checked.alias("value")).select(F.substring("value", F.lit(67), F.length("value")).alias("path"), F.substring("value", 1, 64).alias("digest"))
    once = parts.groupBy("path").agg(F.min("digest").alias("digest"), F.count("*").alias("n"))
    twice = F.raise_error(F.concat(F.lit("a path comes twice in the ledger: "), F.col("path"))).cast("string")
    return once.select(F.when(F.col("n") > 1, twice).otherwise(F.col("path")).alias("path"), "digest")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents (manifests, recipes, summaries) with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def image_items(image: Column) -> Column:
    """The union ``string | array of (string | struct)`` (as a variant) as an array of ``path, virtual_crop, crop_xyxy``."""
    item = "struct<path:string,virtual_crop:boolean,crop_xyxy:array<int>,resize_hw:array<int>,resample:string,schema:string>"

    def one(v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        whole = F.schema_of_variant(v).startswith("OBJECT")
        crop = F.try_variant_get(v, "$", item)
        return F.when(whole, crop).otherwise(F.named_struct(F.lit("path"), text, *[x for n, t in (("virtual_crop", "boolean"), ("crop_xyxy", "array<int>"), ("resize_hw", "array<int>"), ("resample", "string"), ("schema", "string")) for x in (F.lit(n), F.lit(None).cast(t))]).cast(item))

    many = F.try_variant_get(image, "$", "array<variant>")
    return F.when(F.schema_of_variant(image).startswith("ARRAY"), F.transform(many, one)).otherwise(F.array(one(image)))


def listing(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    """``path`` (relative to ``root``), ``bytes`` and ``modified`` of the files below ``root``, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    rel = F.regexp_replace("path", "^" + base.rstrip("/").replace("file://", "file:").replace(".", r"\.") + "/+", "")
    out = files.withColumn("path", rel)
    return out.filter(~F.col("path").rlike(exclude)) if exclude else out


def signature(spark: SparkSession, root: str) -> DataFrame:
    """``path, bytes, records, sha256`` of each file below ``root``. Shards are bounded, so a file fits a row."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.decode("content", "utf-8")
    return f.select("path", F.col("length").alias("bytes"), F.regexp_count(text, F.lit(r"[^\n]+(\n|$)")).alias("records"), F.sha2("content", 256).alias("sha256"))


def image_size(content: Column) -> Column:
    """Width and height from the header of PNG, GIF, BMP and JPEG bytes; null for others."""
    return F.pandas_udf(_sizes, "width int, height int")(content)


def _sizes(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_size(b) for b in content], columns=["width", "height"]).astype("Int32")


def _size(b: bytes | None) -> tuple[int | None, int | None]:
    if b is None:
        return None, None
    b = bytes(b)
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", b[16:24])
    if b[:4] == b"GIF8":
        return struct.unpack("<HH", b[6:10])
    if b[:2] == b"BM":
        w, h = struct.unpack("<ii", b[18:26])
        return w, abs(h)
    at = 2
    while b[:2] == b"\xff\xd8" and at + 9 < len(b) and b[at] == 0xFF:
        kind, n = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        at += 2 + n
    return None, None
