"""Sinks: byte-bounded JSONL shards, keyed folders, ledgers, small documents written at once, and generated text."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import next_fit
from plumbline.sources.store import open_store


def write_document(path: str, value: object) -> None:
    """A small JSON document with sorted keys, in any store: written beside its place and moved there, so readers see the old or the new one."""
    store, at = open_store(path)
    folder = at.rpartition("/")[0]
    if folder:
        store.create_dir(folder, recursive=True)
    temporary = f"{at}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary, compression=None) as f:
        f.write((json.dumps(value, indent=2, sort_keys=True) + "\n").encode())
    store.move(temporary, at)


def read_document(path: str) -> object:
    store, at = open_store(path)
    with store.open_input_file(at) as f:
        return json.loads(f.read())


def point_to(pointer: str, target: str) -> None:
    """Let ``pointer`` (last, best) name ``target``: a small document, since not every store has links; replaced at once."""
    write_document(pointer, {"target": target})


def resolved(recipe: DataFrame, files: DataFrame) -> DataFrame:
    """The recipe's rows (``path`` and others), if ``files`` (``path``) has each of their shards; a missing one is an error."""
    there = files.select(F.col("path").alias("_path")).distinct()
    missing = F.raise_error(F.concat(F.lit("a shard of the recipe isn't there: "), F.col("path"))).cast("string")
    joined = recipe.join(there, F.col("path") == F.col("_path"), "left")
    return joined.withColumn("path", F.when(F.col("_path").isNull(), missing).otherwise(F.col("path"))).drop("_path")


def json_line(row: Column) -> Column:
    """A row as compact JSON with its null fields, as the shards hold it."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def json_bytes(line: Column) -> Column:
    """The bytes of a line with its end when all beyond ASCII is escaped: six for each UTF-16 unit of it."""
    beyond = F.regexp_replace(line, r"[\x00-\x7f]+", "")
    units = F.octet_length(F.encode(beyond, "UTF-16BE")) / 2
    return (F.length(line) - F.length(beyond) + 6 * units + 1).cast("long")


def with_shards(rows: DataFrame, keys: list[str], order: list[str], max_bytes: int) -> DataFrame:
    """Add ``line``, ``n_bytes`` and ``shard``: rows of a key fill shards in order, each up to ``max_bytes``."""
    payload = [c for c in rows.columns]
    lined = rows.withColumn("line", json_line(F.struct(*payload)))
    lined = lined.withColumn("n_bytes", json_bytes(F.col("line"))).withColumn("_key", F.to_json(F.struct(*keys)))
    return next_fit(lined, "_key", order, "n_bytes", max_bytes, out="shard").drop("_key")


def write_shards(rows: DataFrame, path: str, keys: list[str], order: list[str], max_bytes: int) -> None:
    """JSONL files ``<key>=<value>/.../shard=<n>`` of bounded size, the lines in order."""
    sharded = with_shards(rows, keys, order, max_bytes).select(*keys, "shard", *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], "line")
    dealt = sharded.repartition(*keys, "shard").sortWithinPartitions(*keys, "shard", *[f"_o{k}" for k in range(len(order))])
    dealt.select(*keys, "shard", F.col("line").alias("value")).write.mode("overwrite").partitionBy(*keys, "shard").text(path)


def write_keyed(rows: DataFrame, path: str, keys: list[str]) -> None:
    """A folder per key, one writer per task and key."""
    rows.repartition(*keys).write.mode("overwrite").partitionBy(*keys).json(path)


def ledger_lines(files: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Lines ``<digest>  <path>`` in the order of paths."""
    return files.orderBy(path).select(F.concat(digest, F.lit("  "), path).alias("value"))


def recipe(shards: DataFrame, tasks: list[str], routes: list[str]) -> DataFrame:
    """The order in which a view reads its shards: by task, then route, then path. ``shards``: ``task, route, path, records``."""
    rank = lambda c, names: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c))
    return shards.orderBy(rank("task", tasks), rank("route", routes), "path")


def stale_files(existing: DataFrame, expected: DataFrame, name: str = "path") -> DataFrame:
    """Files that are there but not expected: a sink must not leave an older run's shards behind."""
    return existing.join(expected.select(name), name, "left_anti")


def card(title: str, totals: dict[str, object]) -> str:
    """A markdown card from aggregate values."""
    body = "\n".join(f"| {k} | {v:,} |" if isinstance(v, int) else f"| {k} | {v} |" for k, v in sorted(totals.items()))
    return f"# {title}\n\n| Measure | Value |\n|---|---:|\n{body}\n"
