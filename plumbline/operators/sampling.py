"""Numbering, sharding, scheduling and selection with a declared order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.workspace import fresh_path


def numbered(rows: DataFrame, order: list[Column | str], out: str = "pos") -> DataFrame:
    """Add each row's place (from 0) in a total order without sending all rows to one task: rows are range-partitioned,
    sorted and stored with their number in their partition, and a partition's places start after those before it.

    They are stored because range bounds come from a sample: two plans of the same rows may have different bounds."""
    spark = rows.sparkSession
    own = [f"c{k}" for k in range(len(rows.columns))]  # further columns may have any names
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = ordered.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(rows.columns, own)], F.monotonically_increasing_id().alias("at"))
    path = fresh_path(spark, "numbered")
    stored.write.mode("error").parquet(path)
    stored = spark.read.schema(stored.schema).parquet(path)
    part, k = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = stored.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stored.withColumn("part", part).join(F.broadcast(counts.select("part", before.alias("start"))), "part")
    return placed.select(*[F.col(o).alias(c) for c, o in zip(rows.columns, own)], (F.col("start") + k).cast("long").alias(out))


def round_robin(pos: Column, shards: int, total: Column) -> Column:
    """The shard of a place; there are no more shards than rows."""
    return F.pmod(pos, F.greatest(F.lit(1).cast("long"), F.least(F.lit(shards).cast("long"), total))).cast("int")


def rank_schedule(rows: DataFrame, pos: str, total: int, padding: int, world: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """Add ``rank`` and ``step``: the schedule is all rows in order, then the first ``padding`` again; rank r takes every
    ``world``-th place from r. ``start`` and ``stop`` are steps (a resumed run starts later)."""
    if total <= 0 or padding < 0 or padding >= max(1, total):
        raise ValueError("padding must be from 0 to below the number of rows")
    again = F.when(F.col(pos) < padding, F.array(F.col(pos), F.col(pos) + total)).otherwise(F.array(F.col(pos)))
    placed = rows.withColumn("_place", F.explode(again))
    out = placed.withColumns({"rank": F.pmod("_place", F.lit(world)).cast("int"), "step": F.floor(F.col("_place") / world).cast("long")}).drop("_place")
    out = out.filter(F.col("step") >= start) if start else out
    return out if stop is None else out.filter(F.col("step") < stop)


def shuffled_order(key: Column, seed: int) -> Column:
    """A column to order by for a seeded permutation."""
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def water_fill(files: DataFrame, limit: int, size: str = "records", order: str = "path") -> DataFrame:
    """Add ``take``: a share of ``limit`` for each file, as equal as its records allow, earlier files first for the rest.

    The level up to which all files are filled follows from how many files have each size."""
    sizes = sorted((r[0], r[1]) for r in files.filter(F.col(size) > 0).groupBy(size).count().collect())  # a row per different file size
    total, n_files = sum(v * m for v, m in sizes), sum(m for _, m in sizes)
    goal = total if limit <= 0 else min(limit, total)
    level, filled, left_files = 0, 0, n_files
    for value, m in sizes:
        if filled + (value - level) * left_files > goal:
            break
        filled += (value - level) * left_files
        level, left_files = value, left_files - m
    if left_files:
        level += (goal - filled) // left_files
        filled += (goal - filled) // left_files * left_files
    more = F.when(F.col(size) > level, 1).otherwise(0)
    turn = F.sum(more).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    take = F.least(F.col(size), F.lit(level)) + F.when((more == 1) & (turn <= goal - filled), 1).otherwise(0)
    return files.withColumn("take", take.cast("long"))


def bin_midpoints(count: Column, take: Column) -> Column:
    """``take`` places in a file of ``count`` records: all, or the midpoints of equally wide bins."""
    slots = F.sequence(F.lit(0).cast("long"), take - 1)
    mid = lambda s: F.least(count - 1, F.floor(((2 * s + 1) * count) / (2 * take)).cast("long"))
    return F.when(take <= 0, F.expr("cast(array() as array<bigint>)")).when(take == count, slots).otherwise(F.transform(slots, mid))


def offsets(files: DataFrame, size: str = "records", order: str = "path") -> DataFrame:
    """Add ``start`` and ``end``: the range of global places of each file."""
    upto = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("end", upto.cast("long")).withColumn("start", (F.col("end") - F.col(size)).cast("long"))


def argmax_per_reason(rows: DataFrame, shard: str, line: str, scores: dict[str, Column], payload: list[str]) -> DataFrame:
    """For every shard and reason the row with the largest score, the earliest on ties; then a row per place with its
    sorted reasons. A null score doesn't compete."""
    best = rows.groupBy(shard).agg(
        *[F.max(F.when(s.isNotNull(), F.struct(s.cast("long").alias("s"), (-F.col(line)).alias("l"), F.struct(*payload).alias("p")))).alias(r) for r, s in scores.items()]
    )
    each = F.explode(F.array_compact(F.array(*[F.when(F.col(r).isNotNull(), F.struct(F.lit(r).alias("reason"), (-F.col(f"{r}.l")).alias("line"), F.col(f"{r}.p").alias("p"))) for r in scores])))
    found = best.select(shard, each.alias("e"))
    return found.groupBy(shard, F.col("e.line").alias(line)).agg(F.sort_array(F.collect_set("e.reason")).alias("reasons"), F.first("e.p").alias("p")).select(shard, line, "reasons", "p.*")


def interleaved(rows: DataFrame, key: str, rankings: list[tuple[Column, list[Column]]], n: int) -> DataFrame:
    """The first ``n`` different rows when the rankings are read in turns: the first of each, then the second of each ...

    A ranking is a filter and an order; only its first ``n`` rows can matter, so only these are kept."""
    parts = None
    for k, (keep, order) in enumerate(rankings):
        top = rows.filter(keep).orderBy(*order).limit(n)
        part = top.withColumns({"_depth": F.row_number().over(Window.orderBy(*order)), "_ranking": F.lit(k)})
        parts = part if parts is None else parts.unionByName(part)
    first = parts.groupBy(key).agg(F.min(F.struct("_depth", "_ranking")).alias("_at"), F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_row"))
    chosen = first.orderBy("_at").limit(n)
    return chosen.select(key, "_row.*", (F.row_number().over(Window.orderBy("_at")) - 1).alias("slot"))


def keep_latest(rows: DataFrame, name: str, k: int, protected: Column) -> DataFrame:
    """The last ``k`` by name, and those that are protected."""
    last = rows.select(name).distinct().orderBy(F.desc(name)).limit(k).withColumnRenamed(name, "_last")
    return rows.join(F.broadcast(last), F.col(name) == F.col("_last"), "left").filter(F.col("_last").isNotNull() | F.coalesce(protected, F.lit(False))).drop("_last")


def selection_digest(rows: DataFrame, order: list[str], value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 over the values of a selection (of each group ``by``) in order, and how many there are. The digest is of one string, so this is for selections, not corpora."""
    listed = F.sort_array(F.collect_list(F.struct(*order, value.cast("string").alias("_v"))))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(listed, lambda r: r["_v"]), ""), 256).alias("digest"), F.count("*").alias("n"))
