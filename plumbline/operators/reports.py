"""Counts that a corpus is released with, and the rankings and cuts of evaluation: every report is one aggregation."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histograms(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """``dimension, value, n`` for all dimensions in one pass; nulls count under a null value."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in dimensions.items()]))
    return rows.select(each.alias("e")).groupBy("e.dimension", "e.value").agg(F.count("*").alias("n"))


def shares(rows: DataFrame, part: Column, query: Column, by: list[str]) -> DataFrame:
    """Records and query records of two parts (``part`` true: replay, false or null: dense), with the share of replay in both;
    a share of nothing is null."""
    replay, asked = F.coalesce(part, F.lit(False)), F.coalesce(query, F.lit(False))
    n = lambda c: F.count_if(c)
    out = rows.groupBy(*by).agg(
        n(replay).alias("replay_records"), n(~replay).alias("dense_records"), n(replay & asked).alias("replay_queries"), n(~replay & asked).alias("dense_queries")
    )
    share = lambda k: F.try_divide(F.col(f"replay_{k}"), F.col(f"replay_{k}") + F.col(f"dense_{k}"))
    return out.withColumns({"record_share": share("records"), "query_share": share("queries")})


def accounting(observed: DataFrame, declared: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose observed and declared counts differ, or that only one side has (its count is 0 on the other)."""
    a, b = observed.select(key, F.col(count).alias("observed")), declared.select(key, F.col(count).alias("declared"))
    zero = {"observed": F.coalesce("observed", F.lit(0)).cast("long"), "declared": F.coalesce("declared", F.lit(0)).cast("long")}
    return a.join(b, key, "full").withColumns(zero).filter("observed <> declared")


def class_presence(labels: DataFrame, label: str, required: list[str], forbidden: list[str]) -> DataFrame:
    """``label, n, violation`` for the listed classes: required ones that are absent, forbidden ones that are there."""
    listed = labels.sparkSession.createDataFrame([(x, "required") for x in required] + [(x, "forbidden") for x in forbidden], "label string, rule string")
    seen = labels.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    broken = F.when(F.col("rule") == "required", n <= 0).otherwise(n > 0)
    return listed.join(seen, "label", "left").select("label", "rule", n.alias("n"), broken.alias("violation"))


def means_across_ranks(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Each metric's mean over the rows of all ranks: a row without a metric counts as 0 and stays in the divisor."""
    return rows.agg(*[(F.sum(F.coalesce(F.col(m), F.lit(0.0))) / F.count("*")).alias(m) for m in metrics], F.count("*").alias("n"))


def score_features(turns: Column, assistant: Column, target_count: Column, size: Column, images: Column) -> dict[str, Column]:
    """The five features by which hard examples are ranked: arrays of turn and assistant texts, the target count, an array of
    two sizes (others count as no area) and an array of images (null: one)."""
    chars = F.aggregate(F.coalesce(turns, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.length(x), F.lit(0)))
    said = F.lower(F.array_join(F.coalesce(assistant, F.array().cast("array<string>")), "\n"))
    area = F.when(F.size(size) == 2, F.get(size, 0).cast("long") * F.get(size, 1).cast("long"))
    return {
        "conversation_chars": chars,
        "target_count": F.coalesce(target_count.cast("long"), F.lit(0)),
        "source_image_area": F.coalesce(area, F.lit(0)).cast("long"),
        "visual_inputs": F.when(images.isNull(), 1).otherwise(F.size(images)).cast("long"),
        "explicit_none": F.contains(said, F.lit("<box>none</box>")).cast("long"),
    }


def hardness(key: str) -> list[Column]:
    """The order of a ranking: by ``key``, then characters and targets falling, then source and line rising."""
    return [F.desc(key), F.desc("conversation_chars"), F.desc("target_count"), F.asc("source"), F.asc("line")]


def fill(rows: DataFrame, chosen: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` that aren't chosen yet."""
    return rows.join(chosen.select(*key).distinct(), key, "left_anti").orderBy(*order).limit(n)


def first_valid(predictions: Column) -> Column:
    """The prediction that a single-object protocol scores: the first, or null."""
    return F.get(predictions, 0)


def allowed(points: Column, classes: Column) -> Column:
    """The points whose label is one of the row's classes."""
    return F.filter(points, lambda p: F.array_contains(classes, p["label"]))


def ordered_distinct(listed: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Each path once, at its first place over all groups."""
    return listed.groupBy(path).agg(F.min(F.struct(*order)).alias("_at")).select(path, "_at.*")


# Fixed values of the record format: the image placeholder and the marks of boxes and references.
IMAGE, BOX, REF = "<image>", "<box>", "<ref>"


def placeholders(prompt: Column) -> Column:
    """How many image placeholders a prompt has; a null prompt has none."""
    p = F.coalesce(prompt, F.lit(""))
    return ((F.length(p) - F.length(F.replace(p, F.lit(IMAGE), F.lit("")))) / len(IMAGE)).cast("long")


def box_only(answer: Column) -> Column:
    """Whether an answer begins with a box and refers to nothing; a null answer doesn't."""
    return F.coalesce(F.startswith(answer, F.lit(BOX)) & ~F.contains(answer, F.lit(REF)), F.lit(False))


def path_digest(path: Column) -> Column:
    """The SHA-256 that names a content-addressed file, without its suffix; null if the name is no digest."""
    found = F.regexp_extract(path, r"(?:^|/)([0-9a-f]{64})(?:\.[^./]*)?$", 1)
    return F.when(found != "", found)


def grid_rankings(rows: DataFrame, dimensions: dict[str, list[str]], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every cell of a grid, with the cell's place in the fixed order of the dimensions' values; cells
    without rows have none. The grid is as large as its lists and is broadcast."""
    cells = [(k, *cell) for k, cell in enumerate(itertools.product(*dimensions.values()))]
    grid = rows.sparkSession.createDataFrame(cells, ["cell", *dimensions])
    ranked = rows.join(F.broadcast(grid), list(dimensions)).withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(*order)))
    return ranked.filter(F.col("place") <= n)


def zipped(addresses: DataFrame, outputs: DataFrame, key: str, pos: str) -> DataFrame:
    """Addresses with the output at the same place of the same key; ``paired`` is false where only one side has the place."""
    a, b = addresses.withColumn("_a", F.lit(True)), outputs.withColumn("_b", F.lit(True))
    return a.join(b, [key, pos], "full").withColumn("paired", F.col("_a").isNotNull() & F.col("_b").isNotNull()).drop("_a", "_b")


def roll_up(summaries: dict[str, DataFrame], name: str = "benchmark") -> DataFrame:
    """One table of the summaries of all benchmarks, each under its name; a metric that one lacks is null there."""
    out = None
    for k in sorted(summaries):
        part = summaries[k].withColumn(name, F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
