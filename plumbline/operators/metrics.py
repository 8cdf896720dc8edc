"""Metrics as aggregates with partial sums: precision, recall, F1, accuracy and mean overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def precision_recall_f1(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of ``tp, fp, fn`` and what follows from them."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = (rows.groupBy(*by) if by else rows.groupBy()).agg(total("tp"), total("fp"), total("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = sums.withColumns({"precision": p, "recall": r})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.withColumn("f1", f1)


def grounding(rows: DataFrame, iou: str = "iou", by: list[str] | None = None) -> DataFrame:
    """Queries, accuracy at 0.5 and 0.7, and the mean overlap; a null overlap counts as 0."""
    v = F.coalesce(F.col(iou), F.lit(0.0))
    share = lambda t: F.coalesce(F.avg(F.when(v >= t, 1.0).otherwise(0.0)), F.lit(0.0))
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(
        F.count("*").alias("queries"), share(0.5).alias("acc_0_5"), share(0.7).alias("acc_0_7"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean_iou")
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row per task from prediction rows with ``task`` (null: detection), ``metric<tp,fp,fn,iou>`` and the seconds
    spent; rows without a metric count for time alone."""
    task = F.coalesce(F.nullif(F.col("task"), F.lit("")), F.lit("detection"))
    n = lambda c: F.coalesce(F.sum(F.when(has, F.coalesce(F.col(f"metric.{c}"), F.lit(0)))), F.lit(0)).cast("long").alias(c)
    has = F.col("metric").isNotNull()
    v = F.when(has, F.coalesce(F.col("metric.iou"), F.lit(0.0)))
    sums = rows.groupBy(task.alias("task")).agg(
        F.count("*").alias("samples"), n("tp"), n("fp"), n("fn"), F.coalesce(F.avg((v >= 0.5).cast("double")), F.lit(0.0)).alias("acc_0_5"),
        F.coalesce(F.avg((v >= 0.7).cast("double")), F.lit(0.0)).alias("acc_0_7"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean_iou"), F.sum(F.coalesce(F.col("seconds"), F.lit(0.0))).alias("seconds"),
    )
    rated = sums.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
