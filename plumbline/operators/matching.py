"""Suppression and one-to-one matching of boxes: folds over the arrays of one image.

Groups are one image (or one image and class), so they stay small; the folds need no shuffle beyond the grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions.once import once
from plumbline.functions.text import canonical_label

_INTS = "cast(array() as array<int>)"


def suppress(boxes: Column, threshold: float) -> Column:
    """Class-wise non-maximum suppression: classes in order of appearance, within a class by falling score (ties in input
    order); a box goes if it overlaps a kept one of its class by ``threshold`` or more. Boxes: ``label, box, score``."""
    named = F.transform(boxes, lambda b, i: F.struct(canonical_label(b["label"]).alias("c"), i.alias("i"), (-F.coalesce(b["score"], F.lit(1.0)).cast("double")).alias("s")))

    def ranked(rows: Column) -> Column:
        classes = F.array_distinct(F.transform(rows, lambda x: x["c"]))
        return once(classes, lambda cs: F.array_sort(F.transform(rows, lambda x: F.struct(F.array_position(cs, x["c"]).alias("r"), x["s"].alias("s"), x["i"].alias("i")))))

    def fold(order: Column) -> Column:
        def step(kept: Column, x: Column) -> Column:
            mine = F.get(boxes, x["i"])["box"]
            hit = F.exists(kept, lambda k: (k["r"] == x["r"]) & (g.iou(F.get(boxes, k["i"])["box"], mine) >= threshold))
            return F.when(hit, kept).otherwise(F.concat(kept, F.array(F.struct(x["r"].alias("r"), x["i"].alias("i")))))

        start = F.expr("cast(array() as array<struct<r:bigint,i:int>>)")
        return F.transform(F.aggregate(order, start, step), lambda k: F.get(boxes, k["i"]))

    return once(once(named, ranked), fold)


def _named(items: Column) -> Column:
    """Each item ``v`` with the canonical form ``c`` of its label: labels that differ in case, underscores or spaces, or are null and empty, are one class."""
    return F.transform(items, lambda x: F.struct(canonical_label(x["label"]).alias("c"), x.alias("v")))


def _fold(items: Column, targets: Column, choose) -> Column:
    """``tp, fp, fn`` of greedy matching: each item in turn takes the unmatched target that ``choose`` gives (or none)."""
    start = F.struct(F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.expr(_INTS).alias("used"))

    def step(a: Column, item: Column) -> Column:
        def with_choice(c: Column) -> Column:
            return F.struct(
                (a["tp"] + F.when(c.isNotNull(), 1).otherwise(0)).alias("tp"), (a["fp"] + F.when(c.isNull(), 1).otherwise(0)).alias("fp"),
                F.when(c.isNull(), a["used"]).otherwise(F.concat(a["used"], F.array(c))).alias("used"),
            )

        return once(choose(a["used"], item), with_choice)

    return F.aggregate(items, start, step, lambda a: F.struct(a["tp"].alias("tp"), a["fp"].alias("fp"), (F.size(targets) - F.size(a["used"])).alias("fn")))


def detection_counts(targets: Column, predictions: Column, threshold: float = 0.5) -> Column:
    """Each prediction in turn takes the unmatched target of its class with the largest overlap of at least ``threshold``;
    among equal overlaps the one that comes last. Both arrays: ``label, box``."""

    def fold(named: Column) -> Column:
        def choose(used: Column, p: Column) -> Column:
            scored = F.transform(named, lambda t, i: F.struct(F.when(t["c"] == p["c"], g.iou(p["v"]["box"], t["v"]["box"])).alias("v"), i.alias("i")))
            return F.array_max(F.filter(scored, lambda s: (s["v"] >= threshold) & ~F.array_contains(used, s["i"])))["i"]

        return _fold(_named(predictions), named, choose)

    return once(_named(targets), fold)


def pointing_counts(targets: Column, points: Column) -> Column:
    """Each point in turn takes the first unmatched target of its class that it lies in."""

    def fold(named: Column) -> Column:
        def choose(used: Column, p: Column) -> Column:
            at = F.transform(named, lambda t, i: F.when((t["c"] == p["c"]) & g.inside(p["v"]["point"], t["v"]["box"]), i))
            return F.get(F.filter(at, lambda i: i.isNotNull() & ~F.array_contains(used, i)), 0)

        return _fold(_named(points), named, choose)

    return once(_named(targets), fold)


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, left_id: str, right_id: str) -> DataFrame:
    """Pairs with equal keys (image and class) whose boxes overlap by ``threshold`` or more: an equi-join with a residual
    predicate, never a nested loop."""
    a = left.select(*keys, F.col(left_id).alias("left_id"), F.col("box").alias("_a"))
    b = right.select(*keys, F.col(right_id).alias("right_id"), F.col("box").alias("_b"))
    scored = a.join(b, keys).withColumn("iou", g.iou(F.col("_a"), F.col("_b")))
    return scored.filter(F.col("iou") >= threshold).drop("_a", "_b")
