"""Next-fit packing in a declared order: a new pack starts where the next item would exceed the target.

``next_fit_array`` folds over one array, for groups that a row may hold; for groups of any size there is ``ordered.next_fit``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_fit_array(sizes: Column, target: int) -> Column:
    """The pack number of each item of an array of sizes."""
    start = F.struct(F.lit(0).alias("pack"), F.lit(0).cast("long").alias("held"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(a: Column, size: Column) -> Column:
        new = (a["held"] > 0) & (a["held"] + size > target)
        pack = F.when(new, a["pack"] + 1).otherwise(a["pack"])
        return F.struct(pack.alias("pack"), (F.when(new, F.lit(0)).otherwise(a["held"]) + size).cast("long").alias("held"), F.concat(a["out"], F.array(pack)).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])
