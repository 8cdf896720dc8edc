"""Connected components of a graph of links, in DataFrame operations alone.

First each block of links is contracted on its own. Then alternating large-star and small-star steps: every step turns the links of a node towards the least node that it knows,
until each component is a star around its least node. A step is two aggregations and two joins on the links; each round is
written to the shared folder, so lineage stays short. Hubs cost nothing extra: minima are pre-aggregated, and the joins
carry two numbers a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, drop


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``node, component``: for every node that has a link to another, the least node it is connected with. Null ends are
    ignored, as are links from a node to itself; repeated links count once."""
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    every = cut(now.distinct(), "links")
    now = cut(_contracted(every), "links")
    drop(every)
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        last, now = now, cut(small, "links")
        drop(last)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _contracted(links: DataFrame, block: int = 400_000) -> DataFrame:
    """The same components with fewer links: each block of links, dealt at random, becomes stars (a union-find of bounded
    size), so a group that is densely linked is left with a link for each of its nodes and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        stars = [(x, root(x)) for x in list(up)]
        stars = [(x, r) for x, r in stars if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], names=["u", "v"])

    return links.repartition(max(1, -(-links.count() // block))).mapInArrow(run, "u long, v long").distinct()


def _mark(links: DataFrame) -> tuple:
    """Two equal sets of links have the same mark."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
