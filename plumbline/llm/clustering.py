"""Centroid clustering of integer vectors, exact to the last unit: k-means with block-norm screening.

A vector is cut into segments, and the norms of its segments, rounded up in fixed point, are its compressed form. They are computed
once and stored. By Cauchy-Schwarz ``x . c <= sum |x_s| |c_s|`` over the segments, so

    |x|^2 + |c|^2 - 2 sum |x_s| |c_s|

is never more than the squared distance of ``x`` and ``c``. A pass screens all centroids by this bound, a product of two narrow
matrices of integers; only centroids whose bound is not above the least distance found so far get an exact integer distance. The bound
only rules out centroids that are strictly farther, so ties are decided as without it.

Each round is one pass over the stored rows, whose tasks add up vectors and counts by cluster, and one aggregation of at most
``clusters * dimensions`` sums: what reaches the driver or is sent to tasks has that size, whatever the number of rows or the size of a
cluster.

Nulls and edge cases: rows whose vector is null, has another number of components or a null or non-finite one are left out; rows
without an id take part and come last in the choice of starts; repeated rows count each, and may both be starts; with fewer rows than ``clusters``
every row is a start; an empty table gives an empty result; further columns are dropped. Components beyond 2^22 after scaling are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, drop
from plumbline.llm.vectors import bytes_of_rows, quantised, rows_of_bytes, rows_of_lists, usable

LIMIT = 1 << 22  # of components: bounds, distances and sums of numbers up to this stay below 2^63
SEGMENT = 4  # components a segment
FINE = 4  # segment norms are kept in steps of 2^-FINE


def compressed(x: np.ndarray, segment: int = SEGMENT, fine: int = FINE) -> np.ndarray:
    """The segment norms of each row of ``x``, rounded up to steps of ``2^-fine``, as integers."""
    width = -(-x.shape[1] // segment)
    wide = np.zeros((len(x), width * segment), np.int64)
    wide[:, : x.shape[1]] = x
    squares = (wide.reshape(len(x), width, segment) ** 2).sum(2) << 2 * fine
    root = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    root -= root * root > squares  # a root of a rounded square may be one off
    root += (root + 1) ** 2 <= squares
    return root + (root * root < squares)


class Screen:
    """Centroids of one round with their compressed forms; ``nearest`` assigns the rows of a batch."""

    def __init__(self, centroids: list[list[int]], segment: int = SEGMENT, fine: int = FINE):
        self.c = np.array(centroids, np.int64)
        self.fine, self.norms = fine, (self.c**2).sum(1)
        self.short = compressed(self.c, segment, fine).T.astype(np.float64)
        self.exact = 0  # how many exact distances were computed

    def bounds(self, short: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Integers never above the squared distance of each row and centroid."""
        top = float(short.max(initial=0)) * float(self.short.max(initial=0)) * short.shape[1]
        if top < 2**53:  # every sum of these products is exact
            dots = (short.astype(np.float64) @ self.short).astype(np.int64)
        else:  # one step up in every sum makes up for what rounding loses
            dots = np.ceil(short.astype(np.float64) @ self.short * (1 + 1e-12)).astype(np.int64) + 1
        return norms[:, None] + self.norms[None, :] - ((2 * dots) >> 2 * self.fine) - 1

    def nearest(self, x: np.ndarray, short: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` its nearest centroid, the smaller number on ties, and the squared distance."""
        low = self.bounds(short, norms)
        best = low.argmin(1)
        least = ((x - self.c[best]) ** 2).sum(1)
        self.exact += len(x)
        first = best.copy()
        for k in range(len(self.c)):
            open_ = np.flatnonzero((low[:, k] <= least) & (first != k))
            if not len(open_):
                continue
            self.exact += len(open_)
            d = ((x[open_] - self.c[k]) ** 2).sum(1)
            now = least[open_]
            won = (d < now) | ((d == now) & (k < best[open_]))
            least[open_[won]], best[open_[won]] = d[won], k
        return best, least


def _stored(rows: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``id, vec, short, norm`` of the usable rows, as bytes, written once for all passes."""
    kept = rows.filter(usable(rows[vector_col]) & (F.size(rows[vector_col]) == dimensions))
    kept = kept.select(rows[id_col].alias("id"), quantised(rows[vector_col], scale, LIMIT).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of_lists(batch.column("vec"), dimensions)
            norms = (x.astype(np.int64) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), bytes_of_rows(x), bytes_of_rows(compressed(x).astype("<u4")), pa.array(norms)], names=["id", "vec", "short", "norm"])

    return cut(kept.mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, vec binary, short binary, norm long"), "vectors")


def _matrices(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = -(-dimensions // SEGMENT)
    return rows_of_bytes(batch.column("vec"), dimensions).astype(np.int64), rows_of_bytes(batch.column("short"), width, "<u4"), batch.column("norm").to_numpy()


def _sums(stored: DataFrame, centroids: list[list[int]], dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """By cluster: how many vectors are nearest to it and the sum of each component. Tasks add up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimensions), np.int64)
        for batch in batches:
            x, short, norms = _matrices(batch, dimensions)
            best, _ = screen.nearest(x, short, norms)
            for k in np.unique(best):
                mine = best == k
                count[k] += mine.sum()
                total[k] += x[mine].sum(0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = stored.select("vec", "short", "norm").mapInArrow(run, "cluster int, n long, total array<long>")
    summed = parts.select("cluster", "n", F.posexplode("total").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in summed.collect():  # clusters * dimensions rows at most
        out.setdefault(r["cluster"], (r["n"], [0] * dimensions))[1][r["place"]] = r["x"]
    return out


def start_hash(id_: Column, seed: str = "1") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256)


def _starts(stored: DataFrame, clusters: int, dimensions: int) -> list[list[int]]:
    """The vectors of the ``clusters`` rows whose id hashes lowest; ties by the vector's bytes, so that any order of rows gives the same."""
    first = stored.select("vec", start_hash(F.col("id")).alias("h")).orderBy(F.col("h").asc_nulls_last(), "vec").limit(clusters)
    return [np.frombuffer(bytes(r["vec"]), "<i4").tolist() for r in first.collect()]


def cluster_vectors(rows: DataFrame, clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``(assigned, centroids)``: ``assigned`` has the id, ``cluster`` and squared ``distance`` of every usable row, ``centroids`` a row ``cluster, centroid, size, inertia`` for
    each centroid, empty ones too.

    Components become ``floor(scale * x)``. Starts are the rows with the lowest hashed ids. Each round assigns every vector to its nearest centroid (ties:
    smaller number) and replaces centroids that have vectors by the floored means; then vectors are assigned once more."""
    spark = rows.sparkSession
    stored = _stored(rows, id_col, vector_col, dimensions, scale)
    centroids = _starts(stored, clusters, dimensions)
    for _ in range(rounds if centroids else 0):
        for k, (n, total) in _sums(stored, centroids, dimensions).items():
            centroids[k] = [x // n for x in total]
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids) if centroids else None
        for batch in batches:
            if batch.num_rows:
                best, least = screen.nearest(*_matrices(batch, dimensions))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), pa.array(least)], names=["id", "cluster", "distance"])

    assigned = cut(stored.mapInArrow(run, f"id {kind}, cluster int, distance long"), "assigned")
    drop(stored)
    held = {r["cluster"]: (r["n"], r["d"]) for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("d")).collect()}
    found = [(k, c, *held.get(k, (0, 0))) for k, c in enumerate(centroids)]
    return assigned.withColumnRenamed("id", id_col), spark.createDataFrame(found, "cluster int, centroid array<int>, size long, inertia long")


def with_inertia(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """``assigned`` with its cluster's ``cluster_inertia`` and ``centroid_sha256`` and the whole ``inertia``; ``centroids`` is a
    row a cluster, so broadcasting it costs the same at every size."""
    found = centroids.select(
        "cluster", F.col("inertia").alias("cluster_inertia"), F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256")
    )
    whole = centroids.agg(F.sum("inertia")).first()[0] or 0
    return assigned.join(F.broadcast(found), "cluster").withColumn("inertia", F.lit(whole).cast("long"))
