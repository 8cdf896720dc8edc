"""Hard negatives of anchors by exact integer inner products, searched in k-means inverted lists.

Index. Centroids are fitted on a bounded sample (``SAMPLE`` rows); every row then goes to the list of its nearest centroid, and each list's radius (the
largest distance of its rows from the centroid) is stored. Lists are cut into blocks of about ``BLOCK`` rows at random, so a list
that holds a third of all rows is many blocks.

Search. For an anchor ``a`` and a list with centroid ``c`` and radius ``r``, Cauchy-Schwarz bounds every score in the list by ``a.c - |a| r`` and
``a.c + |a| r``. Lists are visited by falling upper bound in waves that grow fourfold. A list is skipped if its bounds miss the window, and a window is finished
when the bound falls strictly below its kth score so far; equal scores are still visited, because a smaller id
could win. Each wave joins the anchors with the blocks of the lists that they still need, scores each pair of blocks by one matrix product and
keeps the best ``k`` of each window. Bounds that prune nothing cost time; they never cost results. The driver gets the sample and
a row a list, both bounded; anchors and blocks meet by a shuffle, never by a broadcast.

Positives are one window without limits over rows of the anchor's label; negatives have one window a positive over the others.

Sums of products of integers are exact as 32-bit floats where the largest ``|a| |x|`` is below 2^24, as doubles below 2^53; beyond it, 64-bit integers are
used, and an error is raised where these could overflow.

Nulls and edge cases: rows with a null id, label or vector or a null or non-finite component take no part; vectors shorter than
the longest count as filled up with zeros; repeated rows each take a place, and a repeated anchor row gives its rows again; rows with the anchor's own id are
never its positives; ties go to the smaller id; anchors without a positive and positives without a negative give no rows; an empty
table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, drop
from plumbline.llm.vectors import bytes_of_rows, quantised, rows_of_bytes, rows_of_lists, usable

SAMPLE = 20_000  # rows that centroids are fitted on, about
SAMPLE_NUMBERS = 1 << 22  # and numbers in them: wide vectors give fewer rows
FIT_CELLS = 1 << 21  # distances of rows from centroids that are held at once
MOST_LISTS = 2_048  # with SAMPLE, it bounds what the driver fits and sends to tasks
BLOCK = 2_048  # rows of a block of a list, about
ANCHORS = 256  # anchors of a block, about
FIRST_WAVE = 8
LIMIT = (1 << 31) - 1
LOWEST, HIGHEST = -(1 << 62), 1 << 62


class Lists:
    """What the search knows of the inverted lists: centroids, radii and the number of blocks of each."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray, blocks: np.ndarray, kind: str):
        self.centroids, self.radii, self.blocks, self.kind = centroids, radii, blocks, kind

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No score of a row of ``a`` with a row of a list lies outside; what floating point may lose is added on both sides."""
        a = a.astype(np.float64)
        size = np.sqrt((a**2).sum(1))[:, None]
        middle, reach = a @ self.centroids.T, size * self.radii[None, :]
        slack = 1e-9 * (size * (np.sqrt((self.centroids**2).sum(1)) + self.radii)[None, :] + 1)
        return middle - reach - slack, middle + reach + slack


def fit(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the sample ``x`` by k-means from evenly spaced rows."""
    x = x.astype(np.float32)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    step = max(1, FIT_CELLS // k)
    for _ in range(rounds):
        norms = (c**2).sum(1)[None, :]
        nearest = np.concatenate([(norms - 2 * (x[a : a + step] @ c.T)).argmin(1) for a in range(0, len(x), step)])
        order = np.argsort(nearest, kind="stable")
        some, first = np.unique(nearest[order], return_index=True)
        c[some] = np.add.reduceat(x[order].astype(np.float64), first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return c.astype(np.float64)


def _index(rows: DataFrame, width: int, n: int, kind: str) -> tuple[DataFrame, Lists]:
    """Inverted lists of all rows (``id, label, vec``): a table of blocks and what the search knows of them."""
    some = min(SAMPLE, max(1, SAMPLE_NUMBERS // max(1, width)))
    sample = rows.select("vec").sample(min(1.0, some / n), seed=7).limit(2 * some).toArrow()["vec"].combine_chunks()
    sample = rows_of_bytes(sample, width) if len(sample) else np.zeros((1, width), np.int32)
    centroids = fit(sample, int(min(MOST_LISTS, len(sample), max(1, np.sqrt(n) / 2))))
    norms, step = (centroids**2).sum(1), max(1, FIT_CELLS // len(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of_bytes(batch.column("vec"), width).astype(np.float64)
            for a in range(0, len(x), step):
                part = x[a : a + step]
                nearest = (norms[None, :] - 2 * (part @ centroids.T)).argmin(1)
                away = np.sqrt(((part - centroids[nearest]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(part)).columns, pa.array(nearest.astype(np.int32)), pa.array(away)], names=["id", "label", "vec", "list", "away"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    assigned = cut(rows.mapInArrow(assign, f"{kinds}, list int, away double"), "assigned")
    held = assigned.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many"), F.max("away").alias("radius"))  # MOST_LISTS rows at most
    radii, blocks = np.zeros(len(centroids)), np.zeros(len(centroids), np.int32)
    for r in held.collect():
        radii[r["list"]], blocks[r["list"]] = r["radius"] * (1 + 1e-9), r["many"]
    dealt = assigned.join(F.broadcast(held), "list").withColumn("block", F.floor(F.rand(11) * F.col("many")).cast("int"))
    stored = cut(dealt.groupBy("list", "block").agg(F.collect_list(F.struct("id", "label", "vec")).alias("rows")), "lists")
    drop(assigned)
    return stored, Lists(centroids, radii, blocks, kind)


def _asks(anchors: DataFrame, lists: Lists, width: int, first: int, last: int) -> DataFrame:
    """Which blocks each anchor needs in this wave: ``list, block`` with the anchors (``aid, id, label, vec`` and the windows ``low, high``), in blocks of bounded size.

    ``low`` of a window is already its kth score, if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lo, up = lists.bounds(rows_of_bytes(batch.column("vec"), width))
            low, high = batch.column("low"), batch.column("high")
            per = int(low.offsets[1].as_py() - low.offsets[0].as_py())
            low, high = (c.flatten().to_numpy().astype(np.float64).reshape(-1, per) for c in (low, high))
            order = np.argsort(-up, axis=1, kind="stable")[:, first:last]
            up, lo = np.take_along_axis(up, order, 1), np.take_along_axis(lo, order, 1)
            needed = ((up[:, None, :] >= low[:, :, None]) & (lo[:, None, :] <= high[:, :, None]) & (low <= high)[:, :, None]).any(1) & (lists.blocks[order] > 0)
            who, what = np.nonzero(needed)
            for a in range(0, len(who), 20_000):
                some = slice(a, a + 20_000)
                wanted = order[who[some], what[some]]
                taken = batch.take(pa.array(who[some]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(wanted.astype(np.int32)), pa.array(lists.blocks[wanted])], names=[*batch.schema.names, "list", "many"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    asked = anchors.mapInArrow(run, f"{kinds}, list int, many int")
    blocks = asked.groupBy("list", "part").agg(F.first("many").alias("many"), F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
    return blocks.select("list", F.explode(F.expr("sequence(0, many - 1)")).alias("block"), "anchors")


def _scored(pairs: DataFrame, width: int, kind: str, k: int, same: bool, id_kind: str) -> DataFrame:
    """The best ``k`` of each window of each anchor in each pair of blocks: ``aid, w, score, other``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                a, b = batch.column("anchors").slice(n, 1).flatten(), batch.column("rows").slice(n, 1).flatten()
                x, y = (rows_of_bytes(c.field("vec"), width).astype(kind) for c in (a, b))
                scores = (x @ y.T).astype(np.int64)
                mine, theirs = a.field("label").to_numpy(zero_copy_only=False), b.field("label").to_numpy(zero_copy_only=False)
                ids = b.field("id").to_numpy(zero_copy_only=False)
                by_id = np.unique(ids, return_inverse=True)[1]
                fits = (mine[:, None] == theirs[None, :]) == same
                if same:
                    fits &= a.field("id").to_numpy(zero_copy_only=False)[:, None] != ids[None, :]
                per = len(a.field("low")[0])
                low, high = (a.field(c).flatten().to_numpy().reshape(-1, per) for c in ("low", "high"))
                fits &= (scores >= low.min(1)[:, None]) & (scores <= high.max(1)[:, None])
                who, what = np.nonzero(fits)
                found = scores[who, what]
                order = np.lexsort((by_id[what], -found, who))
                who, what, found = who[order], what[order], found[order]
                out = []
                for w in range(per):
                    inside = np.flatnonzero((found >= low[who, w]) & (found <= high[who, w]))
                    first = np.searchsorted(who[inside], who[inside])
                    inside = inside[np.arange(len(inside)) - first < k]
                    out.append((who[inside], np.full(len(inside), w, np.int32), found[inside], what[inside]))
                who, w, found, what = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([a.field("aid").take(pa.array(who)), pa.array(w), pa.array(found), b.field("id").take(pa.array(what))], names=["aid", "w", "score", "other"])

    return pairs.select("anchors", "rows").mapInArrow(run, f"aid long, w int, score long, other {id_kind}")


def _search(stored: DataFrame, lists: Lists, anchors: DataFrame, width: int, k: int, same: bool, id_kind: str) -> DataFrame:
    """``aid, w, rank, score, other``: the first ``k`` rows of each window of each anchor. ``anchors``: a table ``aid, part, id, label, vec, low, high``."""
    best, first, size = None, 0, FIRST_WAVE
    while first < len(lists.blocks):
        now = anchors
        if best is not None:
            # a window that is full may only change by scores from its kth on
            full = best.groupBy("aid", "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
            full = full.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("kth"))
            now = anchors.join(full.hint("merge"), "aid", "left")
            raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), F.lit(LOWEST))))
            now = now.withColumn("low", F.coalesce(raised, "low")).select(anchors.columns)
        asked = _asks(now, lists, width, first, first + size)
        # merged, whatever Spark expects: it doesn't see how many rows the blocks of a list make, and would send them all through the driver
        found = _scored(asked.hint("merge").join(stored, ["list", "block"]), width, lists.kind, k, same, id_kind)
        both = found if best is None else found.unionByName(best.drop("rank"))
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("aid", "w").orderBy(F.col("score").desc(), "other"))).filter(F.col("rank") <= k)
        last, best = best, cut(ranked, "best")
        if last is not None:
            drop(last)
        first, size = first + size, size * 4
    return best


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; scores are integer inner products, higher ones first, ties by the smaller id. The positives of a row for
    which ``anchors`` holds are its first ``positives`` other rows of the same label; for each, the first ``negatives`` rows of other labels with
    ``window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score`` are returned."""
    vec = rows[vector_col]
    rows = rows.filter(rows[id_col].isNotNull() & rows[label_col].isNotNull() & usable(vec)).select(
        rows[id_col].alias("id"), rows[label_col].alias("label"), quantised(vec, scale, LIMIT).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor")
    )
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.max(square).alias("square")).first()
    n, width, square = seen["n"], seen["width"] or 0, seen["square"] or 0.0
    if not n:
        kinds = (rows.schema["id"].dataType.simpleString(),) * 3
        return rows.sparkSession.createDataFrame([], "anchor_id {}, positive_id {}, rank int, negative_id {}, positive_score long, negative_score long".format(*kinds))
    if square >= 2**55:
        raise ValueError("inner products of these vectors don't fit 64-bit integers")
    kind = "float32" if square < 2**24 else "float64" if square < 2**53 else "int64"
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    wide = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0), F.lit(width) - F.size("vec"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], bytes_of_rows(rows_of_lists(batch.column("vec"), width))], names=["id", "label", "anchor", "vec"])

    packed = cut(wide.select("id", "label", "anchor", "vec").mapInArrow(pack, f"id {id_kind}, label {label_kind}, anchor boolean, vec binary"), "rows")
    asking = packed.filter("anchor").select("id", "label", "vec").withColumn("aid", F.monotonically_increasing_id())
    asking = cut(asking.withColumn("part", F.expr(f"aid div {ANCHORS}")), "anchors")  # read again, the numbers stay what they are
    stored, lists = _index(packed.select("id", "label", "vec"), width, n, kind)
    open_ = asking.withColumn("low", F.array(F.lit(LOWEST))).withColumn("high", F.array(F.lit(HIGHEST)))
    near = _search(stored, lists, open_, width, positives, True, id_kind)
    near = near.select("aid", (F.col("rank") - 1).alias("w"), F.col("score").alias("positive_score"), F.col("other").alias("positive_id"))
    edges = near.withColumn("x", -window[0] * F.col("positive_score")).withColumn("y", window[1] * F.col("positive_score"))
    edges = edges.selectExpr("aid", "w", "-((x - pmod(x, 100)) div 100) AS low", "(y - pmod(y, 100)) div 100 AS high")
    filled = F.array_repeat(F.struct(F.lit(0).alias("w"), F.lit(HIGHEST).alias("low"), F.lit(LOWEST).alias("high")), F.lit(positives) - F.size("e"))  # these let nothing in
    edges = edges.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("e")).withColumn("e", F.concat("e", filled))
    limited = asking.join(edges.select("aid", F.col("e.low").alias("low"), F.col("e.high").alias("high")).hint("merge"), "aid")
    far = _search(stored, lists, cut(limited.select(open_.columns), "limited"), width, negatives, False, id_kind)
    far = far.select("aid", "w", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    out = far.join(near.hint("merge"), ["aid", "w"]).join(asking.select("aid", F.col("id").alias("anchor_id")).hint("merge"), "aid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
