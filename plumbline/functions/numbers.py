"""Seeds, schedules, digests and array arithmetic, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_seed(key: Column, base: int = 0) -> Column:
    """A seed below 2**31 from a base and the first four bytes of the key's SHA-256."""
    return F.pmod(F.lit(base).cast("long") + F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(1 << 31))


def keyed_id(digest: Column, name: Column, length: int = 24) -> Column:
    """The start of SHA-256 over a digest and a name with a zero byte between."""
    return F.substring(F.sha2(F.concat(digest, F.lit("\0"), name), 256), 1, length)


def warmup_cosine(step: Column, total: int, warmup: int, floor: float = 0.1) -> Column:
    """A learning-rate factor: linear to 1 over ``warmup`` steps, then half a cosine down to ``floor``."""
    progress = F.least(F.lit(1.0), (step - warmup).cast("double") / max(1, total - warmup))
    down = F.lit(floor) + (1.0 - floor) * 0.5 * (1.0 + F.cos(progress * math.pi))
    return F.when(step < warmup, (step + 1).cast("double") / max(1, warmup)).otherwise(down)


def padding(records: Column, batch: int) -> Column:
    return F.pmod(-records, F.lit(batch).cast("long"))


def steps(records: Column, batch: int) -> Column:
    return F.floor((records + padding(records, batch)) / batch).cast("long")


def splice(values: Column, at: Column, inserted: Column) -> Column:
    """``values`` with ``inserted`` before position ``at`` (from 0)."""
    return F.concat(F.slice(values, F.lit(1), at), inserted, F.slice(values, at + 1, F.greatest(F.size(values) - at, F.lit(0))))


def insert_image(ids: Column, labels: Column, positions: Column, image: int, start: int, end: int, n: int, ignore: int = -100) -> Column:
    """A second image's span of ``n`` tokens after the last global one: ids, labels and shifted positions.

    The last image token must be followed by the end token, and ``n`` must be positive; else it is an error."""
    if n <= 0:
        raise ValueError("an inserted image needs a token")
    last = F.size(ids) - F.array_position(F.reverse(ids), image).cast("int")  # from 0; the size if there is none
    at = last + 2
    ok = (F.array_position(ids, image) > 0) & F.coalesce(F.get(ids, last + 1) == end, F.lit(False))
    first = F.get(positions, at - 1) + 1
    span = lambda v, t: F.array_repeat(F.lit(v).cast(t), n + 2)
    kind = "long"
    new_ids = F.concat(F.array(F.lit(start).cast(kind)), F.array_repeat(F.lit(image).cast(kind), n), F.array(F.lit(end).cast(kind)))
    tail = F.transform(F.slice(positions, at + 1, F.greatest(F.size(positions) - at, F.lit(0))), lambda p: F.when(p >= first, p + n + 2).otherwise(p))
    moved = F.concat(F.slice(positions, F.lit(1), at), F.sequence(first, first + n + 1), tail)
    out = F.struct(splice(ids, at, new_ids).alias("ids"), splice(labels, at, span(ignore, kind)).alias("labels"), moved.alias("positions"))
    bad = F.raise_error(F.lit("no global image that an end token follows")).cast("struct<ids:array<bigint>,labels:array<bigint>,positions:array<bigint>>")
    return F.when(F.coalesce(ok, F.lit(False)), out).otherwise(bad)


def left_pad(values: Column, n: Column | int, pad: int) -> Column:
    """A row of ``n`` numbers that ends with ``values``, and the mask of what is real."""
    n = F.lit(n) if isinstance(n, int) else n
    gap = F.greatest(n - F.size(values), F.lit(0))
    return F.struct(F.concat(F.array_repeat(F.lit(pad).cast("long"), gap), values).alias("row"), F.concat(F.array_repeat(F.lit(0), gap), F.transform(values, lambda _: F.lit(1))).alias("mask"))


def soft_argmax(logits: Column, top: int = 5, most: int = 1000) -> Column:
    """The softmax-weighted mean place of the ``top`` largest values (the first on ties), rounded and clamped."""
    order = F.array_sort(F.transform(logits, lambda v, i: F.struct((-v.cast("double")).alias("v"), i.alias("i"))))
    best = F.slice(order, 1, top)
    peak = F.get(best, 0)["v"]
    weight = lambda p: F.exp(peak - p["v"])
    total = F.aggregate(best, F.lit(0.0), lambda a, p: a + weight(p))
    mean = F.aggregate(best, F.lit(0.0), lambda a, p: a + weight(p) * p["i"])
    return F.greatest(F.lit(0), F.least(F.lit(most), F.rint(mean / total).cast("int")))


def windows_2x2(grid: Column, stride: int = 2) -> Column:
    """A grid (rows of cells) as groups of 2 x 2 cells, row by row: disjoint with stride 2, sliding with 1."""
    rows, cols = F.size(grid), F.size(F.get(grid, 0))
    starts = lambda n: F.sequence(F.lit(0), n - 2, F.lit(stride))
    cell = lambda y, x: F.get(F.get(grid, y), x)
    return F.flatten(F.transform(starts(rows), lambda y: F.transform(starts(cols), lambda x: F.array(cell(y, x), cell(y, x + 1), cell(y + 1, x), cell(y + 1, x + 1)))))
