"""Points and boxes as structs of doubles: ``point<x,y>`` and ``box<x1,y1,x2,y2>``. All functions give columns.

Rounding is half-to-even (``rint``) throughout, and the order of operations is part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 1000


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[_c(v).cast("double").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(_c(low), F.least(_c(high), value))


def to_grid(value: Column, extent) -> Column:
    """A pixel coordinate on the grid 0..1000; extents under 1 count as 1."""
    return clamp(F.rint(value / F.greatest(F.lit(1.0), _c(extent).cast("double")) * float(GRID)).cast("int"), 0, GRID)


def from_grid(value: Column, extent) -> Column:
    return value.cast("double") / float(GRID) * _c(extent).cast("double")


def point_to_grid(p: Column, width, height) -> Column:
    return F.struct(to_grid(p["x"], width).alias("x"), to_grid(p["y"], height).alias("y"))


def _window(center_x: Column, center_y: Column, width: Column, height: Column, side: Column) -> Column:
    left = clamp(F.rint(center_x - side / 2.0).cast("int"), 0, width - side)
    top = clamp(F.rint(center_y - side / 2.0).cast("int"), 0, height - side)
    return F.struct(left.alias("x1"), top.alias("y1"), (left + side).alias("x2"), (top + side).alias("y2"))


def crop_around(p: Column, width, height, side: int) -> Column:
    """A square of ``side`` around a pixel point, moved into the image and shrunk to it where the image is smaller."""
    w, h = _c(width).cast("int"), _c(height).cast("int")
    s = F.greatest(F.lit(1), F.least(F.lit(int(side)), w, h))
    return _window(p["x"], p["y"], w, h, s)


def crop_around_grid_point(p: Column, width, height, side: int) -> Column:
    """A square of exactly ``side`` around a grid point; an image that is smaller is an error."""
    w, h = _c(width).cast("int"), _c(height).cast("int")
    s = F.lit(int(side))
    window = _window(from_grid(p["x"], w), from_grid(p["y"], h), w, h, s)
    bad = F.raise_error(F.concat(F.lit("image smaller than the crop: "), w.cast("string"), F.lit("x"), h.cast("string")))
    return F.when((w < s) | (h < s), bad.cast("struct<x1:int,y1:int,x2:int,y2:int>")).otherwise(window)


def resize_point(p: Column, source_w, source_h, out_w, out_h) -> Column:
    one = lambda v: F.greatest(F.lit(1), _c(v).cast("int"))
    return point(p["x"] * one(out_w) / one(source_w), p["y"] * one(out_h) / one(source_h))


def local_to_global(b: Column, crop: Column, local_w, local_h) -> Column:
    one = lambda v: F.greatest(F.lit(1), _c(v).cast("int")).cast("double")
    sx, sy = (crop["x2"] - crop["x1"]) / one(local_w), (crop["y2"] - crop["y1"]) / one(local_h)
    return box(b["x1"] * sx + crop["x1"], b["y1"] * sy + crop["y1"], b["x2"] * sx + crop["x1"], b["y2"] * sy + crop["y1"])


def box_from_grid(b: Column, width, height) -> Column:
    return box(from_grid(b["x1"], width), from_grid(b["y1"], height), from_grid(b["x2"], width), from_grid(b["y2"], height))


def fits_crop(target: Column, crop: Column, width, height) -> Column:
    """Whether a grid box lies in a pixel window, without tolerance."""
    t = box_from_grid(target, width, height)
    return (F.least(t["x1"], t["x2"]) >= crop["x1"]) & (F.greatest(t["x1"], t["x2"]) <= crop["x2"]) & (F.least(t["y1"], t["y2"]) >= crop["y1"]) & (F.greatest(t["y1"], t["y2"]) <= crop["y2"])


def point_in_crop(p: Column, crop: Column, width, height) -> Column:
    """A grid point of the image as a grid point of the window."""
    return F.struct(
        to_grid(from_grid(p["x"], width) - crop["x1"], crop["x2"] - crop["x1"]).alias("x"), to_grid(from_grid(p["y"], height) - crop["y1"], crop["y2"] - crop["y1"]).alias("y")
    )


def box_in_crop(target: Column, crop: Column, width, height) -> Column:
    """A grid box of the image as a grid box of the window; null stays null."""
    w, h = crop["x2"] - crop["x1"], crop["y2"] - crop["y1"]
    xs = [to_grid(from_grid(target[n], width) - crop["x1"], w).alias(n) for n in ("x1", "x2")]
    ys = [to_grid(from_grid(target[n], height) - crop["y1"], h).alias(n) for n in ("y1", "y2")]
    return F.when(target.isNotNull(), F.struct(xs[0], ys[0], xs[1], ys[1]))


def touches_frame(b: Column, width, height, margin: float) -> Column:
    m = max(0.0, float(margin))
    return (b["x1"] <= m) | (b["y1"] <= m) | (b["x2"] >= _c(width).cast("double") - m) | (b["y2"] >= _c(height).cast("double") - m)


def grid_box_touches_margin(b: Column, side: int, margin: float) -> Column:
    return touches_frame(box_from_grid(b, side, side), side, side, margin)


def inside_ordered(p: Column, b: Column) -> Column:
    """Whether an integer point is in a box with ordered corners, borders included."""
    return (b["x1"] <= p["x"]) & (p["x"] <= b["x2"]) & (b["y1"] <= p["y"]) & (p["y"] <= b["y2"])


def inside(p: Column, b: Column) -> Column:
    """Whether a point is in a box whose corners may come in any order, borders included."""
    return p["x"].between(F.least(b["x1"], b["x2"]), F.greatest(b["x1"], b["x2"])) & p["y"].between(F.least(b["y1"], b["y2"]), F.greatest(b["y1"], b["y2"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    side = lambda low, high: F.greatest(F.lit(0.0), high - low)
    inter = side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    union = side(a["x1"], a["x2"]) * side(a["y1"], a["y2"]) + side(b["x1"], b["x2"]) * side(b["y1"], b["y2"]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def center_on_grid(b: Column, width, height) -> Column:
    """A box's centre on the grid, not clamped."""
    return F.struct(
        F.rint((b["x1"] + b["x2"]) / 2 / _c(width) * GRID).cast("int").alias("x"), F.rint((b["y1"] + b["y2"]) / 2 / _c(height) * GRID).cast("int").alias("y")
    )


def valid_box(values: Column) -> Column:
    """Whether an array of doubles is four finite numbers of a box with some area."""
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(values) == 4) & finite & (F.get(values, 2) > F.get(values, 0)) & (F.get(values, 3) > F.get(values, 1)), F.lit(False))


def patch_window(p: Column, grid_h: Column, grid_w: Column, side_pixels: int, patch: int) -> Column:
    """The window of patches around a grid point: first row and column, rows and columns, and its size in pixels."""
    side = F.greatest(F.lit(2), F.rint(F.lit(side_pixels / patch)).cast("int"))
    h, w = F.least(side, grid_h), F.least(side, grid_w)
    at = lambda v, n: clamp(F.floor(clamp(v.cast("double"), 0.0, 1000.0) * n / float(GRID)).cast("int"), 0, n - 1)
    y = clamp(at(p["y"], grid_h) - F.floor(h / 2).cast("int"), 0, grid_h - h)
    x = clamp(at(p["x"], grid_w) - F.floor(w / 2).cast("int"), 0, grid_w - w)
    return F.struct(y.alias("y"), x.alias("x"), h.alias("h"), w.alias("w"), (h * patch).alias("pixels_h"), (w * patch).alias("pixels_w"))


def patches(grid: Column) -> Column:
    """The number of patches of a grid of any rank: the product of its extents."""
    return F.aggregate(grid, F.lit(1).cast("long"), lambda a, x: a * x)
