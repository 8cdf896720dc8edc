"""Golden values of the scalar functions and folds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions import numbers as n
from plumbline.functions import text as t
from plumbline.operators import expand, matching


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ints(*v):
    return F.struct(*[F.lit(x).alias(k) for k, x in zip(("x", "y") if len(v) == 2 else ("x1", "y1", "x2", "y2"), v)])


def test_crops(spark):
    around = lambda p, w, h, side: tuple(value(spark, g.crop_around(p, F.lit(w), F.lit(h), side)))
    assert around(g.point(7, 90), 200, 95, 40) == (0, 55, 40, 95)  # moved into the image at two sides
    assert around(g.point(50.5, 30), 200, 95, 41) == (30, 10, 71, 51)  # a half goes to the even side
    assert around(g.point(3, 44), 20, 90, 41) == (0, 34, 20, 54)  # shrunk to the image
    assert tuple(value(spark, g.crop_around_grid_point(ints(0, 500), F.lit(640), F.lit(480), 100))) == (0, 190, 100, 290)
    with pytest.raises(Exception, match="smaller than the crop"):
        value(spark, g.crop_around_grid_point(ints(9, 9), F.lit(640), F.lit(99), 100))


def test_local_to_global(spark):
    b = value(spark, g.local_to_global(g.box(8, 4, 100, 40), ints(10, 20, 60, 120), 200, 400))
    assert tuple(b) == (12.0, 21.0, 35.0, 30.0)


def test_rounding_is_half_even(spark):
    assert value(spark, g.to_grid(F.lit(2.5), 1000)) == 2
    assert value(spark, g.to_grid(F.lit(3.5), 1000)) == 4
    assert value(spark, g.to_grid(F.lit(-5.0), 0)) == 0


def test_parse_points(spark):
    answer = "<ref>Crane</ref><box><7><8></box><ref>tug_boat </ref><box><10><20><31><40></box><box><7><8></box><box><7><8></box>"
    found = [(p["label"], p["nx"], p["ny"], p["source"]) for p in value(spark, t.parse_points(F.lit(answer), 500, 2000))]
    assert found == [("crane", 7, 8, "point"), ("tug boat", 20, 30, "box_center_fallback"), ("tug boat", 7, 8, "point")]
    assert value(spark, t.parse_points(F.lit("no tokens <box><5><5></box> <ref>late</ref>"), 10, 10)) == []


def test_single_box(spark):
    two = "<ref>a</ref><box><1><2><30><40></box><box><5><6><70><80></box>"
    with pytest.raises(Exception, match="several boxes"):
        value(spark, t.parse_single_box(F.lit(two), F.lit("A"), 10, 10))
    assert value(spark, t.parse_single_box(F.lit("<ref>a</ref><box><9><9><9><9></box>"), F.lit("a"), 10, 10)) is None


def boxes(rows):
    return F.array(*[F.struct(F.lit(lab).alias("label"), g.box(*b).alias("box"), F.lit(1.0).alias("score")) for lab, b in rows])


def test_suppress_and_match(spark):
    rows = [("tug", (0, 0, 8, 6)), ("barge", (1, 0, 9, 6)), ("TUG", (1, 0, 9, 6)), ("tug", (5, 0, 13, 6))]
    kept = value(spark, matching.suppress(boxes(rows), 0.6))
    assert [(k["label"], k["box"]["x1"]) for k in kept] == [("tug", 0.0), ("tug", 5.0), ("barge", 1.0)]  # 42 / 54 goes, 18 / 78 stays
    targets = boxes([("tug", (0, 0, 8, 6)), ("tug", (5, 0, 13, 6)), ("crane", (0, 0, 8, 6))])
    assert tuple(value(spark, matching.detection_counts(targets, boxes(rows)))) == (2, 2, 1)


def test_pointing(spark):
    targets = boxes([("tug", (0, 0, 4, 4)), ("tug", (3, 3, 9, 9)), ("barge", (0, 0, 99, 99))])
    points = F.array(*[F.struct(F.lit(lab).alias("label"), g.point(x, x).alias("point")) for lab, x in (("tug", 3.5), ("tug", 1), ("tug", 9), ("barge", 100))])
    assert tuple(value(spark, matching.pointing_counts(targets, points))) == (2, 2, 1)


def test_prefix_free_arrays(spark):
    out = value(spark, n.left_pad(F.array(F.lit(7).cast("long")), 3, 0))
    assert (out["row"], out["mask"]) == ([0, 0, 7], [0, 0, 1])
    grid = F.array(*[F.array(*[F.lit(3 * y + x) for x in range(3)]) for y in range(3)])
    assert value(spark, n.windows_2x2(grid, 1)) == [[0, 1, 3, 4], [1, 2, 4, 5], [3, 4, 6, 7], [4, 5, 7, 8]]


def address(spark, point, target):
    """On 1500 x 900 pixels: the crop around the grid point (300, 700) is 378 to 522 by 558 to 702."""
    box = ints(*target) if target else F.lit(None).cast(expand.GRID_BOX)
    return spark.range(1).select(
        F.lit("q7").alias("record_id"), F.lit("tug boat").alias("reference"), ints(*point).alias("point"), box.alias("target"), F.lit("p.png").alias("image"), F.lit(1500).alias("width"), F.lit(900).alias("height")
    )


@pytest.mark.parametrize(
    ("target", "rows", "answer", "reason"),
    [
        ((270, 660, 330, 740), 1, "<box><188><250><812><750></box>", None),
        (None, 2, "<box>None</box>", expand.NEGATIVE),
        ((100, 500, 600, 900), 2, "<box>None</box>", expand.NOT_CONTAINED),
        ((251, 660, 330, 740), 2, "<box>None</box>", expand.NOT_CONTAINED),  # 376.5 pixels
        ((252, 660, 330, 740), 2, "<box><0><250><812><750></box>", expand.TOUCHES_MARGIN),  # 378 pixels
    ],
)
def test_expansion(spark, target, rows, answer, reason):
    out = sorted(expand.expand_addresses(address(spark, (300, 700), target)).collect(), key=lambda r: r["route"], reverse=True)
    assert [r["record_id"] for r in out] == ["q7__local", "q7__global_fallback"][:rows]
    assert out[0]["answer"] == answer and {r["fallback_reason"] for r in out} == {reason}


def test_expansion_refuses(spark):
    with pytest.raises(Exception, match="outside its target"):
        expand.expand_addresses(address(spark, (10, 10), (11, 5, 20, 20))).collect()
