"""Hard negatives and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import clustering, hard_negatives

KINDS = "vec_id long, label int, embedding array<double>, id int, Score string"


def awkward(seed: int, n: int, width: int, reach: float) -> list[tuple]:
    """Rows with nulls, no numbers, ties, repeated rows and a vector that many rows have."""
    rng = random.Random(seed)
    common = [rng.uniform(-reach, reach) for _ in range(width)]
    rows = []
    for k in range(n):
        v = common if rng.random() < 0.3 else [rng.choice([-reach, 0.0, reach / 2, rng.uniform(-reach, reach)]) for _ in range(width)]
        rows.append((k, rng.randrange(4), v, k, "x"))
    rows += rows[:5] + [(5, 2, rows[5][2], 0, None)]
    rows += [(n, None, common, 0, ""), (n + 1, 1, None, 0, ""), (n + 2, 1, [None] * width, 0, ""), (n + 3, 1, [math.nan] * width, 0, ""), (n + 4, 1, [math.inf] * width, 0, ""), (None, 1, common, 0, "")]
    return rows


def whole(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def mined(rows: list[tuple], scale: int, every: int, positives: int = 5, negatives: int = 10, window=(30, 90)) -> Counter:
    kept = [(r[0], r[1], [math.floor(scale * x) for x in r[2]]) for r in rows if r[0] is not None and r[1] is not None and whole(r[2])]
    out: Counter = Counter()
    for a, label, v in kept:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, other) for b, other, w in kept]
        for p, b, _ in sorted(s for s in scored if s[2] == label and s[1] != a)[:positives]:
            fits = sorted(s for s in scored if s[2] != label and window[0] * -p <= 100 * -s[0] <= window[1] * -p)
            for rank, (s, c, _) in enumerate(fits[:negatives], 1):
                out[a, b, rank, c, -p, -s] += 1
    return out


@pytest.mark.parametrize(("width", "reach", "scale", "window"), [(3, 1.0, 256, (30, 90)), (5, 3e5, 256, (-50, 90)), (2, 1000.0, 7, (30, 100)), (4, 8e3, 256, (10, 200))])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, width, reach, scale, window):
    for name, n in (("BLOCK", 16), ("ANCHORS", 8), ("FIRST_WAVE", 1), ("MOST_LISTS", 12)):
        monkeypatch.setattr(hard_negatives, name, n)
    rows = awkward(width, 150, width, reach) + [(500, 1, [reach] * (width - 1), 0, "short"), (501, 1, [], 0, "none")]
    out = hard_negatives.mine(spark.createDataFrame(rows, KINDS), F.col("vec_id") % 5 == 0, scale=scale, window=window)
    # a repeated positive gives its negatives once for each of its places; ranks of equal positives don't depend on the place
    assert Counter(tuple(r) for r in out.collect()) == mined(rows, scale, 5, window=window)


def test_anchors_and_blocks_meet_without_a_broadcast(spark, monkeypatch):
    plans, cut = [], hard_negatives.cut

    def seen(df, name, *more):
        if name == "best":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name, *more)

    monkeypatch.setattr(hard_negatives, "cut", seen)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)  # a list has many blocks: what is asked of it grows when they are listed
    out = hard_negatives.mine(spark.createDataFrame(awkward(3, 60, 3, 1.0), KINDS), F.col("vec_id") % 5 == 0)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_fitting_holds_a_bounded_part_of_the_distances():
    x = np.random.default_rng(1).integers(-50, 50, (20_000, 4))
    tracemalloc.start()
    hard_negatives.fit(x, 1024, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


def test_hard_negatives_of_little(spark):
    empty = spark.createDataFrame([], KINDS)
    assert hard_negatives.mine(empty, F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0], 0, ""), (1, 2, [1.0], 0, "")], KINDS)
    assert hard_negatives.mine(one, F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.mine(one, F.lit(None).cast("boolean")).count() == 0
    named = spark.createDataFrame([("b", "x", [2.0]), ("a", "x", [4.0]), ("c", "y", [1.0]), ("d", "y", [1.0])], "vec_id string, label string, embedding array<float>")
    got = hard_negatives.mine(named, F.col("vec_id") == "b", scale=10, window=(0, 100))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [("b", "a", 1, "c", 800, 200), ("b", "a", 2, "d", 800, 200)]
    with pytest.raises(Exception, match="64-bit"):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [4e6] * 3, 0, "")], KINDS), F.col("vec_id") == 0, scale=256)


def clustered(rows: list[tuple], clusters: int, rounds: int, width: int, scale: int):
    kept = [(r[0], [math.floor(scale * x) for x in r[2]]) for r in rows if whole(r[2]) and len(r[2]) == width]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in starts[:clusters]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for _ in range(rounds):
        nearest = [min(range(len(centroids)), key=lambda k: (far(v, centroids[k]), k)) for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), z in zip(kept, nearest) if z == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, *min((far(v, c), k) for k, c in enumerate(centroids))[::-1]) for i, v in kept]
    return Counter(out), centroids


@pytest.mark.parametrize(("width", "reach", "clusters", "n"), [(6, 1.0, 16, 200), (5, 6e4, 7, 120), (3, 0.05, 16, 60), (4, 1.0, 500, 30)])
def test_clusters_are_those_of_brute_force(spark, width, reach, clusters, n):
    rows = [r for r in awkward(width, n, width, reach) if r[0] is not None] + [(900, 1, [1.0] * (width + 1), 0, ""), (901, 1, [], 0, "")]
    data = spark.createDataFrame(rows, KINDS).repartition(5)
    assigned, centroids = clustering.cluster_vectors(data, clusters, 3, width, 64)
    expected, ends = clustered(rows, clusters, 3, width, 64)
    assert Counter(tuple(r) for r in assigned.select("vec_id", "cluster", "distance").collect()) == expected
    assert [r["centroid"] for r in centroids.orderBy("cluster").collect()] == ends
    full = clustering.with_inertia(assigned, centroids).collect()
    assert {r["inertia"] for r in full} == {sum(d * m for (_, _, d), m in expected.items())}
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, ends[r["cluster"]])).encode()).hexdigest() for r in full)
    for k in range(len(ends)):
        assert {r["cluster_inertia"] for r in full if r["cluster"] == k} <= {sum(d * m for (_, z, d), m in expected.items() if z == k)}


def test_clusters_of_nothing_and_without_ids(spark):
    assigned, centroids = clustering.cluster_vectors(spark.createDataFrame([], KINDS), 4, 2, 3)
    assert assigned.count() == centroids.count() == clustering.with_inertia(assigned, centroids).count() == 0
    rows = [(None, 1, [1.0, 2.0], 0, ""), (3, 1, [0.0, 0.0], 0, "")]
    assigned, centroids = clustering.cluster_vectors(spark.createDataFrame(rows, KINDS), 1, 0, 2, 1)
    assert sorted(map(tuple, assigned.collect()), key=str) == [(3, 0, 0), (None, 0, 5)]


def test_bounds_are_never_above_distances_and_screen():
    rng = np.random.default_rng(4)
    for reach in (3, 64, clustering.LIMIT):
        x, c = rng.integers(-reach, reach + 1, (300, 10)), rng.integers(-reach, reach + 1, (16, 10))
        c[:4] //= 8
        screen, short, norms = clustering.Screen(c.tolist()), clustering.compressed(x), (x**2).sum(1)
        far = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        assert (screen.bounds(short, norms) <= far).all()
        best, least = screen.nearest(x, short, norms)
        assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
    x = rng.integers(-64, 65, (2000, 64)) * (rng.random((2000, 16)) < 0.25).repeat(4, axis=1)
    screen = clustering.Screen(x[:16].tolist())
    screen.nearest(x, clustering.compressed(x), (x**2).sum(1))
    assert screen.exact < 0.8 * 16 * len(x)
