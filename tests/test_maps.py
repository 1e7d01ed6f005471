"""Straight maps of places, shapes between slices, blurs along three axes and composite regions against brute force."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from planespark.operators import combine, metadata, resample, shapes, stencils, volumes
from planespark.operators import thresholds as T

RANDOM = np.random.default_rng(11)


def voxels(spark, a):
    rows = [(1, z, x, y, float(a[z, y, x])) for z, y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "image_id int, z int, x int, y int, v double").repartition(3)


def array(df, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[column]
    return out


def cubic(t):
    t = abs(t)
    return 1.5 * t**3 - 2.5 * t * t + 1 if t < 1 else -0.5 * t**3 + 2.5 * t * t - 4 * t + 2


def value(a, u, v, background):
    h, w = a.shape
    if not (-1 <= u < w and -1 <= v < h):
        return background
    i, j = int(np.floor(u)), int(np.floor(v))
    if 0 < i < w - 2 and 0 < j < h - 2:
        return sum(a[j + q, i + p] * cubic(u - i - p) * cubic(v - j - q) for p in (-1, 0, 1, 2) for q in (-1, 0, 1, 2))
    u, v = (0.0 if n == 1 or at < 0 else n - 1.001 if at >= n - 1 else at for at, n in ((u, w), (v, h)))
    i, j = int(u), int(v)
    return sum(a[min(j + q, h - 1), min(i + p, w - 1)] * (1 - abs(u - i - p)) * (1 - abs(v - j - q)) for p in (0, 1) for q in (0, 1))


@pytest.mark.parametrize("shape,new", [((1, 1), (3, 2)), ((7, 70), (90, 9)), ((80, 6), (5, 33))])
def test_mapped(spark, shape, new):
    a = RANDOM.integers(0, 256, shape).astype(float)
    source = (0.8, -0.3, 1.1, 0.25, 0.9, -2.3)
    px = voxels(spark, a[None])
    got = array(resample.mapped(px, ["image_id", "z"], shape[::-1], new, source, background=9, top=None), (1, *new[::-1]))[0]
    want = [[value(a, 0.8 * x - 0.3 * y + 1.1, 0.25 * x + 0.9 * y - 2.3, 9) for x in range(new[0])] for y in range(new[1])]
    assert np.allclose(got, want)
    same = array(resample.resized(px, ["image_id", "z"], shape[::-1], shape[::-1]), (1, *shape))[0]
    assert (same[:-1, :-1] == a[:-1, :-1]).all()  # the last row and column are held a thousandth short


def chamfer(on):
    """Signed distances by a shortest-way search from the outline and what lies just outside it."""
    h, w = on.shape
    wide = np.pad(on, 1)
    k = sum(wide[1 + j : h + 1 + j, 1 + i : w + 1 + i].astype(int) for j in (-1, 0, 1) for i in (-1, 0, 1))
    best = np.full(on.shape, 10**6)
    heap = [(0 if on[p] else 1, p) for p in np.ndindex(on.shape) if (on[p] and k[p] < 9) or (not on[p] and k[p] > 0)]
    heapq.heapify(heap)
    while heap:
        d, (y, x) = heapq.heappop(heap)
        if d < best[y, x]:
            best[y, x] = d
            for dy, dx, s in ((0, 1, 3), (0, -1, 3), (1, 0, 3), (-1, 0, 3), (1, 1, 4), (-1, -1, 4)):
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    heapq.heappush(heap, (d + s, (y + dy, x + dx)))
    return np.where(on, best, -best)


def test_shapes_between(spark):
    a = np.zeros((6, 9, 12))
    a[1, 2:7, 1:5], a[4, 3:9, 6:12], a[4, 0, 0] = 1, 1, 1
    got = array(shapes.between(voxels(spark, a), ["image_id"], F.col("v") > 0), a.shape)
    below, above = chamfer(a[1] > 0), chamfer(a[4] > 0)
    for z in range(6):
        want = a[z] > 0 if z in (0, 1, 4, 5) else below * (4 - z) + above * (z - 1) >= 0
        assert (got[z] == np.where(want, 255, 0)).all()
    noisy = RANDOM.random((1, 10, 13)) < 0.5
    assert (array(shapes.signed_distance(voxels(spark, noisy), ["image_id", "z"], F.col("v") > 0), noisy.shape, "d")[0] == chamfer(noisy[0])).all()
    assert shapes.between(voxels(spark, a[:1]), ["image_id"], F.col("v") > 0).where("v > 0").isEmpty()


def test_gaussian_3d(spark):
    a = RANDOM.random((4, 5, 6))
    got = array(volumes.gaussian3d(voxels(spark, a), ["image_id"], (1.2, 0.6, 0.9)), a.shape)
    want = a
    for axis, sigma in ((2, 1.2), (1, 0.6), (0, 0.9)):
        k = stencils.gaussian_kernel(sigma)
        r = len(k) // 2
        places = np.arange(a.shape[axis])
        want = sum(w * np.take(want, np.clip(places + d - r, 0, len(places) - 1), axis) for d, w in enumerate(k))
    assert np.allclose(got, want)
    assert np.allclose(array(volumes.gaussian3d(voxels(spark, a), ["image_id"], (0, 0, 0)), a.shape), a)


def test_composites_and_their_parts(spark):
    px = spark.range(400).select(F.lit(1).alias("image_id"), (F.col("id") % 20).cast("int").alias("x"), (F.col("id") / 20).cast("int").alias("y"))
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = [(1, 1, [square(1.0, 13.0), square(4.0, 8.0), [(0.0, 0.0)]]), (1, 2, []), (1, 3, [square(30.0, 40.0)])]
    rois = spark.createDataFrame(rows, "image_id int, roi_id int, parts array<array<struct<x double, y double>>>")
    got = {(r.roi_id, r.x, r.y) for r in combine.inside_composites(px, rois).collect()}
    assert got == {(1, x, y) for x in range(1, 13) for y in range(1, 13) if not (4 <= x < 8 and 4 <= y < 8)}
    assert [(r.roi_id, r.part, len(r.points)) for r in combine.split(rois).orderBy("roi_id", "part").collect()] == [(1, 0, 4), (1, 1, 4), (1, 2, 1), (3, 0, 4)]


def test_slices_by_number(spark):
    rows = [(1, 10, 3), (1, 20, 1), (1, 30, 3), (2, 10, 5), (2, 20, None)]
    got = metadata.sorted_slices(spark.createDataFrame(rows, "series int, at int, number int"), ["series"], "at", "number")
    assert {(r.series, r["at"]): r.z for r in got.collect()} == {(1, 10): 2, (1, 20): 1, (1, 30): 3, (2, 10): 1, (2, 20): 2}


def test_searched_levels(spark):
    modes = np.concatenate([RANDOM.normal(60, 10, 6000), RANDOM.normal(180, 12, 4000)]).round().clip(0, 255).astype(int)
    planes = [modes, [7] * 5, [3] * 4 + [90] * 2, RANDOM.integers(20, 40, 500)]
    px = spark.createDataFrame([(k, int(v)) for k, p in enumerate(planes) for v in p], "image_id int, v int")
    got = {(r.image_id, r.method): r.level for r in T.searched_levels(px, ["image_id"]).collect()}
    assert set(got) == {(k, m) for k in range(4) for m in T.SEARCHED}
    assert all(90 <= got[0, m] <= 150 for m in ("default", "isodata_plain", "huang")) and all(60 < got[0, m] < 190 for m in T.SEARCHED)
    assert {got[1, m] for m in T.SEARCHED} == {7} and {got[2, m] for m in T.SEARCHED} == {89}
    n = np.bincount(planes[3], minlength=256)
    k = np.arange(256)

    def fuzziness(t):
        low, high = n[: t + 1], n[t + 1 :]
        a = (low * k[: t + 1]).sum() / low.sum() if low.sum() else 0.0
        b = (high * k[t + 1 :]).sum() / high.sum() if high.sum() else 0.0
        m = 1 / (1 + np.abs(k - np.where(k <= t, a, b)) / (39 - 20))
        ok = (m >= 1e-6) & (m <= 0.999999)
        return round(float((n[ok] * (-m[ok] * np.log(m[ok]) - (1 - m[ok]) * np.log(1 - m[ok]))).sum()), 9)

    assert got[3, "huang"] == min(range(256), key=lambda t: (fuzziness(t), t))
    assert T.searched_levels(px.where("v > 300"), ["image_id"]).isEmpty()
