"""Stencils, objects and plane functions against brute force on small planes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain import label
from planespark.operators import particles, stencils

RANDOM = np.random.default_rng(3)
KEYS = ["image_id"]


def pixels(spark, *arrays):
    rows = [(k, x, y, float(a[y, x])) for k, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id int, x int, y int, v double").repartition(3)


def plane(df, shape, k=0, column="v"):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("image_id") == k).collect():
        out[r.y, r.x] = r[column]
    return out


def around(a, y, x, offsets):
    h, w = a.shape
    return [a[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)] for dy, dx in offsets]


def circle(limit):
    return [(dy, dx) for dy in range(-9, 10) for dx in range(-9, 10) if dx * dx + dy * dy <= limit]


def brute(a, f):
    return np.array([[f(y, x) for x in range(a.shape[1])] for y in range(a.shape[0])], float)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (6, 8)])
def test_rank_windows(spark, shape):
    a = RANDOM.integers(0, 99, shape).astype(float)
    px = pixels(spark, a, a + 1)
    for radius, limit in ((1.0, 2), (1.6, 4), (2.6, 9), (3.0, 10)):
        for kind, f in {"mean": np.mean, "min": np.min, "max": np.max, "variance": np.var, "median": np.median}.items():
            got = plane(stencils.rank(px, KEYS, radius, kind), shape, 1)
            assert np.allclose(got, brute(a + 1, lambda y, x: f(around(a + 1, y, x, circle(limit)))))  # noqa: B023


def test_kernels(spark):
    a = RANDOM.integers(0, 255, (7, 9)).astype(float)
    px = pixels(spark, a)
    kernel = RANDOM.integers(-3, 4, (3, 5)).tolist()
    offsets = [(j - 1, i - 2) for j in range(3) for i in range(5)]
    want = brute(a, lambda y, x: np.dot(np.ravel(kernel), around(a, y, x, offsets)))
    assert np.allclose(plane(stencils.convolve(px, KEYS, kernel, normalise=False), a.shape), want)
    k = stencils.gaussian_kernel(1.5)
    r = len(k) // 2
    assert np.isclose(sum(k), 1) and k[0] / k[r] >= 2e-4 > np.exp(-((r + 1) ** 2) / 4.5)
    square = [(j, i) for j in range(-r, r + 1) for i in range(-r, r + 1)]
    assert np.allclose(plane(stencils.gaussian(px, KEYS, 1.5), a.shape), brute(a, lambda y, x: np.dot(np.outer(k, k).ravel(), around(a, y, x, square))))
    lit = np.zeros((5, 5))
    lit[2, 2] = 10
    assert plane(stencils.shadows(pixels(spark, lit), KEYS, 0), (5, 5))[3, 2] == 20
    assert plane(stencils.shadows(pixels(spark, lit), KEYS, 4), (5, 5))[1, 2] == 20


def test_masks_and_distance(spark):
    on = RANDOM.random((9, 11)) < 0.7
    px = pixels(spark, on.astype(float), np.ones((4, 4)), np.zeros((2, 3)))
    p = np.pad(on, 1)
    k = np.array([[p[y : y + 3, x : x + 3].sum() - on[y, x] for x in range(11)] for y in range(9)])
    lit = F.col("v") > 0
    assert (plane(stencils.eroded(px, KEYS, lit, 3), on.shape) == 255 * (on & (8 - k < 3))).all()
    assert (plane(stencils.dilated(px, KEYS, lit, 2), on.shape) == 255 * (on | (k >= 2))).all()
    assert (plane(stencils.outline(px, KEYS, lit), on.shape) == 255 * (on & (k < 8))).all()
    back = np.argwhere(~on)
    want = np.array([[0 if not on[y, x] else np.sqrt(((back - (y, x)) ** 2).sum(1).min()) for x in range(11)] for y in range(9)])
    assert np.allclose(plane(stencils.distance(px, KEYS, lit), on.shape), want)
    assert (plane(stencils.distance(px, KEYS, lit), (4, 4), 1) == 0).all()
    assert stencils.distance(px.limit(0), KEYS, lit).count() == 0


def test_ball(spark):
    a = np.add.outer(np.arange(13.0), np.zeros(13))
    a[7, 7] += 40
    got = stencils.ball_background(pixels(spark, a), KEYS, 4)
    back = plane(got, a.shape, 0, "ball")
    spots = [(dy, dx, np.sqrt(16 - dy * dy - dx * dx)) for dy in range(-4, 5) for dx in range(-4, 5) if dy * dy + dx * dx <= 16]
    low = brute(a, lambda y, x: min(v - z for (dy, dx, z) in spots for v in around(a, y, x, [(dy, dx)])))
    want = np.minimum(a, brute(low, lambda y, x: max(v + z for (dy, dx, z) in spots for v in around(low, y, x, [(dy, dx)]))))
    assert np.allclose(back, want) and a[7, 7] - back[7, 7] > 35


def flood(on, eight):
    out, n = np.zeros(on.shape, int), 0
    for y, x in zip(*np.nonzero(on), strict=True):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            j, i = todo.pop()
            if not (0 <= j < on.shape[0] and 0 <= i < on.shape[1]) or not on[j, i] or out[j, i]:
                continue
            out[j, i] = n
            todo += [(j + a, i + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if eight or not (a and b)]
    return out


@pytest.mark.parametrize("eight", [True, False])
def test_particles(spark, eight):
    spiral = np.zeros((9, 9), bool)
    for y, x0, x1 in ((0, 0, 9), (2, 0, 7), (8, 0, 9), (6, 2, 9), (4, 2, 5)):
        spiral[y, x0:x1] = True
    spiral[:9, 8] = spiral[2:7, 0] = spiral[4:7, 2] = True
    shapes = [RANDOM.random((12, 17)) < 0.55, spiral, np.zeros((3, 3), bool), np.ones((1, 6), bool)]
    for on in shapes:
        h, w = on.shape
        a = np.where(on, RANDOM.integers(5, 9, on.shape), 0)
        got = particles.particles(pixels(spark, a), KEYS, 1, 255, w, h, eight).orderBy("label").collect()
        want = flood(on, eight)
        assert [r.label for r in got] == list(range(1, want.max() + 1))
        for r in got:
            y, x = np.nonzero(want == r.label)
            assert (r.area, r.x0, r.y0, r.w, r.h) == (len(x), x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1)
            assert np.allclose((r.cx, r.cy, r.mean), (x.mean() + 0.5, y.mean() + 0.5, a[y, x].mean()))
            assert r.edge == bool(x.min() == 0 or y.min() == 0 or x.max() == w - 1 or y.max() == h - 1)
            assert np.isclose(np.pi * r.major * r.minor / 4, r.area)
        assert (label(on, eight) == want).all()


def test_holes(spark):
    ring = np.zeros((6, 6))
    ring[1:4, 1:4] = 1
    ring[2, 2] = 0
    gap = ring.copy()
    gap[1, 1] = 0  # a diagonal step does not open the hole
    open_ = ring.copy()
    open_[1, 2] = 0
    got = particles.holes_filled(pixels(spark, ring, gap, open_), KEYS, F.col("v") > 0, 6, 6)
    assert [(plane(got, (6, 6), k) > 0).sum() for k in range(3)] == [9, 8, 7]
