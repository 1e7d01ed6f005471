"""Peaks, contours, hulls, thinning, spectra and points against brute force on small planes."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain import label
from planespark.functions import points
from planespark.operators import contours, fourier, hulls, particles, peaks, spectra, thinning

RANDOM = np.random.default_rng(11)


def hull(points):
    """Corners of the convex hull of (x, y) points, counter-clockwise (monotone chain)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows: np.ndarray) -> list:
        out: list = []
        for p in rows.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(points)[:-1] + half(points[::-1])[:-1])


def calipers(corners):
    """Area, largest diameter and its angle (degrees, 0..180), and smallest width of a convex polygon."""
    x, y = corners[:, 0].astype(float), corners[:, 1].astype(float)
    area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
    dx, dy = x[:, None] - x, y[:, None] - y
    i, j = divmod(int((dx * dx + dy * dy).argmax()), len(x))
    ex, ey = np.roll(x, -1) - x, np.roll(y, -1) - y
    across = (-ey[:, None] * x + ex[:, None] * y) / np.hypot(ex, ey)[:, None]
    return float(area), float(np.hypot(dx[i, j], dy[i, j])), float(np.degrees(np.arctan2(-dy[i, j], dx[i, j])) % 180), float((across.max(1) - across.min(1)).min())


def thinned(on):
    """Skeleton by alternating passes until nothing changes (Zhang and Suen 1984)."""
    on = on.copy()
    while True:
        before = on.copy()
        for half in (0, 1):
            p = np.pad(on, 1)
            h, w = on.shape
            n, ne, e, se, s, sw, west, nw = (p[1 + j : 1 + j + h, 1 + i : 1 + i + w] for j, i in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)))
            ring = [n, ne, e, se, s, sw, west, nw]
            count = sum(r.astype(int) for r in ring)
            turns = sum((~a & b).astype(int) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
            open_sides = ~(n & e & s) & ~(e & s & west) if half == 0 else ~(n & e & west) & ~(n & s & west)
            on = on & ~((count >= 2) & (count <= 6) & (turns == 1) & open_sides)
        if (on == before).all():
            return on


def prominent(a, tolerance):
    """Number of peaks by definition: the highest pass to a higher (or earlier equal) pixel lies more than the tolerance below."""
    found, values = [], a.ravel()
    for p in np.argsort(-values, kind="stable").tolist():
        v = values[p]
        higher = set(found_pixels(values, p))
        passes = [t for t in np.unique(values) if t <= v and connected(a >= t, p, higher)]
        pass_at = max(passes) if passes else values.min()
        if v - pass_at > tolerance:
            found.append(p)
    return len(found)


def found_pixels(values, p):
    return [q for q in range(len(values)) if values[q] > values[p] or (values[q] == values[p] and q < p)]


def connected(on, p, others):
    ids = label(on, True).ravel()
    return any(ids[q] == ids[p] and ids[q] for q in others)


def pixels(spark, planes):
    return spark.createDataFrame([(k, x, y, float(a[y, x])) for k, a in enumerate(planes) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id int, x int, y int, v double")


@pytest.mark.parametrize("shape", [(6, 7), (1, 20), (1, 1)])
def test_peaks(spark, shape):
    """As many as by definition, each the highest of its surroundings, higher ones first."""
    planes = [RANDOM.integers(0, 12, shape).astype(float) for _ in range(6)]
    for tolerance in (0, 2, 5):
        found = peaks.maxima(pixels(spark, planes), ["image_id"], shape[1], shape[0], tolerance).orderBy("image_id", "rank").collect()
        for k, a in enumerate(planes):
            mine = [r for r in found if r.image_id == k]
            assert len(mine) == prominent(a, tolerance) and [r.rank for r in mine] == list(range(1, len(mine) + 1))
            assert [r.v for r in mine] == sorted((r.v for r in mine), reverse=True)
            for r in mine:
                assert r.v == a[r.y, r.x] == a[max(r.y - 1, 0) : r.y + 2, max(r.x - 1, 0) : r.x + 2].max()


def test_peaks_of_special_planes(spark):
    flat = np.zeros((5, 5))
    flat[1:4, 1:4] = 9
    holes = np.full((5, 5), np.nan)
    holes[0, :2] = 4, 1
    holes[4, 4] = 7
    planes = [np.full((5, 5), 3.0), np.full((5, 5), np.nan), flat, holes]
    rows = peaks.maxima(pixels(spark, planes), ["image_id"], 5, 5, 1).orderBy("image_id", "rank").collect()
    assert [(r.image_id, r.x, r.y) for r in rows] == [(2, 2, 2), (3, 4, 4), (3, 0, 0)]
    assert peaks.maxima(pixels(spark, planes), ["image_id"], 5, 5, 1, exclude_edges=True).count() == 1
    assert peaks.maxima(pixels(spark, []), ["image_id"], 5, 5, 1).count() == 0


def test_watershed_cuts_two_discs(spark):
    y, x = np.mgrid[:21, :35]
    on = ((y - 10) ** 2 + (x - 10) ** 2 <= 64) | ((y - 10) ** 2 + (x - 23) ** 2 <= 64)
    assert label(on).max() == 1
    px = pixels(spark, [on.astype(float), np.ones(on.shape)])
    cut = np.zeros((2, *on.shape), bool)
    for r in peaks.watershed(px, ["image_id"], F.col("v") > 0, 35).collect():
        cut[r.image_id, r.y, r.x] = r.v > 0
    assert label(cut[0], True).max() == 2 and not (cut[0] & ~on).any() and cut[0].sum() > on.sum() - 25 and cut[1].all()
    spots = peaks.ultimate_points(px.where("image_id = 0"), ["image_id"], F.col("v") > 0, 35, 21).where("v > 0").collect()
    assert sorted((r.x, r.y) for r in spots) == [(10, 10), (23, 10)]


def walked(on, eight):
    """Contours by walking, side by side: (first point, outer, sides, perimeter)."""
    h, w = on.shape
    at = lambda x, y: 0 <= x < w and 0 <= y < h and on[y, x]
    start = {}
    for y, x in zip(*np.nonzero(on), strict=True):
        for way, free, a, b in ((0, at(x, y - 1), (x, y), (x + 1, y)), (1, at(x + 1, y), (x + 1, y), (x + 1, y + 1)), (2, at(x, y + 1), (x + 1, y + 1), (x, y + 1)), (3, at(x - 1, y), (x, y + 1), (x, y))):
            if not free:
                start[int(a[1]), int(a[0]), way] = (int(b[1]), int(b[0]))
    out, left = [], set(start)
    while left:
        first = side = min(left)
        path = []
        while True:
            left.discard(side)
            path.append(side)
            y, x = start[side]
            side = next((y, x, (side[2] + t) % 4) for t in ((3, 0, 1) if eight else (1, 0, 3)) if (y, x, (side[2] + t) % 4) in start)
            if side == first:
                break
        points = [s for k, s in enumerate(path) if k == 0 or s[2] != path[k - 1][2]]
        ends = [path.index(p) for p in points]
        cuts, cut = 0, False
        for k in range(len(points)):
            cut = (ends[k] - ends[k - 1]) % len(path) > 1 or not cut
            cuts += cut
        twice = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(path, [*path[1:], path[0]], strict=True))
        out.append((first[1], first[0], twice > 0, len(path), twice / 2, round(len(path) - cuts * (2 - math.sqrt(2)), 9), " ".join(f"{p[1]},{p[0]}" for p in points)))
    return sorted(out)


@pytest.mark.parametrize("eight", [True, False])
def test_contours(spark, eight):
    ring = np.ones((7, 9))
    ring[2:5, 3:6] = 0
    ring[3, 4] = 1
    planes = [ring, np.ones((7, 9)), np.zeros((7, 9)), *((RANDOM.random((7, 9)) < p).astype(float) for p in (0.3, 0.5, 0.7))]
    rows = contours.traced(pixels(spark, planes), ["image_id"], F.col("v") > 0, 9, eight).collect()
    for k, a in enumerate(planes):
        got = sorted((r.x0, r.y0, r.outer, r.sides, r.area, round(r.perimeter, 9), r.points) for r in rows if r.image_id == k)
        assert got == walked(a > 0, eight)
    assert contours.traced(pixels(spark, []), ["image_id"], F.col("v") > 0, 9).count() == 0


def test_perimeters_of_small_squares(spark):
    """One pixel: 4 sides less two cut corners; two by two: 8 less four."""
    one, two = np.zeros((5, 5)), np.zeros((5, 5))
    one[2, 2] = two[1:3, 1:3] = 1
    rows = {r.image_id: r for r in particles.outlined(pixels(spark, [one, two]), ["image_id"], 1, 1, 5, 5).collect()}
    assert math.isclose(rows[0].perimeter, 4 - 2 * (2 - math.sqrt(2))) and math.isclose(rows[1].perimeter, 8 - 4 * (2 - math.sqrt(2)))
    assert rows[0].circularity == 1.0 and rows[0].roundness == 1.0
    assert particles.outlined(pixels(spark, [one, two]), ["image_id"], 1, 1, 5, 5, size=(2, 9)).count() == 1


def test_hull_and_diameters(spark):
    """Against the hull and calipers of all pixel corners of each object."""
    y, x = np.mgrid[:11, :13]
    disc = ((y - 5) ** 2 + (x - 6) ** 2 <= 18).astype(float)
    bar = np.zeros((11, 13))
    bar[4, 2:9] = 1
    planes = [disc, bar, np.ones((11, 13)), *((RANDOM.random((11, 13)) < p).astype(float) for p in (0.2, 0.35, 0.6))]
    rows = hulls.shapes(pixels(spark, planes), ["image_id"], F.col("v") > 0, 13, 11).collect()
    for k, a in enumerate(planes):
        ids = label(a > 0, True)
        mine = {r.label: r for r in rows if r.image_id == k}
        assert len(mine) == ids.max()
        for n, r in mine.items():
            ys, xs = np.nonzero(ids == n)
            corners = hull(np.concatenate([np.stack([xs + i, ys + j], axis=1) for i in (0, 1) for j in (0, 1)]))
            area, feret, _, least = calipers(corners)
            assert r.area == len(ys) and np.allclose([r.hull_area, r.feret, r.min_feret, r.solidity], [area, feret, least, len(ys) / area])
    assert math.isclose({r.image_id: r for r in rows}[1].feret_angle, math.degrees(math.atan2(1, 7))) or math.isclose({r.image_id: r for r in rows}[1].feret_angle, 180 - math.degrees(math.atan2(1, 7)))


def test_skeleton(spark):
    on = np.zeros((9, 15), bool)
    on[2:7, 2:13] = True
    planes = [on, *(RANDOM.random((9, 15)) < p for p in (0.4, 0.7, 1.0)), np.zeros((9, 15), bool)]
    got = np.zeros((len(planes), 9, 15), bool)
    for r in thinning.thinned(pixels(spark, [a.astype(float) for a in planes]), ["image_id"], F.col("v") > 0).collect():
        got[r.image_id, r.y, r.x] = r.v > 0
    for a, thin in zip(planes, got, strict=True):
        assert (thin == thinned(a)).all()
    assert label(got[0]).max() == 1 and got[0].sum() < 15


def values(px, shape, images=1):
    out = np.zeros((images, *shape))
    for r in px.collect():
        out[r.image_id, r.y, r.x] = r.v
    return out


def test_spectra(spark):
    """Transforms against numpy, also of planes that are not square; products and band passes by their definition."""
    keys = ["image_id"]
    a, b = RANDOM.random((8, 4)), RANDOM.random((8, 4))
    pa, pb = pixels(spark, [a]), pixels(spark, [b])
    want = [[sum(a[(y + j) % 8, (x + i) % 4] * b[j, i] for j in range(8) for i in range(4)) for x in range(4)] for y in range(8)]
    assert np.allclose(values(fourier.product(pa, pb, keys, 4, 8, "correlate"), a.shape)[0], np.fft.fftshift(want))
    spread = np.fft.ifft2(np.fft.fft2(a) * np.fft.fft2(b)).real
    assert np.allclose(values(fourier.product(pa, pb, keys, 4, 8, "convolve"), a.shape)[0], np.fft.fftshift(spread))
    assert np.allclose(values(fourier.product(pixels(spark, [spread]), pb, keys, 4, 8, "deconvolve"), a.shape)[0], np.fft.fftshift(a))
    c = RANDOM.integers(0, 256, (5, 9)).astype(float)
    square = np.full((16, 16), c.mean())
    square[:5, :9] = c
    logs = np.log(np.maximum(np.abs(np.fft.fft2(square)) ** 2, 1))
    got = values(fourier.power_spectrum(pixels(spark, [c, np.zeros((5, 9))]), keys, 9, 5), (16, 16), 2)
    assert np.abs(got[0] - np.fft.fftshift(np.floor(logs * 253 / logs.max() + 0.5) + 1)).max() <= 1 and (got[0] != np.fft.fftshift(np.floor(logs * 253 / logs.max() + 0.5) + 1)).mean() < 0.01 and (got[1] == 1).all()
    f = np.fft.fftfreq(16)
    r2 = f[:, None] ** 2 + f[None] ** 2
    keep = np.exp(-r2 * 9.0) * (1 - np.exp(-r2 * 1600.0))
    keep[0, 0] = 1
    mirrored = np.pad(c, ((5, 6), (3, 4)), mode="symmetric")
    want = np.fft.ifft2(np.fft.fft2(mirrored) * keep).real[5:10, 3:12]
    got = values(fourier.band_passed(pixels(spark, [c, np.full((5, 9), 4.0)]), keys, 9, 5, 40, 3), (5, 9), 2)
    assert np.allclose(got[0], want) and np.allclose(got[1], 4.0)
    wave = 3 + 2 * np.sqrt(2) * np.sin(2 * np.pi * 5 * np.arange(64) / 64)
    assert np.allclose(spectra.amplitude(wave)[[0, 5, 6]], [3, 2, 0])


def test_points(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (3.0, 4.0), (3.0, 0.0)]), (2, [(1.0, 1.0)]), (3, [])], "id int, p array<struct<x: double, y: double>>")
    got = rows.orderBy("id").select(points.length(F.col("p")), points.shoelace(F.col("p")), points.angle(F.col("p"))).collect()
    assert tuple(got[0])[:2] == (9.0, 6.0) and math.isclose(got[0][2], math.degrees(math.atan2(3, 4)))
    assert [tuple(r) for r in got[1:]] == [(0.0, 0.0, None), (0.0, 0.0, None)]
