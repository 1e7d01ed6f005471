"""Automatic thresholds on histograms whose answer is known, against brute force, and applied."""

import numpy as np
import pytest

from planespark.operators import thresholds as T

RANDOM = np.random.default_rng(5)


def planes(spark, *planes_of_values):
    rows = [(k, int(v)) for k, values in enumerate(planes_of_values) for v in values]
    return spark.createDataFrame(rows, "image_id int, v int")


def two_modes():
    a = np.concatenate([RANDOM.normal(60, 10, 6000), RANDOM.normal(180, 12, 4000)])
    return np.clip(np.floor(a), 0, 255).astype(int)


def test_all_methods(spark):
    flat = RANDOM.integers(0, 256, 4000)
    px = planes(spark, two_modes(), flat, [7] * 5, [0] * 5 + [255] * 9)
    got = {(r.image_id, r.method): r.level for f in (T.levels, T.iterated_levels) for r in f(px, ["image_id"]).collect()}
    methods = {*T.DIRECT, *T.ITERATED}
    assert set(got) == {(k, m) for k in range(4) for m in methods}
    assert all(75 <= got[0, m] <= 165 for m in methods - {"percentile", "triangle"})
    assert 55 <= got[0, "percentile"] <= 75 and 60 < got[0, "triangle"] < 160
    assert {got[2, m] for m in methods} == {7} and all(0 <= got[3, m] <= 255 for m in methods)
    split = [((flat <= t).mean() * (flat > t).mean() * (flat[flat <= t].mean() - flat[flat > t].mean()) ** 2) if 0 < (flat <= t).sum() < len(flat) else -1 for t in range(256)]
    assert got[1, "otsu"] == int(np.argmax(split)) and got[1, "mean"] == int(flat.mean())
    assert T.levels(px.where("v > 300"), ["image_id"]).count() == T.iterated_levels(px.where("v > 300"), ["image_id"]).count() == 0


@pytest.mark.parametrize("whole", [False, True])
def test_applied(spark, whole):
    px = spark.createDataFrame([(1, z, x, 0, 10 * z + (200 if x > 1 else 0)) for z in (1, 2) for x in range(4)], "image_id int, z int, x int, y int, v int")
    got = {(r.z, r.x): r.v for r in T.applied(px, ["image_id", "z"], "otsu", whole).collect()}
    assert got == {(z, x): 255 if x > 1 else 0 for z in (1, 2) for x in range(4)}
