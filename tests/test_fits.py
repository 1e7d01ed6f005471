"""Curve fits against published parameters, exact curves and numpy."""

import numpy as np
import pytest

from planespark.operators import fits

XS = [1.0, 2.0, 3.0]
#: Parameters and squared errors published for three points.
KNOWN = {"exponential": ([12, 44, 115], [5.46507, 1.01669], 14.86054), "power": ([3, 15, 99], [0.62482, 4.61051], 5.71156), "log": ([7, 11, 14], [6.30697, 2.98619], 0.11307)}


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_published_fits(spark, name):
    ys, want, error = KNOWN[name]
    rows = spark.createDataFrame([(1, x, float(y)) for x, y in zip(XS, ys, strict=True)] + [(2, 1.0, 3.0), (2, None, 1.0), (2, float("nan"), 1.0)], "g int, x double, y double")
    got = {r.g: r for r in fits.iterated(rows, ["g"], "x", "y", name).collect()}
    assert np.allclose(got[1].p, want, atol=2e-5) and abs(got[1].sse - error) < 2e-5 and got[1].converged
    assert got[2].p is None and got[2].n == 1  # fewer rows than parameters
    assert fits.iterated(rows.limit(0), ["g"], "x", "y", name).count() == 0


def test_own_formula(spark):
    rows = spark.createDataFrame(list(zip(XS, [3.0, 251.0, 1004.0], strict=True)), "x double, y double").selectExpr("1 AS g", "x", "y")
    assert abs(fits.iterated(rows, ["g"], "x", "y", fits.Model(1, lambda p, x: p[0] * x, None), start=[5]).head().p[0] - 251.21464) < 1e-3


def test_exact_curves_are_found(spark):
    """Several curves in one table each, several groups side by side."""
    x = np.linspace(0.5, 12, 40)
    curves = {
        "exp_offset": ([5.0, 0.4, 2.0], [1.0, 0.9, -3.0]), "exp_recovery": ([5.0, 0.4, 2.0],), "exp_recovery_plain": ([7.0, 0.3],), "gaussian": ([1.0, 9.0, 5.0, 1.5], [0.0, 3.0, 7.0, 0.8]),
        "gaussian_plain": ([9.0, 5.0, 1.5],), "rodbard": ([1.0, 2.5, 5.0, 9.0],), "chapman": ([6.0, 0.5, 2.0],), "log2": ([2.0, 3.0, -1.5],),
    }
    value = {
        "exp_offset": lambda p: p[0] * np.exp(-p[1] * x) + p[2], "exp_recovery": lambda p: p[0] * (1 - np.exp(-p[1] * x)) + p[2], "exp_recovery_plain": lambda p: p[0] * (1 - np.exp(-p[1] * x)), "gaussian": lambda p: p[0] + (p[1] - p[0]) * np.exp(-((x - p[2]) ** 2) / (2 * p[3] ** 2)),
        "gaussian_plain": lambda p: p[0] * np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2)), "rodbard": lambda p: p[3] + (p[0] - p[3]) / (1 + (x / p[2]) ** p[1]), "chapman": lambda p: p[0] * (1 - np.exp(-p[1] * x)) ** p[2], "log2": lambda p: p[0] + p[1] * np.log(x - p[2]),
    }
    for name, groups in curves.items():
        rows = spark.createDataFrame([(k, float(a), float(b)) for k, p in enumerate(groups) for a, b in zip(x, value[name](p), strict=True)], "g int, x double, y double")
        for r in fits.iterated(rows, ["g"], "x", "y", name).collect():
            found = np.abs(r.p) if name.startswith("gaussian") else r.p
            assert np.allclose(found, groups[r.g], rtol=1e-4, atol=1e-4), (name, r)


def test_polynomials(spark):
    """Against numpy, far from 0 too; exact for a parabola through three points; nothing for too few different x."""
    rng = np.random.default_rng(2)
    x, y = rng.uniform(1000, 1010, 60), rng.normal(size=60)
    rows = [(1, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(2, a, b) for a, b in zip(XS, [10.6, 24.2, 33.0], strict=True)] + [(3, 2.0, 5.0)] * 4
    got = {r.g: r for r in fits.polynomials(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y", 2).collect()}
    assert np.allclose(got[2].p, [-7.8, 20.8, -2.4]) and got[3].p is None and abs(got[2].r2 - 1) < 1e-9
    rows8 = spark.createDataFrame([(1, float(a - 1005), float(b)) for a, b in zip(x, y, strict=True)], "g int, x double, y double")
    for degree in range(2, 9):
        p = fits.polynomials(rows8, ["g"], "x", "y", degree).head()
        want = np.polynomial.Polynomial.fit(x - 1005, y, degree)
        assert np.allclose(np.polynomial.Polynomial(p.p)(x - 1005), want(x - 1005), atol=1e-6)
        assert abs(p.r2 - (1 - ((y - want(x - 1005)) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-6
    assert np.allclose(np.polynomial.Polynomial(got[1].p)(x), np.polynomial.Polynomial.fit(x, y, 2)(x), atol=1e-4)
