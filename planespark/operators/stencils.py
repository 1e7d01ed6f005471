"""Neighbourhood operators over long-form pixels, worked out on image rows as arrays (see ``lines``).

A stencil reads what lies a few pixels beside each pixel of its image row, makes
a few partial values of it, and then reads these above and below. So the rows of
a plane cross two shuffles whatever the size of the stencil, no plane has to fit
a task, and all of it stays in the JVM. Planes are dense: a row for every x and
y. Beyond the edge of a plane the nearest edge pixel is read, or a fixed value
where an operator says so.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planespark.operators import lines
from planespark.operators.lines import Join, Rows
from planespark.operators.lines import total as _total
from planespark.operators.lines import weighted as _weighted

#: Radii of circular windows that stand for another one (from, below, meant).
MEANT_RADII = ((1.5, 1.75, 1.75), (2.5, 2.85, 2.85))


def stencil(px: DataFrame, keys: list[str], reach: tuple[int, int], rows: Rows, join: Join, outside: float | None = None, out: str = "v") -> DataFrame:
    """keys, x, y, v and ``out``: ``rows`` makes named values of v at x - rx .. x + rx, ``join`` the result of those at y - ry .. y + ry."""
    return _shown(lines.stencil(lines.to_lines(px, keys), keys, reach, rows, join, outside), keys, out)


def _shown(strips: DataFrame, keys: list[str], out: str) -> DataFrame:
    return lines.to_pixels(strips, keys, {"out": "v"} if out == "v" else {"line": "v", "out": out})


def correlation(px: DataFrame, keys: list[str], kernel: list[list[float]], out: str = "v") -> DataFrame:
    """Sum of the neighbours times an odd kernel."""
    ry, rx = len(kernel) // 2, len(kernel[0]) // 2
    return stencil(px, keys, (rx, ry), lambda v: {str(j): _weighted(v, row) for j, row in enumerate(kernel)}, lambda p: _total([p[str(j)][j] for j in range(len(kernel))]), out=out)


def convolve(px: DataFrame, keys: list[str], kernel: list[list[float]], normalise: bool = True) -> DataFrame:
    """``correlation`` divided by the kernel's sum, if that is not 0."""
    total = sum(map(sum, kernel))
    scale = total if normalise and total else 1
    return correlation(px, keys, kernel).withColumn("v", F.col("v") / float(scale))


def smooth(px: DataFrame, keys: list[str]) -> DataFrame:
    """3 x 3 mean of an 8-bit plane, rounded."""
    return correlation(px, keys, [[1] * 3] * 3).withColumn("v", F.floor((F.col("v") + 4) / 9.0).cast("double"))


def sobel(px: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of an 8-bit plane: the length of the gradient, at most 255."""
    rows = lambda v: {"d": v[2] - v[0], "s": v[0] + v[1] * 2 + v[2]}
    gx = lambda p: p["d"][0] + p["d"][1] * 2 + p["d"][2]
    gy = lambda p: p["s"][2] - p["s"][0]
    return stencil(px, keys, (1, 1), rows, lambda p: F.least(F.lit(255.0), F.floor(F.sqrt((gx(p) * gx(p) + gy(p) * gy(p)).cast("double"))).cast("double")))


def shadows(px: DataFrame, keys: list[str], direction: int) -> DataFrame:
    """Relief of an 8-bit plane lit from one of eight directions: 0 is north, then clockwise."""
    light = [1, 2, 1, 0, -1, -2, -1, 0]
    ring = [light[(k - direction) % 8] for k in range(8)]  # from the upper left corner, clockwise
    kernel = [[ring[0], ring[1], ring[2]], [ring[7], 1, ring[3]], [ring[6], ring[5], ring[4]]]
    return correlation(px, keys, kernel).withColumn("v", F.greatest(F.lit(0), F.least(F.lit(255), F.col("v"))).cast("double"))


def gaussian_kernel(sigma: float, accuracy: float = 2e-4) -> list[float]:
    """Weights of a Gaussian that sum to 1, cut off plainly where they fall below ``accuracy`` of the middle one."""
    reach = int(sigma * math.sqrt(-2 * math.log(accuracy)))
    side = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    return [w / sum(side) for w in side]


def gaussian(px: DataFrame, keys: list[str], sigma: float, accuracy: float = 2e-4, out: str = "v") -> DataFrame:
    """Blur by a Gaussian, one axis after the other."""
    return _shown(lines.blurred(lines.to_lines(px, keys), keys, gaussian_kernel(sigma, accuracy)), keys, out)


def unsharp(px: DataFrame, keys: list[str], sigma: float, weight: float) -> DataFrame:
    """(value - weight * blurred) / (1 - weight)."""
    both = gaussian(px, keys, sigma, out="blur")
    return both.select(*keys, "x", "y", ((F.col("v") - F.col("blur") * weight) / (1 - weight)).alias("v"))


def half_widths(radius: float) -> dict[int, int]:
    """Reach in x of the circular window at each dy: dx^2 + dy^2 is at most the radius squared, cut to a whole number, and 1."""
    meant = next((m for a, b, m in MEANT_RADII if a <= radius < b), radius)
    limit = int(meant * meant) + 1
    most = math.isqrt(limit)
    return {dy: math.isqrt(limit - dy * dy) for dy in range(-most, most + 1)}


def rank(px: DataFrame, keys: list[str], radius: float, kind: str, out: str = "v") -> DataFrame:
    """mean, min, max, variance (population) or median over the circular window."""
    return _shown(_ranked(lines.to_lines(px, keys), keys, radius, kind), keys, out)


def _ranked(rows_of: DataFrame, keys: list[str], radius: float, kind: str) -> DataFrame:
    widths = half_widths(radius)
    reach, widest = max(widths), max(widths.values())
    inner = lambda v, w: v[widest - w : widest + w + 1]
    n = sum(2 * w + 1 for w in widths.values())
    each = lambda p, name: [p[f"{name}{w}"][dy + reach] for dy, w in widths.items()]
    one = lambda f: lambda v: f(*v) if len(v) > 1 else v[0]
    make: dict[str, tuple[Rows, Join]] = {
        "min": (lambda v: {f"m{w}": one(F.least)(inner(v, w)) for w in set(widths.values())}, lambda p: one(F.least)(each(p, "m"))),
        "max": (lambda v: {f"m{w}": one(F.greatest)(inner(v, w)) for w in set(widths.values())}, lambda p: one(F.greatest)(each(p, "m"))),
        "mean": (lambda v: {f"s{w}": _total(inner(v, w)) for w in set(widths.values())}, lambda p: _total(each(p, "s")) / float(n)),
        "variance": (
            lambda v: {f"s{w}": _total(inner(v, w)) for w in set(widths.values())} | {f"q{w}": _total([c * c for c in inner(v, w)]) for w in set(widths.values())},
            lambda p: F.greatest(F.lit(0.0), (_total(each(p, "q")) - _total(each(p, "s")) * _total(each(p, "s")) / float(n)) / float(n)),
        ),
        "median": (lambda v: {f"a{w}": F.array(*inner(v, w)) for w in set(widths.values())}, lambda p: F.element_at(F.array_sort(F.concat(*each(p, "a"))), n // 2 + 1)),
    }
    rows, join = make[kind]
    return lines.stencil(rows_of, keys, (widest, reach), rows, lambda p: join(p).cast("double"))


def outliers(px: DataFrame, keys: list[str], radius: float, threshold: float, bright: bool = True) -> DataFrame:
    """Pixels that differ from the median around them by more than the threshold, on the bright or the dark side, get the median."""
    both = rank(px, keys, radius, "median", out="m")
    off = F.col("v") - F.col("m") if bright else F.col("m") - F.col("v")
    return both.select(*keys, "x", "y", F.when(off > threshold, F.col("m")).otherwise(F.col("v")).cast("double").alias("v"))


def _twice(px: DataFrame, keys: list[str], radius: float, first: str, then: str) -> DataFrame:
    """Strips (own, out) of one rank after the other; the rows stay arrays between them."""
    own = lines.to_lines(px, keys)
    once = lines.whole_lines(_ranked(own, keys, radius, first), keys, "out")
    return _ranked(once, keys, radius, then)


def opened(px: DataFrame, keys: list[str], radius: float) -> DataFrame:
    return _shown(_twice(px, keys, radius, "min", "max"), keys, "v")


def closed(px: DataFrame, keys: list[str], radius: float) -> DataFrame:
    return _shown(_twice(px, keys, radius, "max", "min"), keys, "v")


def top_hat(px: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """The plane without its opening."""
    low = lines.whole_lines(_twice(px, keys, radius, "min", "max"), keys, "out").withColumnRenamed("line", "low")
    both = lines.to_lines(px, keys).join(low, [*keys, "y"])
    return lines.to_pixels(both.withColumn("out", F.zip_with("line", "low", lambda a, b: a - b)), keys, {"out": "v"})


def neighbours(px: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """v (whether the pixel is foreground, 0 or 1) and k, its foreground neighbours of eight; outside the plane is background."""
    mask = px.select(*keys, "x", "y", F.when(on, 1).otherwise(0).alias("v"))
    counted = stencil(mask, keys, (1, 1), lambda v: {"s": _total(v)}, lambda p: _total(p["s"]), outside=0, out="k")
    return counted.withColumn("k", F.col("k") - F.col("v"))


def _painted(rows: DataFrame, keys: list[str], on: Column) -> DataFrame:
    return rows.select(*keys, "x", "y", F.when(on, 255.0).otherwise(0.0).alias("v"))


def eroded(px: DataFrame, keys: list[str], on: Column, count: int = 1) -> DataFrame:
    """Foreground pixels with at least ``count`` background neighbours go."""
    return _painted(neighbours(px, keys, on), keys, (F.col("v") == 1) & (8 - F.col("k") < count))


def dilated(px: DataFrame, keys: list[str], on: Column, count: int = 1) -> DataFrame:
    """Background pixels with at least ``count`` foreground neighbours come."""
    return _painted(neighbours(px, keys, on), keys, (F.col("v") == 1) | (F.col("k") >= count))


def outline(px: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """Foreground pixels with background among their eight neighbours."""
    return _painted(neighbours(px, keys, on), keys, (F.col("v") == 1) & (F.col("k") < 8))


def ball_background(px: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """v, and ``ball``: what a ball rolled under the surface reaches, the opening by a half sphere (Sternberg 1983)."""
    height = {(dy, dx): math.sqrt(radius * radius - dy * dy - dx * dx) for dy in range(radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius}
    reach = {dy: max(dx for y, dx in height if y == dy) for dy in range(radius + 1)}

    def side(rows: DataFrame, pick: Callable, sign: float) -> DataFrame:
        parts = lambda v: {str(dy): pick(*(v[radius + dx] + F.lit(sign * height[dy, dx]) for dx in range(-w, w + 1))) if w else v[radius] + F.lit(sign * height[dy, 0]) for dy, w in reach.items()}
        return lines.stencil(rows, keys, (radius, radius), parts, lambda p: pick(*(p[str(abs(dy))][dy + radius] for dy in range(-radius, radius + 1))))

    own = lines.to_lines(px, keys)
    low = lines.whole_lines(side(own, F.least, -1.0), keys, "out")
    ball = lines.whole_lines(side(low, F.greatest, 1.0), keys, "out").withColumnRenamed("line", "_ball")
    both = own.join(ball, [*keys, "y"]).withColumn("out", F.zip_with("line", "_ball", lambda v, b: F.least(b, v.cast("double"))))
    return _shown(both, keys, "ball")


def distance(px: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """Exact Euclidean distance of foreground pixels to the nearest background pixel of the plane (0 where the plane has none).

    First the distance within each column, from windows up and down; then, in
    each image row, the nearest of the columns that are no farther away than the
    pixel's own column says. A group holds one row of a plane.
    """
    column = Window.partitionBy(*keys, "x").orderBy("y")
    back = F.when(F.col("back"), F.col("y"))
    rows = px.select(*keys, "x", "y", (~on).alias("back"))
    above = F.last(back, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    below = F.last(back, ignorenulls=True).over(Window.partitionBy(*keys, "x").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, 0))
    g = F.least(F.col("y") - above, below - F.col("y"))  # null where the column has no background
    lines = rows.withColumn("g", g).groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("x", "g"))).alias("line"))
    d2 = F.expr("""transform(line, (p, i) -> struct(p.x as x, array_min(transform(
        sequence(greatest(0, i - coalesce(p.g, size(line))), least(size(line) - 1, i + coalesce(p.g, size(line)))),
        j -> bigint(line[j].g) * line[j].g + bigint(j - i) * (j - i))) as d2))""")
    return lines.select(*keys, "y", F.inline(d2)).select(*keys, "x", "y", F.sqrt(F.coalesce(F.col("d2"), F.lit(0)).cast("double")).alias("v"))
