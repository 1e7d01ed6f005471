"""Joins of images: calculator, paste, regions, comparison."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planespark.functions import points
from planespark.operators import lines


def _modes(a: Column, b: Column, top: int = 255) -> dict[str, Column]:
    """The modes for integers from 0 to ``top``."""
    return {
        "add": F.least(a + b, F.lit(top)),
        "subtract": F.greatest(a - b, F.lit(0)),
        "multiply": F.least(a.cast("long") * b, F.lit(top)).cast("int"),
        "divide": F.when(b == 0, top).otherwise((a / b).cast("int")),
        "and": a.bitwiseAND(b),
        "or": a.bitwiseOR(b),
        "xor": a.bitwiseXOR(b),
        "min": F.least(a, b),
        "max": F.greatest(a, b),
        "average": ((a + b) / 2).cast("int"),
        "difference": F.abs(a - b),
        "copy": b,
        "copy_nonzero": F.when(b == 0, a).otherwise(b),
    }


def _real_modes(a: Column, b: Column) -> dict[str, Column]:
    """The modes for 32-bit images: nothing is cut off, and a quotient by 0 is infinite or NaN."""
    quotient = F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a == 0, float("nan")).otherwise(F.signum(a) * float("inf"))
    return {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": quotient, "min": F.least(a, b), "max": F.greatest(a, b), "average": (a + b) / 2, "difference": F.abs(a - b), "copy": b, "copy_nonzero": F.when(b == 0, a).otherwise(b)}


def calculate(left: DataFrame, right: DataFrame, on: list[str], modes: list[str], top: int | None = 255, along: tuple[str, ...] = ()) -> DataFrame:
    """One column per mode for values that share a place; ``top`` is the largest level, None for 32-bit images.

    For a stack by a single plane ``on`` leaves z out and ``along`` names it, so the one plane meets every slice.
    """
    both = left.withColumnRenamed("v", "_a").join(right.withColumnRenamed("v", "_b"), on)
    if top is None:
        known = _real_modes(F.col("_a").cast("double"), F.col("_b").cast("double"))
    else:
        known = _modes(F.col("_a"), F.col("_b"), top)
    return both.select(*on, *along, *(known[m].alias(m) for m in modes))


def paste(px: DataFrame, patch: DataFrame, on: list[str], dx: int, dy: int, mode: str = "copy") -> DataFrame:
    """``patch`` put at (dx, dy); pixels outside the overlap stay."""
    moved = patch.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}).withColumnRenamed("v", "_b")
    both = px.withColumnRenamed("v", "_a").join(moved, on, "left")
    return both.select(*on, F.when(F.col("_b").isNull(), F.col("_a")).otherwise(_modes(F.col("_a"), F.col("_b"))[mode]).alias("v"))


#: Side of the tiles by which regions and pixels meet.
TILE = 32


def contains(kind: Column, x: Column, y: Column, x0: Column, y0: Column, w: Column, h: Column) -> Column:
    """Whether a pixel's centre lies in a rectangle or in the oval inscribed in it."""
    dx, dy = (x + 0.5 - x0 - w / 2.0) / (w / 2.0), (y + 0.5 - y0 - h / 2.0) / (h / 2.0)
    box = (x >= x0) & (x < x0 + w) & (y >= y0) & (y < y0 + h)
    return box & ((kind != "oval") | (dx * dx + dy * dy <= 1))


def _by_tile(px: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixels and regions that share a tile of the region's bounding box: an equi-join. No side is broadcast by hand."""
    last = lambda p, n: F.floor((F.col(p) + F.col(n) - 1) / TILE).cast("int")
    tiled = rois.withColumn("_tx", F.explode(F.sequence(F.floor(F.col("x0") / TILE).cast("int"), last("x0", "w")))).withColumn("_ty", F.explode(F.sequence(F.floor(F.col("y0") / TILE).cast("int"), last("y0", "h"))))
    placed = px.withColumns({"_tx": F.floor(F.col("x") / TILE).cast("int"), "_ty": F.floor(F.col("y") / TILE).cast("int")})
    return placed.join(tiled, ["image_id", "_tx", "_ty"]).drop("_tx", "_ty")


def inside(px: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixels of each rectangle or oval: by tile, then the exact test."""
    return _by_tile(px, rois).where(contains(*(F.col(c) for c in ("kind", "x", "y", "x0", "y0", "w", "h"))))


def inside_polygons(px: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixels whose centre lies in a region's ``points`` (array<struct<x, y>>, closed by itself, even-odd); regions of fewer than three points have none.

    Each polygon becomes its pixels once, row by row between its crossings,
    however many slices it is measured on; they meet the images by place.
    """
    return _filled(px, rois.where(F.size("points") > 2), F.col("points"), lambda y: points.crossings(F.col("points"), y))


def inside_composites(px: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixels of composite regions: ``parts`` is an array of polygons, and what lies in an even number of them is outside.

    Parts of fewer than three points and regions without parts have no pixels.
    """
    whole = rois.withColumn("parts", F.filter("parts", lambda p: F.size(p) > 2)).where(F.size("parts") > 0)
    return _filled(px, whole, F.flatten("parts"), lambda y: points.crossings_of_parts(F.col("parts"), y))


def split(rois: DataFrame) -> DataFrame:
    """A row for each part of composite regions: ``part`` from 0 and its ``points``."""
    kept = [c for c in rois.columns if c != "parts"]
    return rois.select(*kept, F.posexplode("parts").alias("part", "points"))


def _filled(px: DataFrame, rois: DataFrame, corners: Column, crossings: Callable[[Column], Column]) -> DataFrame:
    """Pixels of regions, by spans of image rows between ``crossings``; ``px`` may be pixels or lines.

    Image rows and spans meet by row, and only then does a span become pixels.
    The spans are many more than the regions that they are made of, which the
    planner's sizes do not show, so they are hashed by partition and never broadcast.
    """
    ys = F.transform(corners, lambda p: p["y"].cast("double"))
    spans = rois.withColumn("y", F.explode(F.sequence(F.floor(F.array_min(ys)).cast("int"), F.ceil(F.array_max(ys)).cast("int"))))
    level = lambda c: F.ceil(c - 0.5).cast("int")
    pairs = lambda cut: F.transform(cut, lambda c, i: F.when((i % 2 == 0) & (i + 1 < F.size(cut)), F.struct(level(c).alias("_a"), (level(F.get(cut, i + 1)) - 1).alias("_b"))))
    spans = spans.select(*spans.columns, F.inline(F.array_compact(points.let(crossings(F.col("y") + 0.5), pairs)))).where("_a <= _b")
    kept = [c for c in spans.columns if c not in ("image_id", "y", "_a", "_b")]
    if "line" in px.columns:
        keys = [c for c in px.columns if c != "line"]
        met = px.join(spans.hint("shuffle_hash"), ["image_id", "y"]).where((F.col("_b") >= 0) & (F.col("_a") < F.size("line"))).withColumn("_a", F.greatest("_a", F.lit(0)))
        found = met.select(*keys, *kept, "_a", F.posexplode(F.slice("line", F.col("_a") + 1, F.col("_b") - F.col("_a") + 1)).alias("_at", "v"))
        return found.select("image_id", (F.col("_a") + F.col("_at")).alias("x"), "y", *(c for c in keys if c not in ("image_id", "y")), "v", *kept)
    return px.join(spans.hint("shuffle_hash"), ["image_id", "y"]).where("x between _a and _b").select("image_id", "x", "y", *(c for c in px.columns if c not in ("image_id", "x", "y")), *kept)


def at_points(px: DataFrame, spots: DataFrame, on: list[str]) -> DataFrame:
    """Each point with the value of its pixel; points off the planes are left out."""
    return spots.join(px.select(*on, "v"), on)


def redirected(px: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Pixels picked on one image with the values that another has there."""
    return px.drop("v").join(values, on)


def outside(px: DataFrame, rois: DataFrame, key: list[str]) -> DataFrame:
    """Pixels in no region."""
    return px.join(inside(px, rois).select(*key), key, "left_anti")


def compare(left: DataFrame, right: DataFrame, on: list[str], keys: list[str], span: float = 255.0) -> DataFrame:
    """MSE, RMSE, MAE, largest error and PSNR of planes that share their places."""
    both = left.withColumnRenamed("v", "_a").join(right.withColumnRenamed("v", "_b"), on)
    d = (F.col("_a") - F.col("_b")).cast("double")
    out = both.groupBy(*keys).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("most"))
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(span * span / F.col("mse"))))


def merged(px: DataFrame, at: list[str], names: dict[int, str]) -> DataFrame:
    """One row a position with a column per channel (c -> name): one aggregation in place of a join for each channel."""
    return px.groupBy(*at).agg(*(F.max(F.when(F.col("c") == c, F.col("v"))).alias(name) for c, name in names.items()))


def algebra(first: DataFrame, second: DataFrame, at: list[str]) -> DataFrame:
    """Positions of two regions with the flags both (AND), either (OR) and one (XOR)."""
    rows = first.select(*at, F.lit(1).alias("side")).union(second.select(*at, F.lit(2).alias("side")))
    sides = rows.groupBy(*at).agg(F.bit_or("side").alias("sides"))
    return sides.select(*at, (F.col("sides") == 3).alias("both"), F.lit(True).alias("either"), (F.col("sides") != 3).alias("one"))


#: Fixed values of the structural similarity: reach and sigma of its Gaussian window, and its two constants.
SSIM_REACH, SSIM_SIGMA, SSIM_K1, SSIM_K2 = 5, 1.5, 0.01, 0.03


def ssim(first: DataFrame, second: DataFrame, keys: list[str], top: float = 255.0) -> DataFrame:
    """keys, ssim: mean structural similarity of two images (Wang et al. 2004), ``top`` being the range of values.

    One stencil carries the five weighted moments of both images.
    """
    window = [math.exp(-(d * d) / (2 * SSIM_SIGMA**2)) for d in range(-SSIM_REACH, SSIM_REACH + 1)]
    window = [w / sum(window) for w in window]
    both = first.select(*keys, "x", "y", F.col("v").cast("double").alias("a")).join(second.select(*keys, "x", "y", F.col("v").cast("double").alias("b")), [*keys, "x", "y"])
    moments = {"ua": lambda p: p["a"], "ub": lambda p: p["b"], "aa": lambda p: p["a"] * p["a"], "bb": lambda p: p["b"] * p["b"], "ab": lambda p: p["a"] * p["b"]}
    c1, c2 = (SSIM_K1 * top) ** 2, (SSIM_K2 * top) ** 2

    def similar(p: dict[str, list[Column]]) -> Column:
        m = {n: lines.weighted(p[n], window) for n in moments}
        va, vb, vab = m["aa"] - m["ua"] * m["ua"], m["bb"] - m["ub"] * m["ub"], m["ab"] - m["ua"] * m["ub"]
        return (2 * m["ua"] * m["ub"] + c1) * (2 * vab + c2) / ((m["ua"] * m["ua"] + m["ub"] * m["ub"] + c1) * (va + vb + c2))

    out = lines.stencil(lines.to_lines(both, keys, ["a", "b"]), keys, (SSIM_REACH, SSIM_REACH), lambda v: {n: lines.weighted([f(p) for p in v], window) for n, f in moments.items()}, similar)
    sums = out.select(*keys, F.aggregate("out", F.lit(0.0), lambda s, v: s + v).alias("s"), F.size("out").alias("n"))
    return sums.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("ssim"))
