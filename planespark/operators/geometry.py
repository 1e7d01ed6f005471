"""Crops, flips, rotations, canvas changes, binning, montages and tilings: arithmetic on x, y and z."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crop(px: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    inside = px.where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def cuboid(px: DataFrame, x0: int, y0: int, z0: int, w: int, h: int, d: int) -> DataFrame:
    return crop(px.where(F.col("z").between(z0, z0 + d - 1)), x0, y0, w, h).withColumn("z", F.col("z") - z0 + 1)


def flip(px: DataFrame, axis: str, size: int) -> DataFrame:
    """Mirror along x or y (counted from 0) or z (counted from 1)."""
    return px.withColumn(axis, F.lit(size + (1 if axis in ("z", "t", "c") else -1)) - F.col(axis))


def rotate_left(px: DataFrame, width: int) -> DataFrame:
    return px.withColumns({"x": F.col("y"), "y": F.lit(width - 1) - F.col("x")})


def rotate_right(px: DataFrame, height: int) -> DataFrame:
    return px.withColumns({"x": F.lit(height - 1) - F.col("y"), "y": F.col("x")})


def canvas(px: DataFrame, keys: list[str], width: int, height: int, dx: int, dy: int, background: float = 0) -> DataFrame:
    """Planes placed at (dx, dy) on a canvas of another size; what they do not cover is background."""
    moved = px.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}).where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    grid = px.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("p")).select(*keys, (F.col("p") % width).alias("x"), (F.col("p") / width).cast("int").alias("y"))
    return grid.join(moved, [*keys, "x", "y"], "left").select(*keys, "x", "y", F.coalesce("v", F.lit(background)).alias("v"))


def translate(px: DataFrame, keys: list[str], width: int, height: int, dx: int, dy: int, background: float = 0) -> DataFrame:
    return canvas(px, keys, width, height, dx, dy, background)


def binned(px: DataFrame, keys: list[str], width: int, height: int, bx: int, by: int) -> DataFrame:
    """Average, median, min, max and sum of blocks; columns and rows that fill no block are dropped."""
    inside = px.where((F.col("x") < width // bx * bx) & (F.col("y") < height // by * by))
    return inside.groupBy(*keys, (F.col("x") / bx).cast("int").alias("x"), (F.col("y") / by).cast("int").alias("y")).agg(F.avg("v").alias("average"), F.expr("percentile(v, 0.5)").alias("median"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"))


def reslice(px: DataFrame, side: str = "top") -> DataFrame:
    """Planes XZ (``top``) or YZ (``left``): the old y (or x) becomes z from 1, the old z becomes y from 0."""
    if side == "top":
        return px.withColumns({"y": F.col("z") - 1, "z": F.col("y") + 1})
    return px.withColumns({"x": F.col("y"), "y": F.col("z") - 1, "z": F.col("x") + 1})


def montage(px: DataFrame, width: int, height: int, columns: int) -> DataFrame:
    """All slices on one plane, in rows of ``columns``."""
    k = F.col("z") - 1
    return px.withColumns({"x": F.col("x") + k % columns * width, "y": F.col("y") + F.floor(k / columns).cast("int") * height}).drop("z")


def unmontage(px: DataFrame, width: int, height: int, columns: int) -> DataFrame:
    """Slices of a montage whose tiles have the given size."""
    z = F.floor(F.col("y") / height).cast("int") * columns + F.floor(F.col("x") / width).cast("int") + 1
    return px.withColumns({"z": z, "x": F.col("x") % width, "y": F.col("y") % height})


def tiles(px: DataFrame, size: int, halo: int, width: int, height: int) -> DataFrame:
    """A row for each pixel and each tile that holds it, halo included; only pixels near a border are repeated."""
    span = lambda p, most: F.sequence(F.floor(F.greatest(F.lit(0), p - halo) / size).cast("int"), F.floor(F.least(F.lit(most - 1), p + halo) / size).cast("int"))
    return px.withColumn("tx", F.explode(span(F.col("x"), width))).withColumn("ty", F.explode(span(F.col("y"), height)))
