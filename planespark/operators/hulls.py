"""Convex hulls and diameters of objects, from the two ends of each of their image rows.

Only the leftmost and the rightmost pixel of an object's row can be corners of
its hull, so an object comes down to two points a row before anything is put in
order. The hull is then one pass over the points in an array expression: a point
cuts off as many of the last corners as no longer turn the same way, and
those are found by their turn as seen from the point, since the chain is convex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planespark.operators.particles import labelled

_POINTS = "array<struct<x: double, y: double>>"


def _turn(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - b["y"]) - (b["y"] - a["y"]) * (p["x"] - b["x"])


def chain(points: Column) -> Column:
    """Half of a hull: the points, which come in order along it, without those that do not turn to one side."""

    def step(corners: Column, p: Column) -> Column:
        turns = F.filter(F.sequence(F.lit(1), F.size(corners) - 1), lambda k: _turn(F.get(corners, k - 1), F.get(corners, k), p) < 0)
        kept = F.when(F.size(corners) < 2, corners).otherwise(F.slice(corners, 1, F.coalesce(F.array_max(turns), F.lit(0)) + 1))
        return F.concat(kept, F.array(p))

    return F.aggregate(points, F.lit(None).cast(_POINTS), lambda corners, p: F.when(corners.isNull(), F.array(p)).otherwise(step(corners, p)))


def shapes(px: DataFrame, keys: list[str], on: Column, width: int, height: int, eight: bool = True) -> DataFrame:
    """keys, label (from 1, by first pixels), area, hull_area, solidity, feret, feret_angle, min_feret, on pixel corners.

    The diameter is the largest distance of two corners of the hull, its angle
    that of the pair which comes first by place, in degrees from 0 to 180; the
    width is the smallest extent across an edge of the hull.
    """
    runs = labelled(px, keys, on, width, height, eight)
    rows = runs.groupBy(*keys, "label", "y").agg(F.min("x0").alias("a"), (F.max("x1") + 1).alias("b"), F.sum("n").alias("n"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    # Down the left side of an object, and up its right side.
    lists = rows.groupBy(*keys, "label").agg(F.sum("n").alias("area"), F.sort_array(F.collect_list(F.struct("y", "a", "b"))).alias("r"))
    left = F.flatten(F.transform("r", lambda r: F.array(point(r["a"], r["y"]), point(r["a"], r["y"] + 1))))
    right = F.flatten(F.transform(F.reverse("r"), lambda r: F.array(point(r["b"], r["y"] + 1), point(r["b"], r["y"]))))
    hull = lists.select(*keys, "label", "area", chain(left).alias("_l"), chain(right).alias("_r")).select(*keys, "label", "area", F.concat("_l", "_r").alias("c"))
    after = F.concat(F.slice("c", 2, F.size("c") - 1), F.slice("c", 1, 1))
    hull = hull.withColumn("e", F.arrays_zip(F.col("c").alias("p"), after.alias("q")))
    area = F.abs(F.aggregate("e", F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2
    pairs = F.flatten(F.transform("c", lambda p, i: F.transform(F.filter("c", lambda q, j: j > i), lambda q: F.struct(((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])).alias("d"), _angle(p, q).alias("angle")))))
    across = F.array_min(F.transform("e", lambda e: F.array_max(F.transform("c", lambda p: F.abs(_turn(e["p"], e["q"], p)))) / F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])))
    longest = F.array_max(pairs)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    out = hull.select(*keys, F.col("label").alias("first"), "area", area.alias("hull_area"), longest.alias("_d"), across.alias("min_feret"))
    return out.select(*keys, number.alias("label"), "area", "hull_area", (F.col("area") / F.col("hull_area")).alias("solidity"), F.sqrt("_d.d").alias("feret"), F.col("_d.angle").alias("feret_angle"), "min_feret")


def _angle(p: Column, q: Column) -> Column:
    """Direction of a pair, up being positive, from 0 up to 180."""
    turn = F.degrees(F.atan2(p["y"] - q["y"], q["x"] - p["x"]))
    return F.when(turn < 0, turn + 180).when(turn >= 180, turn - 180).otherwise(turn)

