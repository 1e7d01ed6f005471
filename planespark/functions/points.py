"""Measures of lines of points, as expressions on array<struct<x, y>> columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(points: Column) -> Column:
    """Consecutive pairs of points."""
    n = F.size(points)
    return F.when(n > 1, F.arrays_zip(F.slice(points, F.lit(1), n - 1).alias("a"), F.slice(points, F.lit(2), n - 1).alias("b")))


def _span(s: Column) -> Column:
    return F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])


def length(points: Column) -> Column:
    """Length of a polyline; 0 for fewer than two points."""
    return F.coalesce(F.aggregate(F.transform(_steps(points), _span), F.lit(0.0), lambda s, d: s + d), F.lit(0.0))


def shoelace(points: Column) -> Column:
    """Area of the closed polygon."""
    around = F.transform(_steps(F.concat(points, F.slice(points, 1, 1))), lambda s: s["a"]["x"].cast("double") * s["b"]["y"] - s["b"]["x"].cast("double") * s["a"]["y"])
    return F.abs(F.coalesce(F.aggregate(around, F.lit(0.0), lambda s, d: s + d), F.lit(0.0))) / 2


def angle(points: Column) -> Column:
    """Degrees at the second of three points, 0 to 180."""
    p = [F.try_element_at(points, F.lit(k)) for k in (1, 2, 3)]
    turn = F.degrees(F.atan2(p[0]["y"] - p[1]["y"], p[0]["x"] - p[1]["x"]) - F.atan2(p[2]["y"] - p[1]["y"], p[2]["x"] - p[1]["x"]))
    turn = F.abs(turn)
    return F.when(turn > 180, 360 - turn).otherwise(turn)


def crossings(points: Column, y: Column) -> Column:
    """Where a level line meets the sides of the closed polygon, from left to right; the inside lies between the first and second, third and fourth."""
    sides = _steps(F.concat(points, F.slice(points, 1, 1)))
    across = F.filter(sides, lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y))
    return F.array_sort(F.transform(across, lambda s: s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"])))


def crossings_of_parts(parts: Column, y: Column) -> Column:
    """``crossings`` of all polygons of a composite region (array of point arrays) together, so that a polygon inside another one is a hole."""
    return F.array_sort(F.flatten(F.transform(parts, lambda p: crossings(p, y))))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once: what a function of points is given may itself be a function of points."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _bounds_centre(points: Column, axis: str) -> Column:
    return let(F.transform(points, lambda p: p[axis].cast("double")), lambda at: (F.array_min(at) + F.array_max(at)) / 2)


def _placed(points: Column, x, y) -> Column:
    return F.transform(points, lambda p: F.struct(x(p).alias("x"), y(p).alias("y")))


def _about_centre(points: Column, placed: Callable[[Column, Column, Column], Column]) -> Column:
    """``placed`` of the points and the middle of their bounds."""
    middle = lambda ps: F.struct(ps.alias("points"), _bounds_centre(ps, "x").alias("x"), _bounds_centre(ps, "y").alias("y"))
    return let(points, lambda ps: let(middle(ps), lambda m: placed(m["points"], m["x"], m["y"])))


def moved(points: Column, dx: Column, dy: Column) -> Column:
    return _placed(points, lambda p: p["x"] + dx, lambda p: p["y"] + dy)


def scaled(points: Column, sx: float, sy: float, centred: bool = True) -> Column:
    """Points farther from the middle of their bounds, or from the origin."""
    around = lambda ps, cx, cy: _placed(ps, lambda p: (p["x"] - cx) * sx + cx, lambda p: (p["y"] - cy) * sy + cy)
    return _about_centre(points, around) if centred else around(points, F.lit(0.0), F.lit(0.0))


def rotated(points: Column, degrees: float) -> Column:
    """Points turned clockwise (y points down) about the middle of their bounds."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return _about_centre(points, lambda ps, cx, cy: _placed(ps, lambda p: (p["x"] - cx) * c - (p["y"] - cy) * s + cx, lambda p: (p["x"] - cx) * s + (p["y"] - cy) * c + cy))
