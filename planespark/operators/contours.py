"""Closed contours of masks by parallel list ranking, and what follows from them.

Each foreground pixel has four directed sides, the object on their right; sides
between two foreground pixels cancel. A side goes on to the one that starts where
it ends. Where four meet (two pixels touch at a corner) the turn decides: to the
left where corners join, to the right where they do not. Pointer doubling gives
every side the smallest side of its contour, and a second doubling its place in
it, in as many rounds of joins as the longest contour's length has binary digits.
Each round is written to the shared folder. No contour or plane has to fit a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planespark.operators import lines
from planespark.sources import scratch


def sides(px: DataFrame, keys: list[str], on: Column, width: int) -> DataFrame:
    """keys, id, way (0 east, 1 south, 2 west, 3 north), x, y where the side starts, x_end, y_end.

    ``id`` counts starting points row by row, four ways each. A row of keys, y is one image row; rows must be dense.
    """
    rows = lines.to_lines(px.select(*keys, "x", "y", on.alias("v")), keys)
    order = Window.partitionBy(*keys).orderBy("y")
    rows = rows.select(*keys, "y", "line", F.lag("line").over(order).alias("_up"), F.lead("line").over(order).alias("_down"))
    at = lambda array, i: F.coalesce(F.get(array, i), F.lit(False))
    y = F.col("y")

    def side(free: Column, way: int, i: Column, dx: int, dy: int, ex: int, ey: int) -> Column:
        return F.when(~free, F.struct(F.lit(way).alias("way"), (i + dx).alias("x"), (y + dy).alias("y"), (i + ex).alias("x_end"), (y + ey).alias("y_end")))

    def around(i: Column) -> Column:
        return F.array(side(at("_up", i), 0, i, 0, 0, 1, 0), side(at("line", i + 1), 1, i, 1, 0, 1, 1), side(at("_down", i), 2, i, 1, 1, 0, 1), side(at("line", i - 1), 3, i, 0, 1, 0, 0))

    inside = F.filter(lines.places("line"), lambda i: at("line", i))
    found = rows.select(*keys, F.explode(F.array_compact(F.flatten(F.transform(inside, around)))).alias("s")).select(*keys, "s.*")
    return found.withColumn("id", (F.col("y").cast("long") * (width + 1) + F.col("x")) * 4 + F.col("way"))


def ranked(found: DataFrame, keys: list[str], eight: bool) -> DataFrame:
    """``found`` sides with ``contour`` (the smallest id of theirs), ``place`` (0 at that side) and ``size``."""
    folder = scratch.folder(found.sparkSession, "contours")

    def save(df: DataFrame, name: str) -> DataFrame:
        return scratch.saved(df, f"{folder}/{name}")

    found = save(found, "sides")
    # Ways that a walk prefers after its own: as far to the left as can be, or to the right.
    turn = F.pmod(F.col("to") - F.col("way"), F.lit(4))
    choice = F.when(turn == 3, 0 if eight else 2).when(turn == 0, 1).otherwise(2 if eight else 0)
    starts = found.select(*keys, F.col("x").alias("x_end"), F.col("y").alias("y_end"), F.col("way").alias("to"), F.col("id").alias("next"))
    step = found.select(*keys, "id", "way", "x_end", "y_end").join(starts, [*keys, "x_end", "y_end"]).groupBy(*keys, "id").agg(F.min_by("next", choice).alias("next"))

    state, k = save(step.select(*keys, "id", "next", F.least("id", "next").alias("least")), "least0"), 0
    step = state.select(*keys, "id", "next")
    while True:  # after k rounds ``least`` covers 2 ** (k + 1) sides; when nothing changes it covers all
        ahead = state.select(*keys, F.col("id").alias("next"), F.col("next").alias("jump"), F.col("least").alias("ahead"))
        further = state.join(ahead, [*keys, "next"]).select(*keys, "id", F.col("jump").alias("next"), F.least("least", "ahead").alias("least"), (F.col("ahead") < F.col("least")).alias("moved"))
        k += 1
        further = save(further, f"least{k}")
        state = further.drop("moved")
        if further.where("moved").isEmpty():
            break
    named = state.select(*keys, "id", F.col("least").alias("contour"))

    # Steps to the smallest side, which ends the list.
    state = step.join(named, [*keys, "id"]).withColumn("left", F.lit(1).cast("long"))
    state, k = save(state.withColumn("next", F.when(F.col("next") != F.col("contour"), F.col("next"))), "left0"), 0
    while not state.where("next is not null").isEmpty():
        ahead = state.select(*keys, F.col("id").alias("next"), F.col("next").alias("jump"), F.col("left").alias("more"))
        k += 1
        state = save(state.join(ahead, [*keys, "next"], "left").select(*keys, "id", F.col("jump").alias("next"), "contour", (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), f"left{k}")
    size = state.where("id = contour").select(*keys, "contour", F.col("left").alias("size"))
    place = state.select(*keys, "id", "contour", "left").join(size, [*keys, "contour"])
    return found.join(place, [*keys, "id"]).withColumn("place", F.col("size") - F.col("left")).drop("left")


def corners(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """keys, contour, place, x, y, step: the points where a contour turns, with the length of the side that ends there.

    The first side of a contour starts at its topmost, leftmost point, which is a corner.
    """
    line = Window.partitionBy(*keys, "contour").orderBy("place")
    turns = ordered.withColumn("_before", F.lag("way").over(line)).where(F.col("_before").isNull() | (F.col("_before") != F.col("way")))
    last = F.lag("place").over(line)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.coalesce(F.col("place") - last, F.col("size") - F.max("place").over(whole))
    return turns.withColumn("step", step).select(*keys, "contour", "place", "x", "y", "step", "size")


def traced(px: DataFrame, keys: list[str], on: Column, width: int, eight: bool = True) -> DataFrame:
    """One row per contour: keys, contour, x0, y0 (its first point), outer, sides, corners, area, perimeter, points.

    An outer contour goes clockwise and has the area it encloses, that around a
    hole the other way round and a negative area. The perimeter is the number
    of sides, less 2 - sqrt 2 for each cut corner: of neighbouring corners with
    a side of one pixel between them only every second one is cut. ``points``
    are the corners in order, as ``x,y`` between blanks.
    """
    turns = corners(ranked(sides(px, keys, on, width), keys, eight), keys)
    line = Window.partitionBy(*keys, "contour").orderBy("place")
    number = F.row_number().over(line)
    turns = turns.withColumn("_n", number).withColumn("_x", F.lead("x").over(line)).withColumn("_y", F.lead("y").over(line))
    ends = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = turns.withColumns({"_x": F.coalesce("_x", F.first("x").over(ends)), "_y": F.coalesce("_y", F.first("y").over(ends))})
    begun = F.max(F.when((F.col("step") > 1) | (F.col("_n") == 1), F.col("_n"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    turns = turns.withColumn("_cut", (F.col("_n") - begun) % 2 == 0)
    text = F.concat_ws(",", "x", "y")
    rows = turns.groupBy(*keys, "contour").agg(
        F.min(F.when(F.col("_n") == 1, F.col("x"))).alias("x0"), F.min(F.when(F.col("_n") == 1, F.col("y"))).alias("y0"), F.max("size").alias("sides"), F.count("*").alias("corners"),
        F.sum(F.col("x") * F.col("_y") - F.col("_x") * F.col("y")).alias("_twice"), F.sum(F.col("_cut").cast("int")).alias("_cuts"), F.sort_array(F.collect_list(F.struct("_n", text.alias("t")))).alias("_points"),
    )
    perimeter = F.col("sides") - F.col("_cuts") * (2 - math.sqrt(2))
    points = F.array_join(F.transform("_points", lambda p: p["t"]), " ")
    return rows.select(*keys, "contour", "x0", "y0", (F.col("_twice") > 0).alias("outer"), "sides", "corners", (F.col("_twice") / 2).alias("area"), perimeter.alias("perimeter"), points.alias("points"))
