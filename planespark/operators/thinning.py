"""Skeletons of masks by alternating passes (Zhang and Suen 1984), on image rows as arrays.

A round is two stencils and is written to the shared folder; planes that no
longer change leave, so that the last rounds work on few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planespark.operators import lines
from planespark.sources import scratch


def _pass(rows: DataFrame, keys: list[str], first: bool) -> DataFrame:
    def keep(p: dict[str, list[Column]]) -> Column:
        n, ne, e, se, s, sw, w, nw = p["m"][0], p["r"][0], p["r"][1], p["r"][2], p["m"][2], p["l"][2], p["l"][1], p["l"][0]
        ring = [n, ne, e, se, s, sw, w, nw]
        turns = lines.total([(1 - a) * b for a, b in zip(ring, [*ring[1:], n], strict=True)])
        sides = (n * e * s == 0) & (e * s * w == 0) if first else (n * e * w == 0) & (n * s * w == 0)
        gone = lines.total(ring).between(2, 6) & (turns == 1) & sides
        return F.when(gone, 0).otherwise(p["m"][1])

    return lines.whole_lines(lines.stencil(rows, keys, (1, 1), lambda v: {"l": v[0], "m": v[1], "r": v[2]}, keep, outside=0), keys, "out")


def thinned(px: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """255 for the skeleton of the foreground, 0 else; outside the plane is background."""
    folder = scratch.folder(px.sparkSession, "thinning")
    rows, done, k = lines.to_lines(px.select(*keys, "x", "y", F.when(on, 1).otherwise(0).alias("v")), keys), [], 0
    while True:
        after = _pass(_pass(rows, keys, True), keys, False)
        both = rows.withColumnRenamed("line", "before").join(after, [*keys, "y"])
        both = scratch.saved(both, f"{folder}/round{k}")
        moved = both.groupBy(*keys).agg(F.max((F.col("before") != F.col("line")).cast("int")).alias("moved"))
        done.append(both.join(moved.where("moved = 0").select(*keys), keys, "left_semi").select(*keys, "y", "line"))
        rows = both.join(moved.where("moved = 1").select(*keys), keys, "left_semi").select(*keys, "y", "line")
        k += 1
        if rows.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return lines.to_pixels(out.withColumn("out", F.transform("line", lambda v: v * 255.0)), keys, {"out": "v"})
