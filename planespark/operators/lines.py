"""Image rows as arrays: keys, y, line (a value a pixel).

A plane is then a table of a row for each image row, so what crosses a shuffle is
arrays, not pixels. What lies beside a pixel in its row is read from the array by
expressions; what lies above and below by windows over rows, cut into strips of
STRIP columns so that a wide plane is the work of many tasks. No plane has to fit
a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of a strip.
STRIP = 1024
#: Weights up to which a sum is written out; longer ones are added up tap by tap over whole arrays.
WRITTEN_OUT = 64

Rows = Callable[[list[Column]], dict[str, Column]]
Join = Callable[[dict[str, list[Column]]], Column]


def places(array: Column | str) -> Column:
    """0 to the size of an array (that is not empty) less one."""
    return F.sequence(F.lit(0), F.size(array) - 1)


def to_lines(px: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """Lines of dense pixels; elements are v, or structs of ``values``. A group holds one image row. A table of lines is returned as it is."""
    if "line" in px.columns:
        return px
    row = F.sort_array(F.collect_list(F.struct("x", *(values or ["v"]))))
    one = (lambda p: p["v"]) if values is None else (lambda p: F.struct(*(p[c].alias(c) for c in values)))
    return px.groupBy(*keys, "y").agg(row.alias("_row")).select(*keys, "y", F.transform("_row", one).alias("line"))


def to_pixels(lines: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Pixels of lines or strips; ``columns`` names the value of each array column."""
    start = F.col("x0") if "x0" in lines.columns else F.lit(0)
    zipped = F.arrays_zip(*(F.col(c).alias(n) for c, n in columns.items())) if len(columns) > 1 else F.transform(next(iter(columns)), lambda v: F.struct(v.alias(next(iter(columns.values())))))
    rows = lines.select(*keys, "y", start.alias("_x0"), F.posexplode(zipped).alias("_at", "_p"))
    names = list(columns.values())
    return rows.select(*keys, (F.col("_x0") + F.col("_at")).alias("x"), "y", *(F.col("_p").getField(n).alias(n) for n in names))


def whole_lines(strips: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Lines of strips: the parts of each image row put together again."""
    parts = F.sort_array(F.collect_list(F.struct("x0", F.col(column).alias("part"))))
    return strips.groupBy(*keys, "y").agg(parts.alias("_parts")).select(*keys, "y", F.flatten(F.transform("_parts", lambda p: p["part"])).alias("line"))


def padded(line: str, reach: int, outside: float | None = None) -> Column:
    """The array with its ends repeated, or with a fixed value beyond them."""
    first = F.get(F.col(line), F.lit(0)) if outside is None else F.lit(outside)
    last = F.get(F.col(line), F.size(line) - 1) if outside is None else F.lit(outside)
    return F.concat(F.array_repeat(first, reach), F.col(line), F.array_repeat(last, reach)) if reach else F.col(line)


def strips(lines: DataFrame, keys: list[str], columns: list[str], width: int = STRIP) -> DataFrame:
    """keys, y, x0 and the parts of each array column from x0 on."""
    cut = lines.withColumn("x0", F.explode(F.sequence(F.lit(0), F.size(columns[0]) - 1, F.lit(width))))
    return cut.select(*keys, "y", "x0", *(F.slice(c, F.col("x0") + 1, width).alias(c) for c in columns))


def stencil(lines: DataFrame, keys: list[str], reach: tuple[int, int], rows: Rows, join: Join, outside: float | None = None) -> DataFrame:
    """keys, y, x0, line, out: ``rows`` makes named values of what lies at x - rx .. x + rx, ``join`` the result of those at y - ry .. y + ry.

    Beyond the edge of a plane the nearest edge pixel is read, or ``outside``.
    """
    rx, ry = reach
    wide = lines.select(*keys, "y", "line", padded("line", rx, outside).alias("_p"))
    part = lambda i: F.struct(*(c.alias(f"_{n}") for n, c in rows([F.get("_p", i + k) for k in range(2 * rx + 1)]).items()))
    cut = strips(wide.select(*keys, "y", "line", F.transform(places("line"), part).alias("_q")), keys, ["line", "_q"])
    order = Window.partitionBy(*keys, "x0").orderBy("y")
    plane = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if outside is None:
        cut = cut.withColumns({"_top": F.first("_q").over(plane), "_end": F.last("_q").over(plane)})
    else:
        names = list(rows([F.lit(outside)] * (2 * rx + 1)).items())
        blank = F.transform("_q", lambda _: F.struct(*(c.alias(f"_{n}") for n, c in names)))
        cut = cut.withColumns({"_top": blank, "_end": blank})
    beside = {f"_q{d + ry}": F.coalesce((F.lag("_q", -d) if d < 0 else F.lead("_q", d)).over(order), F.col("_top" if d < 0 else "_end")) if d else F.col("_q") for d in range(-ry, ry + 1)}
    tall = cut.select(*keys, "y", "x0", "line", *(c.alias(n) for n, c in beside.items()))
    names = list(rows([F.lit(0)] * (2 * rx + 1)))
    value = lambda i: join({n: [F.get(f"_q{k}", i).getField(f"_{n}") for k in range(2 * ry + 1)] for n in names})
    return tall.select(*keys, "y", "x0", "line", F.transform(places("line"), value).alias("out"))


def total(parts: list[Column]) -> Column:
    out = parts[0]
    for c in parts[1:]:
        out = out + c
    return out


def weighted(values: list[Column], weights: list[float]) -> Column:
    used = [v if w == 1 else v * F.lit(w) for v, w in zip(values, weights, strict=True) if w]
    return total(used) if used else F.lit(0)


def blurred(lines: DataFrame, keys: list[str], kernel: list[float], outside: float | None = None) -> DataFrame:
    """keys, y, x0, line, out: the weighted sum along both axes, by one odd kernel.

    A short kernel is written out. A long one is added up tap by tap, a whole
    array at a time, and above and below a window holds the rows it reaches, so
    that the plan has the same size for every kernel.
    """
    reach = len(kernel) // 2
    if len(kernel) <= WRITTEN_OUT:
        return stencil(lines, keys, (reach, reach), lambda v: {"g": weighted(v, kernel)}, lambda p: weighted(p["g"], kernel), outside)
    weights, taps = F.array(*map(F.lit, kernel)), F.sequence(F.lit(0), F.lit(len(kernel) - 1))

    def summed(line: str, shifted: Callable[[Column], Column]) -> Column:
        zeros = F.transform(line, lambda _: F.lit(0.0))
        return F.aggregate(taps, zeros, lambda acc, k: F.zip_with(acc, shifted(k), lambda a, b: a + b * F.get(weights, k)))

    wide = lines.select(*keys, "y", "line", padded("line", reach, outside).alias("_p"))
    wide = wide.select(*keys, "y", "line", summed("line", lambda k: F.slice("_p", k + 1, F.size("line"))).alias("_q"))
    cut = strips(wide, keys, ["line", "_q"])
    order = Window.partitionBy(*keys, "x0").orderBy("y")
    plane = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blank = F.transform("_q", lambda _: F.lit(outside).cast("double"))
    ends = (F.first("_q").over(plane), F.last("_q").over(plane)) if outside is None else (blank, blank)
    tall = cut.withColumns({"_top": ends[0], "_end": ends[1], "_near": F.collect_list("_q").over(order.rowsBetween(-reach, reach)), "_before": F.row_number().over(order) - 1, "_size": F.count("*").over(plane).cast("int")})
    lacks = lambda have: F.greatest(F.lit(0), F.lit(reach) - have)
    around = F.concat(F.array_repeat("_top", lacks(F.col("_before"))), F.col("_near"), F.array_repeat("_end", lacks(F.col("_size") - 1 - F.col("_before"))))
    tall = tall.select(*keys, "y", "x0", "line", around.alias("_around"))
    return tall.select(*keys, "y", "x0", "line", summed("line", lambda k: F.get("_around", k)).alias("out"))


def summed_rows(rows: DataFrame, by: list[str], order: str, column: str, kernel: list[float]) -> DataFrame:
    """``column``, an array in every row, becomes the weighted sum of those of the rows around it; beyond the first and the last row they are repeated."""
    reach = len(kernel) // 2
    line = Window.partitionBy(*by).orderBy(order)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = {"_near": F.collect_list(column).over(line.rowsBetween(-reach, reach)), "_first": F.first(column).over(whole), "_last": F.last(column).over(whole), "_before": F.row_number().over(line) - 1, "_n": F.count("*").over(whole).cast("int")}
    rows = rows.withColumns(near)
    lacks = lambda have: F.greatest(F.lit(0), F.lit(reach) - have)
    around = F.concat(F.array_repeat("_first", lacks(F.col("_before"))), F.col("_near"), F.array_repeat("_last", lacks(F.col("_n") - 1 - F.col("_before"))))
    weights, zeros = F.array(*map(F.lit, kernel)), F.transform(column, lambda _: F.lit(0.0))
    rows = rows.withColumn("_around", F.arrays_zip(around.alias("r"), weights.alias("w"))).withColumn("_zeros", zeros)
    out = F.aggregate("_around", F.col("_zeros"), lambda acc, t: F.zip_with(acc, t["r"], lambda a, v: a + v * t["w"]))
    return rows.withColumn(column, out).drop("_near", "_first", "_last", "_before", "_n", "_around", "_zeros")


# Image rows as NumPy arrays, for functions over a batch of rows (F.arrow_udf): no plane is put together, and a row stays in its partition.


def matrix(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (as doubles, 0 beyond the end of a shorter list) of one list a row, and where there are any; a null has none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    there = np.arange(width) < sizes[:, None]
    out = np.zeros(there.shape)
    out[there] = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out, there


def lists(values: np.ndarray, there: np.ndarray) -> pa.ListArray:
    """The lists of the values which are there."""
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[there].astype(np.float64)))


def widest(*columns: pa.ListArray) -> int:
    """Size of the longest list."""
    return max((int(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max(initial=0)) for c in columns), default=0)
