"""Histograms, statistics, projections, profiles and thresholds over long-form pixels.

Everything here is a group-by or a window over small histograms, so partial
aggregation happens before each shuffle and one very large plane costs no more
per task than many small ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planespark.operators import lines


def histogram(px: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v, n: exact counts of integer values."""
    return px.groupBy(*keys, "v").agg(F.count("*").alias("n"))


def binned(px: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """keys, bin, n: counts in equal bins from the plane's least to its largest value; NaN is dropped."""
    good = px.where(~F.isnan("v"))
    ends = good.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int"), F.lit(bins - 1))).otherwise(0)
    return good.join(ends, keys).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def basic() -> list[Column]:
    """count, mean, sd (sample; 0 for one pixel), min, max, skewness and excess kurtosis of v."""
    v = F.col("v").cast("double")
    return [F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis")]


def moments() -> list[Column]:
    """Centroid and centre of mass (pixel centres at .5), raw integrated density and the share of non-zero pixels."""
    v = F.col("v")
    return [(F.avg("x") + 0.5).alias("cx"), (F.avg("y") + 0.5).alias("cy"), (F.sum(F.col("x") * v) / F.sum(v) + 0.5).alias("mx"), (F.sum(F.col("y") * v) / F.sum(v) + 0.5).alias("my"), F.sum(v).alias("raw_density"), (100.0 * F.sum(F.when(v != 0, 1).otherwise(0)) / F.count("*")).alias("percent_area")]


def mode(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest of the most frequent values."""
    return hist.groupBy(*keys).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))


def cumulative(hist: DataFrame, keys: list[str], at: str = "v") -> DataFrame:
    """Adds ``below``, the count up to and with each value, and ``total``."""
    w = Window.partitionBy(*keys)
    return hist.withColumn("below", F.sum("n").over(w.orderBy(at).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))


def median(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The first value whose cumulative count passes half of all."""
    return cumulative(hist, keys).where(F.col("below") > F.col("total") / 2.0).groupBy(*keys).agg(F.min("v").alias("median"))


def projection(px: DataFrame, keys: list[str]) -> DataFrame:
    """Average, max, min, sum, sd and median over z at each x, y; NaN is left out of the average."""
    v = F.col("v").cast("double")
    return px.groupBy(*keys, "x", "y").agg(F.avg(F.when(~F.isnan(v), v)).alias("average"), F.max("v").alias("most"), F.min("v").alias("least"), F.sum("v").alias("total"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.expr("percentile(v, 0.5)").alias("median"))


def _mean_line(near: pa.Array) -> pa.Array:
    """Mean of the lists in each row, place by place."""
    inner = near.flatten()
    width = lines.widest(inner)
    v, there = lines.matrix(inner, width)
    first = np.concatenate([[0], np.cumsum(near.value_lengths().to_numpy(zero_copy_only=False))])[:-1].astype(np.int64)
    n = np.add.reduceat(there.astype(np.int64), first, axis=0) if len(first) else np.zeros((0, width))
    total = np.add.reduceat(v, first, axis=0) if len(first) else n
    return lines.lists(total / np.maximum(n, 1), n > 0)


def grouped_projection(px: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Average of each run of ``size`` slices, of pixels or of image rows: a group holds an image row of its slices."""
    if "line" in px.columns:
        by = [*keys, F.floor((F.col("z") - 1) / size).cast("int").alias("slab"), "y"]
        near = px.groupBy(*by).agg(F.collect_list("line").alias("_lines"))
        mean = F.arrow_udf(_mean_line, "array<double>")
        return near.select(*keys, "slab", "y", F.posexplode(mean("_lines")).alias("x", "average")).select(*keys, "slab", "x", "y", "average")
    return px.groupBy(*keys, F.floor((F.col("z") - 1) / size).cast("int").alias("slab"), "x", "y").agg(F.avg("v").alias("average"))


def profile(px: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Mean at each position of one axis (x, y, z or t); NaN is left out."""
    v = F.col("v").cast("double")
    return px.groupBy(*keys, axis).agg(F.avg(F.when(~F.isnan(v), v)).alias("mean"))


def otsu(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest value that makes the variance between the classes largest, found on running sums of the histogram."""
    w = Window.partitionBy(*keys)
    run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("n1", F.sum("n").over(run)).withColumn("s1", F.sum(F.col("n") * F.col("v")).over(run)).withColumn("n0", F.sum("n").over(w)).withColumn("s0", F.sum(F.col("n") * F.col("v")).over(w))
    gap = F.col("s1") * F.col("n0") - F.col("s0") * F.col("n1")
    between = F.when(F.col("n1") < F.col("n0"), gap.cast("double") * gap / (F.col("n1").cast("double") * (F.col("n0") - F.col("n1")))).otherwise(-1.0)
    return h.withColumn("between", between).groupBy(*keys).agg(F.min_by("v", F.struct(-F.col("between"), F.col("v"))).alias("level"))


def stretch(px: DataFrame, keys: list[str], saturated: float) -> DataFrame:
    """8-bit planes with ``saturated`` percent of the pixels cut off, half at each end, and the rest spread over 0..255."""
    c = cumulative(histogram(px, keys), keys)
    cut = F.floor(F.col("total") * saturated / 200.0)
    ends = c.groupBy(*keys).agg(F.min(F.when(F.col("below") > cut, F.col("v"))).alias("lo"), F.max(F.when(F.col("total") - F.col("below") + F.col("n") > cut, F.col("v"))).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")) + 0.5)))).otherwise(F.col("v"))
    return px.join(ends, keys).select(*keys, "x", "y", scaled.cast("int").alias("v"))


def equalise(px: DataFrame, keys: list[str], classic: bool = False) -> DataFrame:
    """8-bit planes equalised by running sums of (the roots of) the counts, half of each bin before and half after."""
    weight = F.col("n").cast("double") if classic else F.sqrt("n")
    w = Window.partitionBy(*keys)
    h = histogram(px, keys).withColumn("k", weight)
    h = h.withColumn("upto", F.sum("k").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("k").over(w))
    first, last = F.min("v").over(w) == F.col("v"), F.max("v").over(w) == F.col("v")
    at = (F.col("upto") - F.col("k") / 2) / F.col("all") * 255
    lut = h.withColumn("to", F.when(first, F.col("v") * 0).when(last, F.lit(255)).otherwise(F.floor(at + 0.5)).cast("int")).select(*keys, "v", "to")
    return px.join(lut, [*keys, "v"]).select(*keys, "x", "y", F.col("to").alias("v"))


def fractal(px: DataFrame, keys: list[str], sizes: tuple[int, ...] = (2, 3, 4, 6, 8, 12, 16, 32, 64)) -> DataFrame:
    """Occupied boxes of each size, from the corner of the foreground's bounding box, and the box-counting dimension."""
    on = px.where("v > 0")
    corner = on.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    boxes = on.join(corner, keys).select(*keys, F.explode(F.array(*map(F.lit, sizes))).alias("s"), "x", "y", "x0", "y0")
    counts = boxes.select(*keys, "s", F.floor((F.col("x") - F.col("x0")) / F.col("s")).alias("bx"), F.floor((F.col("y") - F.col("y0")) / F.col("s")).alias("by")).distinct().groupBy(*keys, "s").agg(F.count("*").alias("boxes"))
    return counts.groupBy(*keys).agg((-F.regr_slope(F.log("boxes"), F.log("s"))).alias("dimension"), F.max("boxes").alias("most_boxes"))


def summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows Mean, SD, Min and Max of numeric columns."""
    parts = {"Mean": F.avg, "SD": F.stddev_samp, "Min": F.min, "Max": F.max}
    one = rows.agg(*(f(c).cast("double").alias(f"{name}_{c}") for name, f in parts.items() for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("label"), *(F.col(f"{name}_{c}").alias(c) for c in columns)) for name in parts))).alias("row")).select("row.*")


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Histogram of a results column with bins of Scott's width (at least two)."""
    v = F.col(column).cast("double")
    ends = rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), (3.49 * F.stddev_samp(v) * F.pow(F.count(v), F.lit(-1 / 3))).alias("width"))
    ends = ends.select("lo", "hi", F.greatest(F.lit(2), F.floor((F.col("hi") - F.col("lo")) / F.col("width") + 0.5)).cast("int").alias("bins"))
    at = F.least(((v - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))).cast("int"), F.col("bins") - 1)
    return rows.where(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row of ends


def lanes(px: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Mean of each row of equal lanes side by side, and its share, in percent, of the lane's total."""
    rows = px.groupBy(*keys, F.floor(F.col("x") / width).cast("int").alias("lane"), "y").agg(F.avg("v").alias("mean"))
    total = F.sum("mean").over(Window.partitionBy(*keys, "lane"))
    return rows.withColumn("percent", F.when(total != 0, 100.0 * F.col("mean") / total).otherwise(0.0))
