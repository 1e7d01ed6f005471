"""Tags of the slices of a series: what is the same, what is missing, how positions follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def consistency(rows: DataFrame, keys: list[str], tags: list[str]) -> DataFrame:
    """keys, tag, distinct values, missing, and whether the tag is there and the same on every slice.

    Counts per value come first, so a tag that varies with every slice costs no more than its rows.
    """
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for t in tags))).alias("t"))
    counts = long.groupBy(*keys, "t.tag", "t.value").agg(F.count("*").alias("n"))
    absent = F.col("value").isNull()
    out = counts.groupBy(*keys, "tag").agg(F.count("value").alias("values"), F.coalesce(F.sum(F.when(absent, F.col("n"))), F.lit(0)).alias("missing"))
    return out.withColumn("consistent", (F.col("values") == 1) & (F.col("missing") == 0))


def spacing(rows: DataFrame, keys: list[str], position: str, tolerance: float = 1e-6) -> DataFrame:
    """Steps between the positions of a series in ascending order: their number, mean, least, most, and whether they are uniform."""
    step = F.col(position) - F.lag(position).over(Window.partitionBy(*keys).orderBy(position))
    out = rows.where(F.col(position).isNotNull()).select(*keys, step.alias("step")).groupBy(*keys).agg(F.count("step").alias("steps"), F.avg("step").alias("mean"), F.min("step").alias("least"), F.max("step").alias("most"))
    return out.withColumn("uniform", F.coalesce(F.col("most") - F.col("least") <= tolerance, F.lit(True)))


def sorted_slices(rows: DataFrame, series: list[str], order: str, number: str) -> DataFrame:
    """``z`` from 1 by the image number of each slice, ties in the given order; a series in which a slice lacks the number stays in that order."""
    of = Window.partitionBy(*series)
    whole = F.min(F.col(number).isNotNull()).over(of)
    return rows.withColumns({"_given": F.row_number().over(of.orderBy(order)), "_whole": whole}).withColumn("z", F.row_number().over(of.orderBy(F.when(F.col("_whole"), F.col(number)), "_given"))).drop("_given", "_whole")
