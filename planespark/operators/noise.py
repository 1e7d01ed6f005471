"""Noise from the place of a pixel: a random number is a digest of the seed, the keys, the place and a counter.

So results are the same whatever the partitions, and after the loss of an executor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that make a number, and draws of a pixel at most.
DIGITS = 12
DRAWS = 64


def uniform(seed: int, parts: list[Column], draw: Column | int) -> Column:
    """A number in [0, 1) of the seed, the parts and the draw."""
    counter = draw if isinstance(draw, Column) else F.lit(draw)
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts), counter.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def gaussian(px: DataFrame, keys: list[str], sd: float, seed: int, top: int = 255) -> DataFrame:
    """v plus rounded normal noise; a pixel that would leave 0 to ``top`` draws again, up to DRAWS times, and then stays as it is."""
    parts = [*(F.col(k) for k in keys), F.col("x"), F.col("y")]

    def drawn(k: Column) -> Column:
        u, w = uniform(seed, parts, 2 * k), uniform(seed, parts, 2 * k + 1)
        normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * w)
        return F.col("v") + F.floor(normal * sd + 0.5)

    first = F.aggregate(F.sequence(F.lit(0), F.lit(DRAWS - 1)), F.lit(None).cast("double"), lambda found, k: F.when(found.isNotNull(), found).otherwise(_inside(drawn(k), top)))
    return px.select(*keys, "x", "y", F.coalesce(first, F.col("v").cast("double")).cast("int").alias("v"))


def _inside(v: Column, top: int) -> Column:
    return F.when(v.between(0, top), v.cast("double"))


def salt_and_pepper(px: DataFrame, keys: list[str], percent: float, seed: int, top: int = 255) -> DataFrame:
    """Each pixel becomes ``top`` or 0, half of them each, with the given chance in percent."""
    u = uniform(seed, [*(F.col(k) for k in keys), F.col("x"), F.col("y")], 0)
    share = percent / 100
    return px.select(*keys, "x", "y", F.when(u < share / 2, top).when(u < share, 0).otherwise(F.col("v")).cast("int").alias("v"))
