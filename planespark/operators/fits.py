"""Curve fits of all groups side by side.

Polynomials are one aggregation of power sums and a small solve in array
expressions. Other curves are fitted by damped least squares (Levenberg and
Marquardt): a round is one grouped aggregation of the normal equations at each
group's trial parameters, combined before its shuffle, and a solve for the next
trial; groups that have converged leave. What is kept a group is one row,
written to the shared folder each round, so that a group of any size is never in
one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planespark.sources import scratch

#: Rounds at most; share of the squared error below which a gain is none; rounds without gain that end a group.
ROUNDS = 60
GAIN = 1e-13
IDLE = 3
#: Step of the central differences, relative to a parameter.
STEP = 1e-6

Params = list[Column]


@dataclass(frozen=True)
class Model:
    """A curve of ``size`` parameters, and where its fit starts: from the group's x0, x1 (ends), y0, y1 (values there), lo, hi, mean_x, mean_y, x_hi (place of the highest) and the lines through logarithms."""

    size: int
    value: Callable[[Params, Column], Column]
    start: Callable[[dict[str, Column]], Params]


def _rate(s: dict[str, Column]) -> Column:
    return 3.0 / F.greatest(s["x1"] - s["x0"], F.lit(1e-9))


MODELS = {
    "exponential": Model(2, lambda p, x: p[0] * F.exp(p[1] * x), lambda s: [F.coalesce(F.exp(s["exp_0"]), s["mean_y"]), F.coalesce(s["exp_1"], F.lit(0.0))]),
    "power": Model(2, lambda p, x: p[0] * F.pow(x, p[1]), lambda s: [F.coalesce(F.exp(s["pow_0"]), s["mean_y"]), F.coalesce(s["pow_1"], F.lit(0.0))]),
    "log": Model(2, lambda p, x: p[0] * F.log(p[1] * x), lambda s: [s["log_1"], F.exp(s["log_0"] / s["log_1"])]),
    "exp_offset": Model(3, lambda p, x: p[0] * F.exp(-p[1] * x) + p[2], lambda s: [s["y0"] - s["y1"], _rate(s), s["y1"]]),
    "exp_recovery": Model(3, lambda p, x: p[0] * (1 - F.exp(-p[1] * x)) + p[2], lambda s: [s["y1"] - s["y0"], _rate(s), s["y0"]]),
    "exp_recovery_plain": Model(2, lambda p, x: p[0] * (1 - F.exp(-p[1] * x)), lambda s: [s["y1"], _rate(s)]),
    "chapman": Model(3, lambda p, x: p[0] * F.pow(1 - F.exp(-p[1] * x), p[2]), lambda s: [s["hi"] * 1.1, _rate(s), F.lit(1.0)]),
    "gaussian": Model(4, lambda p, x: p[0] + (p[1] - p[0]) * F.exp(-(x - p[2]) * (x - p[2]) / (2.0 * p[3] * p[3])), lambda s: [s["lo"], s["hi"], s["x_hi"], (s["x1"] - s["x0"]) / 4]),
    "gaussian_plain": Model(3, lambda p, x: p[0] * F.exp(-(x - p[1]) * (x - p[1]) / (2.0 * p[2] * p[2])), lambda s: [s["hi"], s["x_hi"], (s["x1"] - s["x0"]) / 4]),
    "rodbard": Model(4, lambda p, x: p[3] + (p[0] - p[3]) / (1.0 + F.pow(x / p[2], p[1])), lambda s: [s["y0"], F.lit(1.0), s["mean_x"], s["y1"]]),
    "gamma_variate": Model(4, lambda p, x: F.when(p[0] >= x, 0.0).otherwise(p[1] * F.pow(x - p[0], p[2]) * F.exp(-(x - p[0]) / p[3])), lambda s: [s["x0"] - (s["x_hi"] - s["x0"]) / 10, s["hi"] / F.greatest(s["x_hi"] - s["x0"], F.lit(1.0)) * math.e, F.lit(1.0), F.greatest(s["x_hi"] - s["x0"], F.lit(1.0))]),
    "log2": Model(3, lambda p, x: p[0] + p[1] * F.log(x - p[2]), lambda s: [s["y0"], (s["y1"] - s["y0"]) / F.log((s["x1"] - s["x0"]) + 2), s["x0"] - 1]),
}


def solved(rows: Column, n: int) -> Column:
    """The solution of n linear equations, each an array of its factors and the right side, by elimination without exchange (for normal equations)."""

    def cleared(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)
        scaled = F.transform(pivot, lambda v: v / F.nullif(F.get(pivot, k), F.lit(0.0)))
        return F.transform(m, lambda row, i: F.when(i == k, scaled).otherwise(F.zip_with(row, scaled, lambda v, w: v - w * F.get(row, k))))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, cleared), lambda row: F.get(row, F.lit(n)))


def polynomials(rows: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame:
    """keys, n, p (coefficients from the constant on), r2. Groups with too few different x have null coefficients; rows with a null or NaN x or y are left out.

    Powers are those of x less its mean, over its deviation, so that sums of high powers stay of one size.
    """
    data = _numbers(rows, keys, x, y)
    place = data.groupBy(*keys).agg(F.avg("x").alias("_mean"), F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0)).alias("_sd"), F.count("*").alias("n"), F.countDistinct("x").alias("_different"), F.avg("y").alias("_level"))
    t = (F.col("x") - F.col("_mean")) / F.col("_sd")
    power = lambda k: F.pow(t, F.lit(float(k))) if k else F.lit(1.0)
    off = F.col("y") - F.col("_level")
    sums = data.join(place, keys).groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("_mean", "_sd", "n", "_different", "_level")), *(F.sum(power(k)).alias(f"_s{k}") for k in range(2 * degree + 1)), *(F.sum(power(k) * off).alias(f"_t{k}") for k in range(degree + 1)), F.sum(off * off).alias("_sst"))
    matrix = F.array(*(F.array(*(F.col(f"_s{i + j}") for j in range(degree + 1)), F.col(f"_t{i}")) for i in range(degree + 1)))
    sums = sums.withColumn("_c", F.when(F.col("_different") > degree, solved(matrix, degree + 1)))
    c = [F.get("_c", F.lit(j)) / F.pow("_sd", F.lit(float(j))) for j in range(degree + 1)]
    terms = [[c[j] * float(math.comb(j, k)) * F.pow(-F.col("_mean"), F.lit(float(j - k))) for j in range(k, degree + 1)] for k in range(degree + 1)]
    explained = F.lit(0.0)
    for j in range(degree + 1):
        explained = explained + F.get("_c", F.lit(j)) * F.col(f"_t{j}")
    p = [sum(part[1:], part[0]) for part in terms]
    p[0] = p[0] + F.col("_level")
    return sums.select(*keys, "n", F.when(F.col("_c").isNotNull(), F.array(*p)).alias("p"), F.when(F.col("_c").isNotNull() & (F.col("_sst") > 0), F.least(F.lit(1.0), explained / F.col("_sst"))).alias("r2"))


def _numbers(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    data = rows.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return data.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def _places(data: DataFrame, keys: list[str]) -> DataFrame:
    lx, ly = F.when(F.col("x") > 0, F.log("x")), F.when(F.col("y") > 0, F.log("y"))
    line = lambda name, a, b: [F.regr_intercept(a, b).alias(f"{name}_0"), F.regr_slope(a, b).alias(f"{name}_1")]
    return data.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min_by("y", F.struct("x", "y")).alias("y0"), F.max_by("y", F.struct("x", "y")).alias("y1"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        F.max_by("x", F.struct("y", "x")).alias("x_hi"), F.count("*").alias("n"), *line("exp", ly, F.col("x")), *line("pow", ly, lx), *line("log", F.col("y"), lx),
    )


def iterated(rows: DataFrame, keys: list[str], x: str, y: str, model: Model | str, start: list[float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """keys, n, p (parameters), sse (sum of squared residuals), tries, converged.

    ``model`` is a name of MODELS or a Model of your own; ``start`` replaces its
    starting point. A group whose starting error is not a number, or that has
    fewer rows than parameters, has null parameters. Rows with a null or NaN x or y are left out.
    """
    model = MODELS[model] if isinstance(model, str) else model
    spark, folder, m = rows.sparkSession, scratch.folder(rows.sparkSession, "fits"), model.size

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    data = save(_numbers(rows, keys, x, y), "data")
    places = _places(data, keys)
    first = [F.lit(float(v)) for v in start] if start else model.start({c: F.col(c) for c in places.columns})
    nothing = F.lit(None).cast("array<array<double>>")
    state = places.select(*keys, "n", F.array(*(c.cast("double") for c in first)).alias("trial"), F.lit(None).cast("array<double>").alias("p"), F.lit(None).cast("double").alias("sse"), nothing.alias("normal"), F.lit(1e-3).alias("damp"), F.lit(0).alias("idle"), F.lit(0).alias("tries"))
    state = save(state, "state0")
    ended = []
    for k in range(1, rounds + 1):
        state = save(_next(data, keys, state, model), f"state{k}")
        over = (F.col("idle") >= IDLE) | F.col("sse").isNull() | (F.col("n") < m) | (F.col("sse") == 0)
        ended.append(state.where(over))
        state = state.where(~over)
        if state.isEmpty():
            break
    out = state.withColumn("converged", F.lit(False))
    for rows_of in ended:
        out = out.unionByName(rows_of.withColumn("converged", F.col("sse").isNotNull() & (F.col("n") >= m)))
    fits = F.col("sse").isNotNull() & (F.col("n") >= m)
    return out.select(*keys, "n", F.when(fits, F.col("p")).alias("p"), F.when(fits, F.col("sse")).alias("sse"), "tries", "converged")


def _next(data: DataFrame, keys: list[str], state: DataFrame, model: Model) -> DataFrame:
    """One round: the error and the normal equations at each trial, whether it is kept, and the next trial."""
    m = model.size
    p = [F.get("trial", F.lit(k)) for k in range(m)]
    r = F.col("y") - model.value(p, F.col("x"))
    step = [F.greatest(F.abs(v), F.lit(1e-3)) * STEP for v in p]
    slope = [(model.value([*p[:k], p[k] + step[k], *p[k + 1 :]], F.col("x")) - model.value([*p[:k], p[k] - step[k], *p[k + 1 :]], F.col("x"))) / (2 * step[k]) for k in range(m)]
    at = data.join(state.select(*keys, "trial"), keys).select(*keys, r.alias("_r"), *(c.alias(f"_j{k}") for k, c in enumerate(slope)))
    sums = at.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_r")).alias("_sse"), *(F.sum(F.col(f"_j{i}") * F.col(f"_j{j}")).alias(f"_a{i}{j}") for i in range(m) for j in range(i, m)), *(F.sum(F.col(f"_j{i}") * F.col("_r")).alias(f"_g{i}") for i in range(m)))
    normal = F.array(*(F.array(*(F.col(f"_a{min(i, j)}{max(i, j)}") for j in range(m)), F.col(f"_g{i}")) for i in range(m)))
    now = state.join(sums.select(*keys, "_sse", normal.alias("_normal")), keys)
    real = F.col("_sse").isNotNull() & ~F.isnan("_sse") & (F.col("_sse") < float("inf"))
    better = real & (F.col("sse").isNull() | (F.col("_sse") < F.col("sse")))
    gained = better & (F.col("sse").isNull() | (F.col("sse") - F.col("_sse") > GAIN * F.col("sse")))
    now = now.select(
        *keys, "n", F.when(better, F.col("trial")).otherwise(F.col("p")).alias("p"), F.when(better, F.col("_sse")).otherwise(F.col("sse")).alias("sse"), F.when(better, F.col("_normal")).otherwise(F.col("normal")).alias("normal"),
        F.when(better, F.greatest(F.col("damp") / 10, F.lit(1e-12))).otherwise(F.col("damp") * 10).alias("damp"), F.when(gained, 0).when(better | (F.col("damp") > 1e6), F.col("idle") + 1).otherwise(F.col("idle")).alias("idle"), (F.col("tries") + 1).alias("tries"),
    )
    damped = F.transform("normal", lambda row, i: F.transform(row, lambda v, j: F.when(i == j, v * (1 + F.col("damp")) + 1e-300).otherwise(v)))
    return now.withColumn("_d", damped).withColumn("trial", F.zip_with("p", solved(F.col("_d"), m), lambda a, d: a + F.coalesce(d, F.lit(0.0)))).drop("_d")
