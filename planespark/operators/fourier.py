"""Two-dimensional Fourier transforms of planes of any size, on image rows as arrays.

Rows are transformed as they lie; then the plane is turned, and its columns are
transformed as rows. What is multiplied in between stays in the turned layout.
Turning takes one shuffle, of blocks of columns. No plane has to fit a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planespark.operators import lines

#: Columns that are shuffled together.
BLOCK = 16


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def times(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conjugate(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def power(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def _across(rows: DataFrame, keys: list[str], inverse: bool) -> DataFrame:
    """Each row replaced by its transform; NumPy sees rows, many at a time, and never a plane. Rows stay in their partition."""

    def run(re: pa.Array, im: pa.Array) -> pa.Array:
        if not len(re):
            return pa.StructArray.from_arrays([re, im], names=["re", "im"])
        parts = [_table(p) for p in (re, im)]
        out = (np.fft.ifft if inverse else np.fft.fft)(parts[0] + 1j * parts[1], axis=1)
        return pa.StructArray.from_arrays([_lists(out.real), _lists(out.imag)], names=["re", "im"])

    done = F.arrow_udf(run, "re array<double>, im array<double>")
    split = rows.select(*keys, "y", F.transform("line", lambda c: c["re"]).alias("re"), F.transform("line", lambda c: c["im"]).alias("im"))
    return split.select(*keys, "y", done("re", "im").alias("_c")).select(*keys, "y", F.zip_with("_c.re", "_c.im", complex_of).alias("line"))


def _table(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of an array."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def _lists(rows: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(rows.shape[0] + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).ravel()))


def _turned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same plane with its columns as rows."""
    cells = rows.select(*keys, "y", F.posexplode("line").alias("at", "c"))
    column = F.sort_array(F.collect_list(F.struct("y", "c")))
    return cells.groupBy(*keys, F.col("at").alias("y")).agg(F.transform(column, lambda p: p["c"]).alias("line"))


def forward(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Turned lines of the transform of real or complex lines: row ``y`` holds frequency y along x, elements those along y."""
    if rows.schema["line"].dataType.elementType.typeName() != "struct":
        rows = rows.withColumn("line", F.transform("line", lambda v: complex_of(v, F.lit(0.0))))
    return _across(_turned(_across(rows, keys, False), keys), keys, False)


def backward(turned: DataFrame, keys: list[str]) -> DataFrame:
    """Complex lines whose transform the turned lines are."""
    return _across(_turned(_across(turned, keys, True), keys), keys, True)


def _real(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "y", F.transform("line", lambda c: c["re"]).alias("line"))


def shifted(px: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Place 0 in the middle, as quadrants change places."""
    return px.select(*keys, ((F.col("x") + width // 2) % width).alias("x"), ((F.col("y") + height // 2) % height).alias("y"), "v")


def two_to(n: float) -> int:
    return 1 << max(1, math.ceil(math.log2(n)))


def power_spectrum(px: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Pixels of the squared spectrum of each plane, filled up with its mean to a square: logarithms from 1 to 254, zero in the middle."""
    size = two_to(max(width, height))
    rows = lines.to_lines(px, keys)
    mean = px.groupBy(*keys).agg(F.avg("v").alias("_mean"))
    below = mean.select(*keys, F.explode(F.sequence(F.lit(height), F.lit(size - 1))).alias("y"), F.array().cast("array<double>").alias("line")) if size > height else None
    rows = rows.select(*keys, "y", F.transform("line", lambda v: v.cast("double")).alias("line"))
    rows = (rows.unionByName(below) if below is not None else rows).join(mean, keys)
    rows = rows.select(*keys, "y", F.concat("line", F.array_repeat("_mean", F.lit(size) - F.size("line"))).alias("line"))
    logs = forward(rows, keys).select(*keys, "y", F.transform("line", lambda c: F.log(F.greatest(power(c), F.lit(1.0)))).alias("line"))
    most = logs.groupBy(*keys).agg(F.max(F.array_max("line")).alias("_most"))
    level = F.transform("line", lambda v: F.when(F.col("_most") > 0, F.floor(v * 253.0 / F.col("_most") + 0.5) + 1).otherwise(1).cast("double"))
    flat = lines.to_pixels(logs.join(most, keys).withColumn("out", level), keys, {"out": "v"})
    return shifted(flat.select(*keys, F.col("y").alias("x"), F.col("x").alias("y"), "v"), keys, size, size)


def _mirrored(n: int, size: int) -> np.ndarray:
    """Places of an axis of n pixels that lies in the middle of a larger one, mirrored at its ends as often as that takes."""
    t = (np.arange(size) - (size - n) // 2) % (2 * n)
    return np.where(t < n, t, 2 * n - 1 - t)


def _blurs(n: int, size: int, spread: tuple[float, float]):
    """A function of rows of n pixels: the two Gaussians of each row (transforms exp(-(spread f)^2) of its mirrored row), and its mean."""
    places, first = _mirrored(n, size), (size - n) // 2
    weights = [np.exp(-np.square(np.fft.rfftfreq(size) * s)) for s in spread]

    def run(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [np.fft.irfft(np.fft.rfft(p[:, places], axis=1) * w, size, axis=1)[:, first : first + n] for p, w in zip((a, b), weights, strict=True)]

    return run, lambda rows: rows[:, places].mean(axis=1)


def band_passed(px: DataFrame, keys: list[str], width: int, height: int, large: float, small: float) -> DataFrame:
    """Pixels without structures larger than ``large`` and smaller than ``small`` pixels, by Gaussian edges; the mean stays.

    The plane lies in the middle of a square, mirrored at its edges. What the
    square's transform is multiplied by, exp(-(small f)^2) less exp(-((small^2 + large^2) f^2)) and
    1 at frequency 0, is a difference of two products of a function of each axis. So the
    rows take both of these, then the columns, without the square.
    """
    size = two_to(1.5 * max(width, height))
    spread = (small, math.hypot(small, large))

    def across(line: pa.Array) -> pa.Array:
        blur, mean = _blurs(width, size, spread)
        rows = _table(line) if len(line) else np.zeros((0, width))
        return pa.StructArray.from_arrays([*map(_blocked, blur(rows, rows)), pa.array(mean(rows))], names=["fine", "coarse", "mean"])

    def down(fine: pa.Array, coarse: pa.Array, means: pa.Array) -> pa.Array:
        blur, mean = _blurs(height, size, spread)
        columns = [_columns(c, height) for c in (fine, coarse)]
        a, b = blur(*(c.reshape(-1, height) for c in columns))
        over = mean(_table(means) if len(means) else np.zeros((0, height)))
        return _lists((a - b).reshape(len(means), -1) + over[:, None])

    rows = lines.to_lines(px, keys).select(*keys, "y", F.arrow_udf(across, "fine array<double>, coarse array<double>, mean double")("line").alias("r"))
    blocks = _blocks(rows.select(*keys, "y", "r.*"), keys, ["fine", "coarse"], "mean")
    out = F.arrow_udf(down, "array<double>")("_rows.fine", "_rows.coarse", "_rows.mean")
    flat = blocks.select(*keys, "_k", out.alias("out")).select(*keys, "_k", F.posexplode("out").alias("_at", "v"))
    at = F.col("_at")
    flat = flat.select(*keys, (F.col("_k") * BLOCK + F.floor(at / height)).cast("int").alias("x"), (at % height).alias("y"), "v")
    return flat.where(F.col("x") < width)


def _blocked(rows: np.ndarray) -> pa.Array:
    """Rows as lists, with zeros up to a multiple of BLOCK."""
    return _lists(np.pad(rows, ((0, 0), (0, -rows.shape[1] % BLOCK))))


def _blocks(rows: DataFrame, keys: list[str], arrays: list[str], *more: str) -> DataFrame:
    """keys, _k, _rows: the parts of a plane's rows in BLOCK columns, by y. What is shuffled is arrays."""
    cut = rows.select(*keys, "y", *arrays, *more, F.explode(F.sequence(F.lit(0), F.floor((F.size(arrays[0]) - 1) / BLOCK).cast("int"))).alias("_k"))
    part = F.struct("y", *(F.slice(c, F.col("_k") * BLOCK + 1, BLOCK).alias(c) for c in arrays), *more)
    return cut.groupBy(*keys, "_k").agg(F.sort_array(F.collect_list(part)).alias("_rows"))


def _columns(parts: pa.Array, height: int) -> np.ndarray:
    """(blocks, BLOCK, height) from a list of row parts for each block."""
    return parts.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(parts), height, BLOCK).transpose(0, 2, 1)


def product(first: DataFrame, second: DataFrame, keys: list[str], width: int, height: int, kind: str) -> DataFrame:
    """Pixels of the correlation, convolution or deconvolution of planes that share their keys; they wrap around, and the zero shift is in the middle.

    The planes are paired as image rows, while they are small. They are real, so that half of each spectrum gives the other.
    """
    ways = {"correlate": lambda p, q: p * np.conj(q), "convolve": lambda p, q: p * q, "deconvolve": lambda p, q: p * np.conj(q) / np.maximum(np.abs(q) ** 2, 1e-20)}
    names, half = ["a_re", "a_im", "b_re", "b_im"], width // 2 + 1

    def across(line: pa.Array, other: pa.Array) -> pa.Array:
        out = [np.fft.rfft(_table(p) if len(p) else np.zeros((0, width)), axis=1) for p in (line, other)]
        return pa.StructArray.from_arrays([_blocked(x) for p in out for x in (p.real, p.imag)], names=names)

    def down(*parts: pa.Array) -> pa.Array:
        p = [_columns(c, height) for c in parts]
        out = np.fft.ifft(ways[kind](np.fft.fft(p[0] + 1j * p[1], axis=2), np.fft.fft(p[2] + 1j * p[3], axis=2)), axis=2).transpose(0, 2, 1)
        rows = pa.StructArray.from_arrays([_lists(x.reshape(-1, BLOCK)) for x in (out.real, out.imag)], names=["re", "im"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * height), rows)

    def back(re: pa.Array, im: pa.Array) -> pa.Array:
        parts = [c.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)[:, :half] for c in (re, im)]
        return _lists(np.fft.irfft(parts[0] + 1j * parts[1], width, axis=1))

    pairs = lines.to_lines(first, keys).join(lines.to_lines(second, keys).withColumnRenamed("line", "other"), [*keys, "y"])
    kept = ", ".join(f"{n} array<double>" for n in names)
    blocks = _blocks(pairs.select(*keys, "y", F.arrow_udf(across, kept)("line", "other").alias("r")).select(*keys, "y", "r.*"), keys, names)
    columns = blocks.select(*keys, "_k", F.arrow_udf(down, "array<struct<re: array<double>, im: array<double>>>")(*(F.col(f"_rows.{n}") for n in names)).alias("_out"))
    parts = columns.select(*keys, "_k", F.posexplode("_out").alias("y", "c")).groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("_k", "c.re", "c.im"))).alias("_row"))
    flat = lines.to_pixels(parts.select(*keys, "y", F.arrow_udf(back, "array<double>")("_row.re", "_row.im").alias("out")), keys, {"out": "v"})
    return shifted(flat, keys, width, height)
