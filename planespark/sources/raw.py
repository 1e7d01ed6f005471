"""Raw binary pixels: planes to bytes, and files of bytes to planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: NumPy codes of the pixel types, without byte order.
KINDS = {"8": "u1", "16s": "i2", "16u": "u2", "32i": "i4", "32u": "u4", "32f": "f4", "64f": "f8"}


def _dtype(kind: str, little: bool) -> np.dtype:
    return np.dtype(("<" if little else ">") + KINDS[kind])


def encode(planes: DataFrame, kind: str, little: bool = False) -> DataFrame:
    """The keys of each plane and ``content``: its pixels, row by row; values out of range are clamped, integers truncated."""
    code = _dtype(kind, little)
    keys = [f for f in planes.schema.fields if f.name not in ("width", "height", "pixels")]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)

    def one(pixels) -> bytes:
        a = np.asarray(pixels, float)
        if code.kind != "f":
            limits = np.iinfo(code)
            a = np.clip(np.trunc(np.nan_to_num(a)), limits.min, limits.max)
        return a.astype(code).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[f.name for f in keys]].assign(content=[one(p) for p in batch["pixels"]])

    return planes.mapInPandas(run, f"{head}, content binary")


def decode(files: DataFrame, kind: str, width: int, height: int, offset: int = 0, count: int = 1, gap: int = 0, little: bool = False) -> DataFrame:
    """``count`` planes of each row's ``content``: they begin at ``offset`` and have ``gap`` bytes between them.

    Bytes that a short content lacks read as 0. Result: the other columns, z (from 1), width, height, pixels.
    """
    code = _dtype(kind, little)
    size = width * height * code.itemsize
    keys = [f for f in files.schema.fields if f.name != "content"]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(count):
                at = offset + k * (size + gap)
                pixels = [np.frombuffer((c or b"")[at : at + size].ljust(size, b"\0"), code).astype(float) for c in batch["content"]]
                yield batch[[f.name for f in keys]].assign(z=k + 1, width=width, height=height, pixels=pixels)

    return files.mapInPandas(run, f"{head}, z int, width int, height int, pixels array<double>")


def folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of every file of a folder whose name matches the pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
