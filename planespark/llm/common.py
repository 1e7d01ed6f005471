"""Shared helpers: scratch tables in the shared folder, Arrow text buffers, checks of columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step inside a task works on.
SLICE_BYTES = 8 << 20


#: Spark's setting by which the shuffle files of an execution go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys of a table whose rows are dealt by broadcast in ``join_hot``, and parts that their rows are dealt into.
HOT_KEYS = 1000
SALTS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session on this machine alone (tests) gets a
    temporary folder; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="planespark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not, whatever the case of its letters."""
    taken = {x.lower() for x in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key; a left join), whatever share of the rows one key has.

    ``weight`` is the column of ``table`` that says how many rows have the key.
    The HOT_KEYS heaviest keys are broadcast (a fixed number of short rows) and
    their rows dealt evenly by ``spread``, as are rows with a null key; all
    other rows meet the table in a shuffle. ``table`` should be a written one.
    """
    names = [x for x in table.columns if x != key]
    packed = table.select(F.col(key).alias("_key"), F.struct(*names).alias("_values"), F.col(weight).alias("_weight"))
    hot = packed.orderBy(F.desc("_weight"), "_key").limit(HOT_KEYS).select("_key", F.col("_values").alias("_hot"))
    out = rows.withColumn("_key", F.col(key)).join(F.broadcast(hot), "_key", "left")
    even = F.col("_hot").isNotNull() | F.col("_key").isNull()
    out = out.withColumn("_salt", F.when(even, 1 + F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0))
    cold = packed.select("_key", F.lit(0).cast("long").alias("_salt"), F.col("_values").alias("_cold"))
    out = out.join(cold, ["_key", "_salt"], "left")
    return out.select(*rows.columns, *(F.when(F.col("_hot").isNotNull(), F.col("_hot")[x]).otherwise(F.col("_cold")[x]).alias(x) for x in names))


class Workspace:
    """Parquet tables of one query under a folder of its own in the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks of one
    stage, never the stages before the table. Shuffle files that led to a table
    go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            self._drop(name)

    def _drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets (n + 1), from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64) - int(offsets[0])


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch, each of about ``most`` bytes of text (one long text makes a range of its own)."""
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end
        at = end


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
