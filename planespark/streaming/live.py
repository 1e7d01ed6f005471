"""Measurements of planes and frames as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planespark.sources import scratch


def arriving(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files (a folder, or a pattern of file names), with the schema of those there now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def frame_profile(rows: DataFrame, time: str, keys: list[str], value: Column, width: str, late: str, slide: str | None = None) -> DataFrame:
    """The running profile of windows that are over, for ``append``; rows later than ``late`` behind the newest are dropped, and windows still open are not returned."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a time with zone
    return running_profile(rows.withWatermark(time, late), time, keys, value, width, slide)


def running_profile(rows: DataFrame, time: str, keys: list[str], value: Column, width: str, slide: str | None = None) -> DataFrame:
    """n, mean, least and most per window of event time and key, over all rows seen so far in any order; the state is one row a window and key."""
    at = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(at.alias("at"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("at.start").alias("start"), F.col("at.end").alias("stop"), *keys, "n", "mean", "least", "most")


def running_projection(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Projections over all planes seen so far, per position; the state is one row a position."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(value).alias("most"), F.min(value).alias("least"), F.sum(value).alias("total"), F.avg(value).alias("average"))


def running_histogram(rows: DataFrame, keys: list[str], bin: Column) -> DataFrame:  # noqa: A002
    """Counts per bin over all rows seen so far."""
    return rows.groupBy(*keys, bin.alias("bin")).agg(F.count("*").alias("n"))


def append(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Process what has arrived, append final rows to a table in the shared folder, and return the table.

    A restart with the same ``path`` goes on where the last one ended; files of a batch are listed in the sink's log once.
    """
    path = path or scratch.folder(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def latest(stream: DataFrame, name: str, keys: list[str], path: str | None = None) -> DataFrame:
    """Process what has arrived and return the last version of each key.

    Each batch writes only the rows that it changed, under its own number, so a
    batch that is done again after a failure replaces what it wrote. A restart
    with the same ``path`` goes on where the last one ended. ``upkeep`` folds old
    batches together.
    """
    path = path or scratch.folder(stream.sparkSession, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return _last_versions(stream.sparkSession, stream.schema, keys, path)


def _last_versions(spark: SparkSession, schema: T.StructType, keys: list[str], path: str) -> DataFrame:
    try:
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/changes")
    except AnalysisException as e:  # nothing has arrived yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "batch").alias("_row"))
    return last.select("_row.*")


def upkeep(spark: SparkSession, schema: T.StructType, keys: list[str], path: str, batch: int) -> None:
    """Fold all batches of a state written by ``latest`` into one, numbered ``batch`` (the last that was written); to be called between runs."""
    _last_versions(spark, schema, keys, path).write.mode("overwrite").parquet(f"{path}/folded")
    folded = spark.read.schema(schema).parquet(f"{path}/folded")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/changes")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [x.getPath() for x in files.listStatus(at)]
    folded.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
    for x in old:
        if x.getName() != f"batch={batch}":
            files.delete(x, True)
