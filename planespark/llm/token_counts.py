"""Token counts through a digest cache: only contents that no stored count covers are encoded, once each."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planespark.llm.bpe import Codec, codec
from planespark.llm.common import Workspace, join_hot, shared_dir, slices, unused

CACHE_SCHEMA = "content string, n_tokens long, tokenizer string"
#: Texts travel to the task that encodes them at this level of compression.
PACK_LEVEL = 3


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file: another version of a tokenizer has other counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def shared_cache(spark: SparkSession, path: str) -> str:
    """The cache of a tokenizer version that all runs with the same shared folder find again."""
    return f"{shared_dir(spark).rstrip('/')}/token-counts/{tokenizer_digest(path)}"


def normalised(c: Codec, text: str) -> list[str]:
    """The text as the tokenizer sees it before it splits: plain parts normalised, special strings between them as they are."""
    normaliser = c.tokenizer.normalizer
    if normaliser is None:
        return [text]
    special = sorted((x.content for x in c.tokenizer.get_added_tokens_decoder().values()), key=lambda x: (-len(x), x))
    parts = re.split(f"({'|'.join(map(re.escape, special))})", text) if special else [text]
    return [x if k % 2 else normaliser.normalize_str(x) for k, x in enumerate(parts)]


def content_digest(parts: list[str]) -> str:
    """SHA-256 of the parts; of a single one it is that of its UTF-8 bytes."""
    raw = [x.encode() for x in parts]
    return hashlib.sha256(raw[0] if len(raw) == 1 else b"".join(b"%d:" % len(x) + x for x in raw)).hexdigest()


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts of one tokenizer version; the cache is partitioned by it. An empty frame where there is no cache yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("content", "n_tokens")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "content string, n_tokens long")


def _keyed(docs: DataFrame, path: str, text: str, digest: str) -> DataFrame:
    """``docs`` with the digest of the normalised text: by Spark where nothing is normalised, else beside the tokenizer."""
    if codec(path).tokenizer.normalizer is None:
        return docs.withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return _digested(docs, text, digest, path)


def fill(spark: SparkSession, docs: DataFrame, path: str, cache: str, text: str = "text") -> None:
    """Encode each content of ``docs`` that has no count yet, once, and append the counts to the cache.

    One text a digest, combined before the shuffle, meets the stored digests.
    Two runs that append the same digest at once do no harm: counts are equal.
    """
    version = tokenizer_digest(path)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=PACK_LEVEL)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packer.compress(x.encode()) for x in part.column(1).to_pylist()], pa.binary())], names=["content", "packed"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, unpack = codec(path), zstandard.ZstdDecompressor()
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                texts = pa.array([unpack.decompress(x).decode() for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.count_column(texts), pa.int64())], names=["content", "n_tokens"])

    keyed = _keyed(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), path, "text", "content")
    texts = keyed.select("content", "text").mapInArrow(pack, "content string, packed binary")
    misses = texts.groupBy("content").agg(F.any_value("packed").alias("packed")).join(stored(spark, cache, version).select("content"), "content", "left_anti")
    fresh = misses.mapInArrow(encode, "content string, n_tokens long").withColumn("tokenizer", F.lit(version))
    fresh.write.mode("append").partitionBy("tokenizer").parquet(cache)


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, cache: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the column ``out``: ids that the vocabulary's library gives for each whole text (null: empty).

    The content digest is SHA-256 of the normalised text (a vocabulary that
    normalises nothing has the text itself). Contents without a stored count
    are encoded and appended to the cache first; the counts are then joined to
    all rows, copies of one content dealt evenly. Copies, ties and repeated
    runs so cost one look-up. Columns of ``docs`` may have any names; one named
    ``out`` is replaced. An empty table gives an empty one.
    """
    fill(spark, docs, path, cache, text)
    rows = docs.drop(out)
    digest, weight = unused(rows, "content"), unused(rows, "_copies")
    keyed = _keyed(rows, path, text, digest)
    copies = keyed.groupBy(digest).agg(F.count("*").alias(weight))
    counts = stored(spark, cache, tokenizer_digest(path)).groupBy(F.col("content").alias(digest)).agg(F.max("n_tokens").alias(out))
    counts = Workspace(spark, "token-counts").save(counts.join(copies, digest), "counts")
    return join_hot(keyed, counts, digest, weight, [digest, rows.columns[0]]).select(*rows.columns, out)


def _digested(rows: DataFrame, text: str, digest: str, path: str) -> DataFrame:
    """``rows`` with the digest of the normalised text."""
    at, names = rows.columns.index(text), [*rows.columns, digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([content_digest(normalised(c, x or "")) for x in part.column(at).to_pylist()], pa.string())], names=names)

    return rows.mapInArrow(run, rows.withColumn(digest, F.lit("")).schema)
