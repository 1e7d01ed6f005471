"""WARC archives: one gzip member per record, written by tasks and read back sequentially."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planespark.llm.common import Workspace, join_hot

#: Payload from which equal payloads are stored once.
LEAST_REVISIT = 100
#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 32 << 20
#: Bytes given to the decompressor at a time.
READ_BYTES = 64 << 10
LEVEL = 4
#: All records carry the same date: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"


def classified(pages: DataFrame, work: Workspace) -> DataFrame:
    """page_id, url, html, digest, record_type and refers_to of each page.

    Of equal payloads of LEAST_REVISIT bytes or more, the one with the smallest
    page_id is the response and the others revisit it; rows that tie for the
    smallest id are all responses. Null html is empty; a null page_id revisits
    if another row has the payload. The first ids of payloads that occur more
    than once are pre-aggregated and written; however many copies one payload
    has, they are dealt evenly when they get their first id.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= LEAST_REVISIT
    first = work.save(rows.where(long).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1 and _first is not null"), "firsts")
    again = long & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    found = join_hot(rows, first, "digest", "_copies", ["page_id", "url"])
    return found.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def _header(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP headers, and so the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``classified`` as archives into ``folder``; the result (file, bytes, records) runs the writers once.

    The names hold the attempt of the task, so a lost attempt and its repeat
    (or two that run at once) never touch the same file. Spark saves the rows
    of one attempt a task alone: once the result is written, it is the list of
    the archives that count, and what other attempts left is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        done, out, size, count = [], None, 0, 0

        def close() -> None:
            nonlocal out, size, count
            out.close()
            done.append((name, size, count))
            out, size, count = None, 0, 0

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):05d}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                pack = zlib.compressobj(LEVEL, wbits=31)
                whole = pack.compress(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["record_type"], r["refers_to"])) + pack.flush()
                out.write(whole)
                size, count = size + len(whole), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["file", "bytes", "records"])

    return rows.mapInArrow(run, "file string, bytes long, records long")


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Decompressed content of each gzip member, fed to zlib chunk by chunk."""
    unpack, parts, fed = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            parts.append(unpack.decompress(chunk))
            fed = True
            chunk = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts, fed = zlib.decompressobj(31), [], False
    if fed:
        raise ValueError("the archive ends within a member")


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers (lower-case names), HTTP headers and payload of each record; lengths and digests are checked."""
    for member in members(chunks):
        head, gap, rest = member.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not gap or not lines[0].startswith("WARC/"):
            raise ValueError("a member does not start with a record")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise ValueError("content length and record differ")
        if "sha256:" + hashlib.sha256(block).hexdigest() != headers["warc-block-digest"]:
            raise ValueError("block digest and block differ")
        http, _, payload = block.partition(b"\r\n\r\n")
        if headers["warc-type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != headers["warc-payload-digest"]:
            raise ValueError("payload digest and payload differ")
        yield headers, http, payload


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _id(urn: str | None) -> int | None:
    inner = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(inner) if inner else None


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """file: the paths of all archives of a folder (none gives an empty table); their contents are not read for it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.col("path").alias("file"))


def read(files: DataFrame, folder: str = "") -> DataFrame:
    """Records of the archives named in the column ``file`` (in ``folder``, or whole paths); a broken archive raises.

    Each archive is one row and is read from the start in steps of READ_BYTES,
    so a task holds one record at a time. Revisits have no payload, but its
    length and digest. No file, no record.
    """
    count = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(_uri(f"{folder}/{name}" if folder else name))
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for headers, http, payload in records(iter(lambda: stream.read(READ_BYTES), b"")):  # noqa: B023
                        length = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                        revisit = headers["warc-type"] == "revisit"
                        rows.append((_id(headers["warc-record-id"]), headers.get("warc-target-uri"), length, headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"], _id(headers.get("warc-refers-to")), None if revisit else payload))
                        held += len(payload)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("file").repartition(max(count, 1), "file").mapInArrow(run, READ)


def _uri(path: str) -> str:
    """Spark writes local paths as file:/x, Arrow wants file:///x."""
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
