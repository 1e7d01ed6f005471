"""Packing documents into token windows by minimum bin slack.

Every task packs the documents of its own partition, so nothing is shuffled.
Full windows are cut off long documents as they come. The remainders wait in a
pool, a multiset of lengths; for each window a subset-sum over the pool, kept
in the bits of one integer, finds the reachable total closest to the capacity,
and walking the steps back gives how often each length is taken. The longest
remainder always goes first, so that none waits for ever.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planespark.llm.bpe import codec
from planespark.llm.common import slices

PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The pool is packed when it holds the tokens of this many windows, down to half of them.
POOL_WINDOWS = 256
#: Sequences of one partition that an id leaves room for.
SEQUENCE_BITS = 40


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make the total closest to ``capacity`` from below, the longest one included.

    Bit t of an integer says that total t can be reached. Each length joins in
    portions of 1, 2, 4, ... copies; the search ends once the capacity itself
    is reached.
    """
    first = max(counts)
    reach, within = 1 << first, (1 << capacity + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), capacity // length)
        portion = 1
        while left > 0 and not reach >> capacity & 1:
            copies = min(portion, left)
            steps.append((length, copies, reach))
            reach |= reach << length * copies & within
            left -= copies
            portion *= 2
    total = reach.bit_length() - 1
    taken = {first: 1}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + copies
            total -= length * copies
    return taken


class Packer:
    """The windows of one partition."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.sequence = capacity, first_id
        self.pool: dict[int, deque] = {}
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        full = len(ids) // self.capacity * self.capacity
        for at in range(0, full, self.capacity):
            self._close([(key, at, ids[at : at + self.capacity], len(ids))])
        if full < len(ids):
            self._wait((key, full, ids[full:], len(ids)))
        if self.waiting >= POOL_WINDOWS * self.capacity:
            self.drain(POOL_WINDOWS * self.capacity // 2)

    def _wait(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]), deque()).append(piece)
        self.waiting += len(piece[2])

    def _take(self, length: int) -> tuple:
        piece = self.pool[length].popleft()
        if not self.pool[length]:
            del self.pool[length]
        self.waiting -= length
        return piece

    def _cut(self, most: int) -> tuple:
        """A piece of at most ``most`` tokens of the longest remainder; the rest waits on."""
        key, start, ids, n = self._take(max(self.pool))
        if len(ids) > most:
            self._wait((key, start + most, ids[most:], n))
        return key, start, ids[:most], n

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for key, start, ids, n in pieces:
            self.rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def _fill(self, size: int, pieces: list[tuple]) -> None:
        """Close a sequence of ``size`` tokens, cutting what still fits off waiting remainders."""
        left = size - sum(len(x[2]) for x in pieces)
        while left and self.pool:
            pieces.append(self._cut(left))
            left -= len(pieces[-1][2])
        self._close(pieces)

    def drain(self, down_to: int) -> None:
        while self.waiting >= max(down_to, self.capacity):
            taken = fullest({k: len(v) for k, v in self.pool.items()}, self.capacity)
            self._fill(self.capacity, [self._take(k) for k, n in taken.items() for _ in range(n)])

    def finish(self) -> None:
        """The last tokens, less than a window, go into sequences whose sizes are powers of two: these need no padding."""
        self.drain(0)
        while self.waiting:
            self._fill(1 << self.waiting.bit_length() - 1, [])

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text (null: empty) and then ``end_id``, so an
    empty text has one token. Pieces of a document lie in one partition's
    sequences; rows with equal keys are documents of their own. Sequences hold
    ``capacity`` tokens, except for the last of each partition, whose sizes are
    powers of two. Other columns do not pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << SEQUENCE_BITS)
        c = codec(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, offsets = c.encode_column(batch.column(1).slice(a, b - a))
                keys = batch.column(0).slice(a, b - a).to_pylist()
                ids = np.insert(ids, offsets[1:], end_id)
                ends = (offsets + np.arange(len(offsets))).tolist()
                for k, x in enumerate(keys):
                    packer.add(x, ids[ends[k] : ends[k + 1]])
                yield packer.batch()
        packer.finish()
        yield packer.batch()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, PIECES)
    return rows.withColumnRenamed("key", key)
