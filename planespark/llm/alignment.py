"""Alignment of two tokenizers by an event sweep.

Every token of A and of B is an event at the byte where it ends. Runs of up to
BLOCK events of one side are a row (ids alone: a token's length follows from its
id). The rows of both sides are united, dealt by document, sorted by document and
offset inside the partitions, and streamed through a state machine. It holds the
tokens since the last place where A and B both ended, and the runs that have
begun; a document of any length passes through it. A common end closes a group;
each distinct end between two common ones closes a link, since the bytes before
it belong to one token of A and one of B.

A link's count is the number of documents that hold its pair of ids. Counts are
added up in the tasks before they are shuffled. The HOT most frequent pairs and
the highest count of each A id (bounded by the vocabulary) go to all tasks; links
of other pairs meet their counts in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planespark.llm.bpe import Codec
from planespark.llm.common import Workspace, list_array, slices, text_bytes

#: Events of one row at most.
BLOCK = 2048
#: Most frequent pairs that go to all tasks.
HOT = 1 << 18
#: Links after which a document's links are added up, and pairs after which a task hands on its counts.
CHUNK = 1 << 16
PARTIAL = 1 << 21
#: Text that one step of a task encodes.
STEP_BYTES = 4 << 20
#: Ids of B are below this, so a pair of ids is one 32-bit number.
SPAN = 1 << 15
_SPACE = 32


class Plain(Codec):
    """A byte-level vocabulary that takes special strings inside texts as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        if not self.bytewise:
            raise ValueError(f"{path} is not byte-level")
        self.tokenizer.encode_special_tokens = True
        self.tokens = self.token_texts()


class Pieces(Codec):
    """A sentencepiece vocabulary. None of its pieces has a space after another character, so units start at such spaces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        ids = range(self.processor.get_piece_size())
        pieces = [self.processor.id_to_piece(k) for k in ids]
        if len(pieces) > SPAN or any("▁" in x.lstrip("▁") for x in pieces):
            raise ValueError(f"no unit rule for the pieces of {path}")
        self.tokens = pa.array([bytes([int(x[3:5], 16)]) if self.processor.is_byte(k) else x.replace("▁", " ").encode() for k, x in zip(ids, pieces, strict=True)], pa.binary())
        self._forget()

    def _cuts(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, offsets = text_bytes(column)
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw):
            cut[1:-1] = (raw[1:] == _SPACE) & (raw[:-1] != _SPACE)
        cut[offsets] = True
        return raw, offsets, np.flatnonzero(cut)

    def _plain(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._encode_other(units.to_pylist())

    def _encode_other(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lone = [self.processor.piece_to_id("▁")]
        found = [x or lone for x in self.processor.encode([x[1:] for x in units], num_threads=1)]  # a unit's first space is put there by the library, but for a lone one
        return np.array([i for x in found for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


_ONCE: dict[tuple[str, str], Codec] = {}


def _kept(kind: type[Codec], path: str) -> Codec:
    """One vocabulary a worker."""
    if (kind.__name__, path) not in _ONCE:
        _ONCE[kind.__name__, path] = kind(path)
    return _ONCE[kind.__name__, path]


def _sizes(tokens: pa.Array) -> np.ndarray:
    return pc.binary_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)


def _same(ids: np.ndarray, ends: np.ndarray, tokens: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the joined tokens of each row are its bytes."""
    joined, starts = text_bytes(tokens.take(pa.array(ids)))
    at = starts[ends]
    if np.array_equal(at, offsets) and np.array_equal(joined, raw):
        return np.ones(len(offsets) - 1, bool)
    return np.array([np.array_equal(joined[a:b], raw[c:d]) for a, b, c, d in zip(at, at[1:], offsets, offsets[1:], strict=False)], bool)


def events(rows: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """row, id, side (0: the document itself, 1: A, 2: B), offset (end of the first event) and ids of the runs of (row, id, text)."""
    kind = "row long, id long, side int, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [_kept(Plain, path_a), _kept(Pieces, path_b)]
        for batch in batches:
            for x, y in slices(batch.column(2), STEP_BYTES):
                part = batch.slice(x, y - x)
                filled = pc.fill_null(part.column(2), "")
                row, ids = part.column(0), part.column(1)
                number = row.to_numpy(zero_copy_only=False)
                text = pc.binary_join_element_wise(pa.scalar(" "), filled, "")
                raw, offsets = text_bytes(text)
                encoded = [c.encode_column(text) for c in coders]
                good = pc.binary_length(filled).to_numpy(zero_copy_only=False) > 0
                for c, (tokens, ends) in zip(coders, encoded, strict=True):
                    good &= _same(tokens, ends, c.tokens, raw, offsets)
                out = [(number, ids, np.zeros(len(part), np.int32), np.full(len(part), -1), pa.array([b""] * len(part), pa.binary()))]
                for side, (c, (tokens, ends)) in enumerate(zip(coders, encoded, strict=True), 1):
                    size = _sizes(c.tokens)[tokens]
                    place = np.cumsum(size)
                    begin = np.concatenate([np.arange(a, b, block) for a, b in zip(ends[:-1][good], ends[1:][good], strict=True)] or [np.zeros(0, np.int64)])
                    owner = np.searchsorted(ends, begin, "right") - 1
                    stop = np.minimum(begin + block, ends[owner + 1])
                    short = tokens.astype(np.uint16)
                    first = place[begin] - np.concatenate([[0], place])[ends[owner]]
                    out.append((number[owner], ids.take(pa.array(owner)), np.full(len(begin), side, np.int32), first, pa.array([short[a:b].tobytes() for a, b in zip(begin, stop, strict=True)], pa.binary())))
                for columns in out:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["row", "id", "side", "offset", "ids"])

    return rows.select("row", "id", "text").mapInArrow(run, kind)


class Sweep:
    """The state machine of one document: ends and ids since the last common end, for A and for B."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes = sizes
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def push(self, side: int, offset: int, ids: np.ndarray) -> None:
        size = self.sizes[side][ids]
        self.ends[side] = np.concatenate([self.ends[side], offset - size[0] + np.cumsum(size)])
        self.ids[side] = np.concatenate([self.ids[side], ids.astype(np.int64)])

    def close(self, before: int | None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray] | None:
        """Common ends before an offset (None: all), with the places of A and B after each, the ids up to the last one, and the links' codes."""
        (ea, eb), (ia, ib) = self.ends, self.ids
        common = np.intersect1d(ea, eb, assume_unique=True)
        if before is not None:
            common = common[common < before]
        if not len(common):
            return None
        cuts = [np.searchsorted(e, common) + 1 for e in (ea, eb)]
        na, nb = cuts[0][-1], cuts[1][-1]
        every = np.union1d(ea[:na], eb[:nb])
        codes = ia[np.searchsorted(ea[:na], every)] * SPAN + ib[np.searchsorted(eb[:nb], every)]
        done = [ia[:na], ib[:nb]]
        self.ends, self.ids = [ea[na:], eb[nb:]], [ia[na:], ib[nb:]]
        return common, cuts, done, codes


class Links:
    """Pairs of ids of a document with their numbers of links, added up as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, codes: np.ndarray) -> None:
        self.parts.append((codes, np.ones(len(codes), np.int64)))
        self.held += len(codes)
        if self.held > CHUNK:
            self.parts = [self.total()]
            self.held = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(self.parts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, times = (np.concatenate([p[k] for p in parts]) for k in range(2))
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(times, first) if len(first) else times


def _packed(codes: np.ndarray, times: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(codes, prepend=0), times]).astype(np.uint32).tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32).astype(np.int64)
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:]


def _spelled(sizes: int, ends: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids as text, inside a run and at the end of one."""
    return np.array([f"{k}," for k in range(sizes)], object), np.array([f"{k}{ends}" for k in range(sizes)], object)


class Spelling:
    """``a1,a2|b1;a3|b2,b3`` of closed groups."""

    def __init__(self, size_a: int, size_b: int):
        self.a, self.b = _spelled(size_a, "|"), _spelled(size_b, ";")

    def text(self, cuts: list[np.ndarray], done: list[np.ndarray]) -> str:
        na, nb = len(done[0]), len(done[1])
        out = np.empty(na + nb, object)
        starts = [np.concatenate([[0], c[:-1]]) for c in cuts]
        width = [np.diff(np.append(s, n)) for s, n in zip(starts, (na, nb), strict=True)]
        for (inside, last), ids, cut, shift in ((self.a, done[0], cuts[0], np.repeat(starts[1], width[0])), (self.b, done[1], cuts[1], np.repeat(cuts[0], width[1]))):
            words = inside[ids]
            words[cut - 1] = last[ids[cut - 1]]
            out[np.arange(len(ids)) + shift] = words
        return "".join(out.tolist())


def _streamed(batches: Iterator[pa.RecordBatch], sizes) -> Iterator[tuple]:
    """(row, id, None) where a document begins, then what the state machine closes, in order."""
    at, sweep, rest = None, None, [False, False]
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for row, key, side, offset, data in zip(*columns, strict=True):
            if row != at:
                if sweep is not None and (closed := sweep.close(None)):
                    yield (at, None, closed)
                at, sweep = row, Sweep(sizes)
                yield (row, key, None)
                rest = [False, False]
            if side:
                if all(rest) and (closed := sweep.close(offset)):
                    yield (at, None, closed)
                sweep.push(side - 1, offset, np.frombuffer(data, np.uint16))
                rest[side - 1] = True
    if sweep is not None and (closed := sweep.close(None)):
        yield (at, None, closed)


def _swept(sizes, shapes):
    kind = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, out, now = Spelling(*shapes), [], None

        def batch() -> pa.RecordBatch:
            types = [pa.int64()] * 6 + [pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=kind)

        def finish() -> None:
            row, key, counts, digest, links, held = now
            if counts[0]:
                digest.update(held[:-1].encode())
            out.append((row, key, *counts, digest.hexdigest() if counts[0] else "", _packed(*links.total())))

        for row, key, closed in _streamed(batches, sizes):
            if closed is None:
                if now:
                    finish()
                    if len(out) >= 500:
                        yield batch()
                        out.clear()
                now = [row, key, [0, 0, 0, 0], hashlib.sha256(), Links(), ""]
                continue
            common, cuts, done, codes = closed
            for k, more in enumerate((len(done[0]), len(done[1]), len(common), len(codes))):
                now[2][k] += more
            now[3].update(now[5].encode())
            now[5] = spelling.text(cuts, done)
            now[4].add(codes)
        if now:
            finish()
        if out:
            yield batch()

    return run


def groups(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The groups themselves: key, start and end (bytes of space + text), a_ids and b_ids; one row a group, in any order."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sizes = tuple(_sizes(c.tokens) for c in (_kept(Plain, path_a), _kept(Pieces, path_b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, start = None, 0
        for _, key_of, closed in _streamed(batches, sizes):
            if closed is None:
                name, start = key_of, 0
                continue
            common, cuts, done, _ = closed
            lists = [list_array(ids.astype(np.int32), np.append(0, cut)) for ids, cut in zip(done, cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(common), pa.int64()), pa.array(np.append(start, common[:-1])), pa.array(common), *lists], names=["id", "start", "end", "a_ids", "b_ids"])
            start = int(common[-1])

    swept = _dealt(events(rows, path_a, path_b, block)).mapInArrow(run, "id long, start long, end long, a_ids array<int>, b_ids array<int>")
    return swept.withColumnRenamed("id", key)


def _dealt(found: DataFrame) -> DataFrame:
    return found.repartition("row").sortWithinPartitions("row", "offset", "side")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the task hold each pair."""
    parts, held = [], 0

    def out() -> pa.RecordBatch:
        codes, k = _summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(k)], names=["pair", "k"])

    for batch in batches:
        for data in batch.column(0).to_pylist():
            codes, _ = _unpacked(data)
            parts.append((codes, np.ones(len(codes), np.int64)))
            held += len(codes)
        if held > PARTIAL:
            parts = [_summed(parts)]
            held = len(parts[0][0])
            if held > PARTIAL // 2:
                yield out()
                parts, held = [], 0
    yield out()


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes space + text, B adds the space itself; neither knows special
    strings. A row whose text is null or empty, or does not come back from the
    joined tokens of either side, has no tokens: zeros and an empty digest.
    Rows are documents of their own, whatever their key: repeated rows count
    each, and a null key stays. Other columns do not pass. An empty table gives
    an empty one.
    """
    work = Workspace(spark, "alignment")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    coders = (_kept(Plain, path_a), _kept(Pieces, path_b))
    sizes, shapes = tuple(_sizes(c.tokens) for c in coders), tuple(len(c.tokens) for c in coders)
    swept = _dealt(events(rows, path_a, path_b, block)).mapInArrow(_swept(sizes, shapes), "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")
    swept = work.save(swept, "swept")

    counts = swept.select("links").mapInArrow(_counted, "pair long, k long").groupBy("pair").agg(F.sum("k").alias("k"))
    counts = work.save(counts, "counts")
    best = counts.groupBy((F.col("pair") / F.lit(SPAN)).cast("int").alias("a")).agg(F.max("k").alias("k")).toPandas()  # one row an A id at most
    highest = np.zeros(shapes[0], np.int64)
    highest[best["a"].to_numpy(np.int64)] = best["k"].to_numpy(np.int64)
    top = counts.orderBy(F.desc("k"), "pair").limit(hot).toPandas()
    order = np.argsort(top["pair"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64)[order], top["k"].to_numpy(np.int64)[order], highest))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, k, highest = shared.value
        for batch in batches:
            best, total, cold = [], [], []
            for data in batch.column(batch.schema.names.index("links")).to_pylist():
                codes, times = _unpacked(data)
                at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                found = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                count, n = k[at[found]], times[found]
                best.append(int(n[count == highest[codes[found] // SPAN]].sum()))
                total.append(int((count * n).sum()))
                cold.append([{"pair": p, "n": m} for p, m in zip(codes[~found].tolist(), times[~found].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(best, pa.int64()), pa.array(total, pa.int64()), pa.array(cold, kind)], names=[*batch.schema.names[:7], "n_best", "count_sum", "cold"])

    found = swept.mapInArrow(look_up, "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, cold array<struct<pair: long, n: long>>")
    if counts.count() > len(top):
        found = work.save(found, "found")
        cold = found.select("row", F.explode("cold").alias("x")).select("row", "x.pair", "x.n").join(counts, "pair")
        cold = cold.join(F.broadcast(spark.createDataFrame(best.rename(columns={"k": "highest"}), "a int, highest long")), (F.col("pair") / F.lit(SPAN)).cast("int") == F.col("a"))
        cold = cold.groupBy("row").agg(F.sum(F.when(F.col("k") == F.col("highest"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("k")).alias("_sum"))
        found = found.join(cold, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return found.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
