"""Centroid clustering of whole-number vectors: rounds of Lloyd's method by kd-tree filtering.

The vectors are cut, where they lie, into trees of at most TREE vectors; no
vector is ever moved. A tree is one row: its vectors in the order of its leaves,
and for every node the count, the whole-number sums and the box of its vectors.
In a round each tree starts with all centroids at its root. At a node the
candidate nearest to the middle of the box is taken, and every candidate that is
strictly farther than it from all points of the box is dropped. A node with one
candidate left is assigned whole, by its count and sums; a leaf compares its
vectors with the candidates left. All of it is exact in whole numbers, so ties
go to the smaller number, whatever the partitions.

A round returns one row a centroid and dimension from each task, added up by
Spark; what the driver holds is the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planespark.llm.common import Workspace

DIM = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
#: Whole numbers are held within this on both sides, so that the squared distance of any two vectors of up to 64 components fits 64 bits.
LIMIT = 1 << 27
#: Vectors of a tree, and of a leaf, at most.
TREE = 4096
LEAF = 32
#: Products of values within this are exact in floating point (64 * 2**44 < 2**53).
FLOAT_EXACT = 1 << 22


def quantised(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """id and x (array<int>): floor(scale * component), in double, held within LIMIT.

    Vectors that are null, have not exactly ``dim`` components, or have one that
    is null, NaN or infinite are left out. Rows that share an id, or have none,
    stay rows of their own.
    """
    top = F.lit(float(LIMIT))
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = embeddings.where(F.col(column).isNotNull() & (F.size(column) == dim)).where(~bad)
    return good.select(F.col(key).cast("long").alias("id"), F.transform(column, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, top), -top)).cast("int")).alias("x"))


# Trees.


class Tree:
    """Vectors in the order of the leaves, and the nodes, children after their parents."""

    def __init__(self, x: np.ndarray, first, last, left, lo, hi, sums):
        self.x, self.first, self.last, self.left, self.lo, self.hi, self.sums = x, first, last, left, lo, hi, sums

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree of the rows of ``x``, and the order of its rows. A node is halved along its widest side; equal vectors stay one leaf."""
        order = np.arange(len(x))
        spans, left, boxes = [(0, len(x))], [], []
        k = 0
        while k < len(spans):
            a, b = spans[k]
            part = x[order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            boxes.append((lo, hi, part.sum(axis=0, dtype=np.int64)))
            side = int((hi - lo).argmax())
            if b - a > leaf and hi[side] > lo[side]:
                m = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, side], m)]
                left.append(len(spans))
                spans += [(a, a + m), (a + m, b)]
            else:
                left.append(0)
            k += 1
        first, last = np.array(spans).T
        lo, hi, sums = (np.stack(v).astype(np.int64) for v in zip(*boxes, strict=True))
        return cls(x[order], first, last, np.array(left), lo, hi, sums), order

    def assign(self, c: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, int]:
        """(node, centroid) of the nodes assigned whole; rows and centroids of the vectors compared one by one; (vector, centroid) comparisons spared."""
        squares = (c * c).sum(axis=1)
        nodes, cand = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        whole: list[tuple[int, int]] = []
        rows, chosen, dropped = [], [], 0
        while len(nodes):
            lo, hi = self.lo[nodes], self.hi[nodes]
            toward = squares[None] - (lo + hi) @ c.T  # squared distance to the middle, less a term that all share
            star = np.where(cand, toward, np.iinfo(np.int64).max).argmin(axis=1)
            way = c[None] - c[star][:, None]
            far = (np.where(way > 0, hi[:, None], lo[:, None]) * way).sum(axis=2)
            keep = cand & (squares[None] - squares[star][:, None] <= 2 * far)  # else farther than the star from every point of the box
            dropped += int(((cand.sum(axis=1) - keep.sum(axis=1)) * (self.last - self.first)[nodes]).sum())
            single = keep.sum(axis=1) == 1
            whole += zip(nodes[single].tolist(), keep[single].argmax(axis=1).tolist(), strict=True)
            leaf = ~single & (self.left[nodes] == 0)
            if leaf.any():
                sizes = (self.last - self.first)[nodes[leaf]]
                at = np.concatenate([np.arange(a, b) for a, b in zip(self.first[nodes[leaf]], self.last[nodes[leaf]], strict=True)])
                rows.append(at)
                chosen.append(nearest(self.x[at], c, squares, np.repeat(keep[leaf], sizes, axis=0)))
            inner = ~single & ~leaf
            nodes, cand = np.concatenate([self.left[nodes[inner]], self.left[nodes[inner]] + 1]), np.concatenate([keep[inner], keep[inner]])
        none = np.zeros(0, np.int64)
        return whole, np.concatenate([none, *rows]), np.concatenate([none, *chosen]), dropped

    def labels(self, c: np.ndarray) -> np.ndarray:
        whole, rows, chosen, _ = self.assign(c)
        out = np.zeros(len(self.x), np.int64)
        out[rows] = chosen
        for node, k in whole:
            out[self.first[node] : self.last[node]] = k
        return out


def nearest(x: np.ndarray, c: np.ndarray, squares: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """The nearest candidate of each row, the smaller number in a tie."""
    if max(abs(x).max(initial=0), abs(c).max(initial=0)) <= FLOAT_EXACT:
        away = squares[None] - 2 * (x.astype(float) @ c.T.astype(float))
        return np.where(cand, away, np.inf).argmin(axis=1)
    return np.where(cand, squares[None] - 2 * (x.astype(np.int64) @ c.T), np.iinfo(np.int64).max).argmin(axis=1)


_KIND = "n int, ids array<long>, wide boolean, x binary, first binary, last binary, left binary, lo binary, hi binary, sums binary"


def _planted(tree: int, leaf: int, dim: int):
    def row(x: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        t, order = Tree.build(x, leaf)
        wide = bool(abs(x).max(initial=0) >= 1 << 15)
        small = np.int32 if wide else np.int16
        data = [t.x.astype(small), t.first.astype(np.int32), t.last.astype(np.int32), t.left.astype(np.int32), t.lo.astype(small), t.hi.astype(small), t.sums]
        columns = [pa.array([len(x)], pa.int32()), pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), pa.array([wide]), *(pa.array([v.tobytes()], pa.binary()) for v in data)]
        return pa.RecordBatch.from_arrays(columns, names=["n", "ids", "wide", "x", "first", "last", "left", "lo", "hi", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, tree - held)
                ids.append(part.column(0))
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                held += part.num_rows
                at += part.num_rows
                if held == tree:
                    yield row(np.concatenate(rows).astype(np.int64), pa.concat_arrays(ids))
                    ids, rows, held = [], [], 0
        if held:
            yield row(np.concatenate(rows).astype(np.int64), pa.concat_arrays(ids))

    return run


def plant(vectors: DataFrame, dim: int = DIM, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """Trees of (id, x), made from the vectors of each partition as they come."""
    return vectors.select("id", "x").mapInArrow(_planted(tree, leaf, dim), _KIND)


def _grown(batch: pa.RecordBatch, k: int, dim: int) -> Tree:
    value = lambda name: batch.column(batch.schema.names.index(name))[k].as_py()
    small = np.int32 if value("wide") else np.int16
    table = lambda name, kind: np.frombuffer(value(name), kind).astype(np.int64).reshape(-1, dim)
    flat = lambda name: np.frombuffer(value(name), np.int32).astype(np.int64)
    return Tree(table("x", small), flat("first"), flat("last"), flat("left"), table("lo", small), table("hi", small), table("sums", np.int64))


def _partial(c: np.ndarray):
    """Count and sums of each cluster over the trees of a task, and how much of the work the boxes saved."""
    dim = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                t = _grown(batch, k, dim)
                whole, rows, chosen, _ = t.assign(c)
                for node, z in whole:
                    count[z] += t.last[node] - t.first[node]
                    sums[z] += t.sums[node]
                count += np.bincount(chosen, minlength=len(c))
                for z in np.unique(chosen):
                    sums[z] += t.x[rows[chosen == z]].sum(axis=0)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(count[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _labelled(c: np.ndarray):
    dim = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = _grown(batch, k, dim)
                labels = t.labels(c)
                away = t.x - c[labels]
                yield pa.RecordBatch.from_arrays([batch.column(1)[k].values, pa.array(labels.astype(np.int32)), pa.array((away * away).sum(axis=1))], names=["id", "cluster", "distance"])

    return run


def step(trees: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each, unchanged where it has no vector."""
    partial = trees.mapInArrow(_partial(c), "cluster int, n long, sums array<long>")
    parts = partial.select("cluster", "n", F.posexplode("sums").alias("dim", "s"))
    out = c.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # centroids x dimensions at most
        out[r["cluster"], r["dim"]] = r["s"] // r["n"]
    return out


def start(vectors: DataFrame, n: int = CENTROIDS, salt: str = "2:") -> list[list[int]]:
    """The vectors whose ids have the smallest SHA-256 after ``salt``, in ascending order; of a repeated id, the smaller vector first."""
    hashed = vectors.where("id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("hash"), "x")
    return [r.x for r in hashed.orderBy("hash", "x").limit(n).collect()]


def cluster(spark: SparkSession, embeddings: DataFrame, key: str = "vec_id", column: str = "embedding", n: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """One row per vector that ``quantised`` keeps: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Distances are squared and Euclidean. Fewer than ``n`` vectors give as many
    centroids as there are ids; no vector gives an empty table; a null id is
    labelled but starts no centroid, and where no vector has an id there is
    nothing to label with and the table is empty. Equal vectors have equal
    rows. Inertias beyond 64 bits are null. Other columns do not pass.
    """
    work = Workspace(spark, "centroids")
    vectors = quantised(embeddings, key, column, dim)
    kind = f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    first = start(vectors, n)
    if not first:
        return spark.createDataFrame([], kind)
    trees = work.save(plant(vectors, dim, tree, leaf), "trees")
    c = np.array(first, np.int64)
    for _ in range(rounds):
        c = step(trees, c)
    rows = work.save(trees.mapInArrow(_labelled(c), "id long, cluster int, distance long"), "labels")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row a centroid
    total = sum(int(r.s) for r in sums)
    fits = lambda v: v if v < 1 << 63 else None
    named = [(r["cluster"], fits(int(r.s)), fits(total), hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()) for r in sums]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(table), "cluster")
    return out.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def saved_work(trees: DataFrame, c: np.ndarray) -> tuple[float, float]:
    """Shares of the (vector, centroid) comparisons that the boxes spared, and of the vectors that went with a whole node."""
    dim = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = _grown(batch, k, dim)
                whole, rows, _, dropped = t.assign(c)
                yield pa.RecordBatch.from_arrays([pa.array([len(t.x)]), pa.array([len(rows)]), pa.array([dropped])], names=["n", "compared", "dropped"])

    n, compared, dropped = trees.mapInArrow(run, "n long, compared long, dropped long").agg(F.sum("n"), F.sum("compared"), F.sum("dropped")).head()
    return (dropped / max(n * len(c), 1), 1 - compared / max(n, 1))
