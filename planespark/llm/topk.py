"""Exact top-k inner products with a pivot-distance index.

Every vector is keyed by a band of its norm, its nearest pivot and its distance
to it; sorted by that key, the vectors are cut into blocks, each an annulus
around a pivot. The queries are cut into groups in the same way, but that a group
of few goes on to the next pivot. For a vector x
of an annulus with distances lo to hi and norms up to m, and a query q, the
triangle inequality gives

    <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + m^2 - gap^2) / 2,
    <q, x> = <q, p> + <q, x - p>             <= <q, p> + |q| hi,

where gap is what q's own distance to the pivot p leaves: |q - x| >= gap. A
group first searches the annuli of its own pivots that are next to it, which
gives each query a k-th score to beat. Then whole pivots, and after them single
annuli, whose bounds are below what their group has to beat are ruled out; what
is left is searched, and queries skip it one by one by their own bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planespark.llm.common import Workspace

SCALE = 1024
#: Pivots are the square root of the number of vectors, within these bounds, taken by a hash of the ids.
PIVOTS = (16, 4096)
#: Vectors of a block, queries of a group, at most; queries after which a group ends with its pivot; and those that a task works on at a time.
BLOCK = 4096
QUERY_BLOCK = 4096
GROUP = 512
STEP = 512
#: Annuli of each pivot of its queries that a group searches first.
SEEDS = 2
#: Norms of one band differ by at most this factor.
BAND = 1.25
#: Bounds have this much room for rounding, relative to the squares in them.
ROOM = 1e-9
#: Products below this are exact in floating point, and below the next in 64 bits.
FLOAT_EXACT, LONG_EXACT = 2.0**53, 2.0**62


def quantised(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and x (array<long>): floor(1024 * component), in double, cut off at the ends of 64 bits.

    Rows with a null id, a null vector, or a null, NaN or infinite component
    are left out. An empty vector takes part with products of 0, and a shorter
    one as if zeros followed. Rows that share an id stay rows of their own.
    """
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = embeddings.where(F.col(key).isNotNull() & F.col(column).isNotNull()).where(~bad)
    return good.select(F.col(key).cast("long").alias("vec_id"), F.transform(column, lambda v: F.floor(v.cast("double") * SCALE)).alias("x"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as whole numbers; what a short list lacks is 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None] < sizes[:, None]] = flat
    return out


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in 32 bits where they fit, else in 64."""
    small = not x.size or (x.min() >= -(2**31) and x.max() < 2**31)
    return x.astype(np.int32 if small else np.int64).tobytes()


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * dim else np.int64).reshape(n, dim)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(axis=1))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in floating point where all fit in 53 bits, else in 64-bit integers, else in unbounded ones that are cut off at the ends of 64 bits."""
    size = float(_norms(q).max(initial=0)) * float(_norms(x).max(initial=0))
    if size < FLOAT_EXACT:
        return q.astype(float) @ x.astype(float).T
    if size < LONG_EXACT:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return np.clip(q.astype(object) @ x.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k highest scores but that of ``own``, ties to smaller ids."""
    on = np.flatnonzero(ids != own)
    if len(on) > k:
        part = scores[on]
        on = on[part >= np.partition(part, len(on) - k)[len(on) - k]]
    on = on[np.lexsort((ids[on], -scores[on].astype(float)))] if scores.dtype == float else on[sorted(range(len(on)), key=lambda j: (-int(scores[on[j]]), int(ids[on[j]])))]
    return [(int(ids[j]), int(scores[j])) for j in on[:k]]


def search(spark: SparkSession, vectors: DataFrame, queries: str, k: int = 10, work: Workspace | None = None, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all rows but its own, ties to smaller ids, then smaller vectors.

    ``vectors`` has vec_id and x, as ``quantised`` gives them; ``queries`` is a
    condition on them. Inside, rows go by numbers in the order of id and vector.
    Scores that 64 bits do not hold are cut off at their end, and tie there. With
    a ``work`` folder given, its tables ``index``, ``groups``, ``first`` and
    ``later`` stay there and tell what was searched.
    """
    work = work or Workspace(spark, "topk")
    numbered = vectors.repartitionByRange("vec_id", "x").sortWithinPartitions("vec_id", "x")
    rows = work.save(numbered.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "vectors")
    queries = rows.where(queries).select(F.col("row").alias("vec_id"), "x")
    names = rows.select("row", F.col("vec_id").alias("name"))
    vectors = rows.select(F.col("row").alias("vec_id"), "x")
    count, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).head()
    dim = max(dim, 1)
    n_pivots = int(min(max(count**0.5, PIVOTS[0]), PIVOTS[1]))
    taken = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("x").toPandas()["x"]  # at most PIVOTS[1] vectors
    pivots = np.zeros((max(len(taken), 1), dim))
    for row, x in enumerate(taken):
        pivots[row, : len(x)] = x
    pivot_squares = (pivots**2).sum(axis=1)
    pivots_on = spark.sparkContext.broadcast((pivots, pivot_squares))

    def distances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivots and inner products with them."""
        p, squares = pivots_on.value
        inner = x.astype(float) @ p.T
        return np.sqrt(np.maximum((x.astype(float) ** 2).sum(axis=1)[:, None] + squares[None] - 2 * inner, 0)), inner

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                x = _matrix(part.column(1), dim)
                d, _ = distances(x)
                near = d.argmin(axis=1)
                band = np.ceil(np.log(np.maximum(_norms(x), 1.0)) / np.log(BAND)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(band), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])], names=["vec_id", "x", "band", "pivot", "distance"])

    def blocks(size: int, least: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                while held.num_rows:
                    pivot, band = held["pivot"].to_numpy(), held["band"].to_numpy()
                    other = np.flatnonzero((pivot[1:] != pivot[:-1]) | (band[1:] != band[:-1])) + 1
                    other = other[other >= least]
                    n = min(int(other[0]) if len(other) else len(pivot), size)
                    if n == held.num_rows and n < size:
                        break
                    yield _block(held.slice(0, n), dim)
                    held = held.slice(n)
            if held is not None and held.num_rows:
                yield _block(held, dim)

        return run

    kind = "vec_id long, x array<long>, band int, pivot int, distance double"
    order = ("band", "pivot", "distance", "vec_id")

    def cut(rows: DataFrame, size: int, least: int, name: str) -> DataFrame:
        out = rows.mapInArrow(keyed, kind).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks(size, least), "pivot int, pivots array<int>, lo double, hi double, longest double, n int, ids array<long>, x binary")
        return work.save(out.withColumn("block", F.monotonically_increasing_id()), name)

    index = cut(vectors, BLOCK, 1, "index")
    groups = cut(queries.select("vec_id", "x"), QUERY_BLOCK, group, "groups").withColumnRenamed("block", "group")
    annuli = index.select("block", "pivot", "lo", "hi", "longest")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least and largest distance of a group's queries to each pivot, and their largest product with it."""
        for batch in batches:
            for row in range(batch.num_rows):
                q = _unpacked(batch.column(2)[row].as_py(), batch.column(1)[row].as_py(), dim)
                least, most, inner = [], [], []
                for a in range(0, len(q), STEP):
                    d, i = distances(q[a : a + STEP])
                    least.append(d.min(axis=0))
                    most.append(d.max(axis=0))
                    inner.append(i.max(axis=0))
                p = len(least[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0)[row].as_py(), p)), pa.array(np.arange(p, dtype=np.int32)), pa.array(np.min(least, axis=0)), pa.array(np.max(most, axis=0)), pa.array(np.max(inner, axis=0))], names=["group", "pivot", "near", "far", "inner"])

    ways = work.save(groups.select("group", "n", "x").mapInArrow(reach, "group long, pivot int, near double, far double, inner double"), "ways")
    own = groups.select("group", F.col("longest").alias("q_longest"))

    def bound(lo: F.Column, hi: F.Column, longest: F.Column) -> F.Column:
        """No product of a group's query with a vector of an annulus is above this."""
        gap = F.greatest(F.lit(0.0), lo - F.col("far"), F.col("near") - hi)
        squares = F.col("q_longest") * F.col("q_longest") + longest * longest
        return F.least((squares - gap * gap) / 2, F.col("inner") + F.col("q_longest") * hi, F.col("q_longest") * longest) + squares * ROOM + ROOM

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, squares = pivots_on.value
        for batch in batches:
            for r in batch.to_pylist():
                x, ids = _unpacked(r["x"], r["n"], dim), np.array(r["ids"], np.int64)
                q, names, beat = _unpacked(r["q"], r["q_n"], dim), np.array(r["q_ids"], np.int64), dict(r["beat"] or ())
                out = []
                for a in range(0, len(q), STEP):
                    part = q[a : a + STEP].astype(float)
                    square, inner = (part**2).sum(axis=1), part @ p[r["pivot"]]
                    away = np.sqrt(np.maximum(square + squares[r["pivot"]] - 2 * inner, 0))
                    gap = np.maximum(0, np.maximum(r["lo"] - away, away - r["hi"]))
                    both = square + r["longest"] ** 2
                    most = np.minimum(np.minimum((both - gap**2) / 2, inner + np.sqrt(square) * r["hi"]), np.sqrt(square) * r["longest"]) + both * ROOM + ROOM
                    on = np.flatnonzero(most >= np.array([beat.get(int(v), -np.inf) for v in names[a : a + STEP]], float))
                    scores = products(q[a : a + STEP][on], x)
                    for j, s in zip(on, scores, strict=True):
                        out += [(int(names[a + j]), v, score) for v, score in best_of(s, ids, names[a + j], k)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    def scored(pairs: DataFrame, beat: DataFrame | None) -> DataFrame:
        """The best of each (group, block); a pair is a row of its own, so no task gets all that a group or a block has to do."""
        asked = groups.select("group", F.col("ids").alias("q_ids"), F.col("x").alias("q"), F.col("n").alias("q_n"))
        asked = asked.join(beat, "group", "left") if beat is not None else asked.withColumn("beat", F.lit(None).cast("map<bigint,bigint>"))
        rows = pairs.join(asked, "group").join(index.select("block", "pivot", "lo", "hi", "longest", "n", "ids", "x"), "block")
        return rows.select("pivot", "lo", "hi", "longest", "n", "ids", "x", "q_ids", "q", "q_n", "beat").mapInArrow(best, "query_id long, vec_id long, score long")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("far"), F.col("near") - F.col("hi"))
    home = groups.select("group", F.explode("pivots").alias("pivot")).join(ways, ["group", "pivot"]).join(annuli, "pivot")
    first = home.withColumn("rank", F.row_number().over(Window.partitionBy("group", "pivot").orderBy(gap, F.desc("longest"), "block"))).where(F.col("rank") <= SEEDS)
    first = work.save(first.select("group", "block"), "first")
    seeds = work.save(scored(first, None).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank"), "seeds")

    # What each query, and each group as a whole, has to beat; null where a query has no k-th score yet.
    kth = seeds.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).select("query_id", "score")
    members = groups.select("group", F.explode("ids").alias("query_id")).join(kth, "query_id", "left")
    beat = work.save(members.groupBy("group").agg(F.map_from_entries(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("query_id", "score")))).alias("beat"), F.when(F.count("score") == F.count("*"), F.min("score")).alias("least")), "beat")  # a group has at most QUERY_BLOCK queries
    spans = annuli.groupBy("pivot").agg(F.min("lo").alias("p_lo"), F.max("hi").alias("p_hi"), F.max("longest").alias("p_longest"))
    asked = ways.join(own, "group").join(beat.select("group", "least"), "group").join(spans, "pivot")
    open_pivots = asked.where(F.col("least").isNull() | (bound(F.col("p_lo"), F.col("p_hi"), F.col("p_longest")) >= F.col("least")))
    later = open_pivots.join(annuli, "pivot").where(F.col("least").isNull() | (bound(F.col("lo"), F.col("hi"), F.col("longest")) >= F.col("least")))
    later = work.save(later.select("group", "block").join(first, ["group", "block"], "left_anti"), "later")
    found = seeds.union(scored(later, beat.select("group", "beat"))).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    found = found.join(names.withColumnRenamed("name", "_query"), F.col("query_id") == F.col("row")).drop("row")
    found = found.join(names.withColumnRenamed("name", "_found"), F.col("vec_id") == F.col("row"))
    return found.select(F.col("_query").alias("query_id"), "rank", F.col("_found").alias("vec_id"), "score")


def ruled_out(work: Workspace) -> float:
    """Share of the (query group, annulus) pairs that a search in this folder did not compare."""
    table = lambda name: work.spark.read.parquet(f"{work.path}/{name}")
    whole = table("index").count() * table("groups").count()
    return 1 - (table("first").count() + table("later").count()) / whole if whole else 0.0


def _block(rows: pa.Table, dim: int) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    x = _matrix(rows["x"].chunk(0), dim)
    d = rows["distance"].to_numpy()
    values = [rows["pivot"][0].as_py(), np.unique(rows["pivot"].to_numpy()).tolist(), float(d.min()), float(d.max()), float(_norms(x).max()), len(d), rows["vec_id"].to_pylist(), _packed(x)]
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["pivot", "pivots", "lo", "hi", "longest", "n", "ids", "x"])
