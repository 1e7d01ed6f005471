"""MinHash near-duplicates by a chosen-path set similarity join.

Texts with equal shingle sets are one class, so copies cost nothing further.
Every class goes down several independent trees: a node picks some of the
minwise tokens, and each pick sends a class to the child named by its own
value there. Nodes of few members are compared exhaustively by sketch; larger
ones branch again. Links are then confirmed on the full shingle sets:

1. each member with the first member of its node whose sketch is close (stars
   find nearly all groups with about one comparison a document);
2. after the components of these links, all pairs of members that share a node
   and are still in different components.

So two members of a leaf, or of a large node of the last level, are either in
one component already or compared by sketch and then exactly. Members of a large
node above the last level are compared with its first member and branch again: a
pair that no child keeps together is not compared. Groups of any size are never
expanded into all their pairs; a large node of the last level whose members are
in many components costs (its size) x (members outside the largest) / LEAF rows.
``meets`` gives the probability that a pair meets, branching levels included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planespark.llm.common import Workspace, list_array, slices, text_bytes
from planespark.llm.components import components

#: Minwise tokens of a sketch; one byte of each is kept.
TOKENS = 128
#: Independent trees, and minwise tokens that each root picks.
TREES = 4
ROOT_PICKS = 3
#: Members up to which a node is compared exhaustively, and the deepest level.
LEAF = 200
DEPTH = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sketches agree in at least this share of tokens to be compared on full sets (4.9 standard deviations below 0.8).
CLOSE = 0.625
#: Text that one step of the vectorised shingling works on.
STEP_BYTES = 2 << 20



def meets(similarity: float, levels: int, roots: int = TREES * ROOT_PICKS) -> float:
    """Probability that a pair is together in a node below ``levels`` large ones, in one of the trees at least (a branching process)."""
    on = 1.0
    for _ in range(levels):
        miss = 1 - similarity * on
        on = 1 - miss * (0.75 + 0.25 * miss)  # one pick, and a second one at every fourth node
    return 1 - (1 - similarity * on) ** roots


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(1, 2**62, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_sets(column, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text: ``words`` consecutive words, or all words where there are fewer."""
    raw, offsets = text_bytes(column)
    n = len(raw)
    if not n:
        return [np.zeros(0, np.uint64)] * len(column)
    raw = _LOWER[raw]
    space = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ~space
    start[1:] &= space[:-1] | edge[1:-1]
    stop = ~space
    stop[:-1] &= space[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up, out=sums[1:])
    word = _mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    at = np.searchsorted(first, offsets)
    count = len(word)
    full = np.zeros(max(count - words + 1, 0), np.uint64)
    for k in range(words):
        full += word[k : k + len(full)] * _PLACES[k]
    full = _mix(full)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            out.append(_mix((word[a:b] * _PLACES[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS minwise values of each non-empty set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), TOKENS), np.uint64)
    if len(sets):
        values = np.concatenate(sets)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for k in range(TOKENS):
            out[:, k] = np.minimum.reduceat(values * _FACTORS[k], begins)
    return out


def features(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """id, n (set size), digest of the set, sketch (TOKENS bytes) and the child of each root pick."""
    kind = "id long, n long, digest binary, sketch binary, roots array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = np.arange(TREES * ROOT_PICKS)
        for batch in batches:
            for a, b in slices(batch.column(1), STEP_BYTES):
                sets = shingle_sets(batch.column(1).slice(a, b - a), words)
                filled = [k for k, x in enumerate(sets) if len(x)]
                tokens = minwise([sets[k] for k in filled])
                roots = _mix(tokens[:, picks] ^ _mix(picks.astype(np.uint64) + np.uint64(1))).view(np.int64)
                counts = np.zeros(len(sets), np.int64)
                counts[filled] = len(picks)
                low = tokens.astype(np.uint8)
                sketch: list[bytes | None] = [None] * len(sets)
                for row, k in enumerate(filled):
                    sketch[k] = low[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                        pa.array(sketch, pa.binary()),
                        list_array(roots.ravel(), np.concatenate([[0], np.cumsum(counts)])),
                    ],
                    names=["id", "n", "digest", "sketch", "roots"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, kind)


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of (node, id, sketch): one pick, and a second one at every fourth node (1 / 0.8 picks on average)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy().view(np.uint64)
        sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, TOKENS)
        rows, children = [], []
        for pick in range(2):
            drawn = _mix(node + _PLACES[pick])
            on = np.flatnonzero((pick == 0) | (drawn >> np.uint64(62) == 0))
            token = (drawn[on] % np.uint64(TOKENS)).astype(np.int64)
            rows.append(on)
            children.append(_mix(drawn[on] ^ (sketch[on, token].astype(np.uint64) + np.uint64(1)) * _PLACES[2]).view(np.int64))
        rows = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(children)), batch.column(1).take(pa.array(rows))], names=["node", "id"])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold every row of each key they hold, from batches sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column(batch.schema.names.index(key))[0].as_py() != keys[-1].item():
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Close pairs (a, b) of each leaf, enough to name every member that has a close one.

    In rounds, each member is compared with the first member left in its node,
    and those close to it leave with it. One that ends alone is compared with
    the members that left before.
    """
    for table in whole_groups(batches, "node"):
        node = table["node"].to_numpy()
        ids = table["id"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, TOKENS)
        left = np.arange(len(node))
        pairs, alone, joined = [], [], np.zeros(len(node), bool)
        while len(left):
            new = np.ones(len(left), bool)
            new[1:] = node[left[1:]] != node[left[:-1]]
            heads = left[np.flatnonzero(new)]
            head = heads[np.cumsum(new) - 1]
            close = (sketch[left] == sketch[head]).mean(axis=1) >= CLOSE
            hit = close & (left != head)
            pairs.append(np.stack([ids[head[hit]], ids[left[hit]]]))
            joined[left[hit]] = joined[head[hit]] = True
            alone.append(heads[~joined[heads]])
            left = left[~close & (left != head)]
        for k in np.concatenate(alone) if alone else []:
            a, b = np.searchsorted(node, [node[k]], "left")[0], np.searchsorted(node, [node[k]], "right")[0]
            others = np.flatnonzero(joined[a:b]) + a
            if len(others):
                hit = others[(sketch[others] == sketch[k]).mean(axis=1) >= CLOSE]
                if len(hit):
                    pairs.append(np.stack([ids[hit[:1]], ids[[k]]]))
        pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        pairs = pairs[:, pairs[0] != pairs[1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=0)), pa.array(pairs.max(axis=0))], names=["a", "b"])


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def _verify_pairs(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), STEP_BYTES):
                part = batch.slice(a, b - a)
                once: dict[str, np.ndarray] = {}
                texts = list(dict.fromkeys(part.column(3).to_pylist()))
                for text, found in zip(texts, shingle_sets(pa.array(texts, pa.string()), words), strict=True):
                    once[text] = found
                left = [once[x] for x in part.column(3).to_pylist()]
                right = shingle_sets(part.column(2), words)
                ok = pa.array([linked(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    return run


def _verify_groups(words: int):
    """Links between members of a group that are in different components so far (union-find within the group).

    ``side``: 0 members are compared with all others, 1 members only with 0 members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            nodes = table["node"].to_numpy()
            bounds = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
            found_a, found_b = [], []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                part = table.slice(lo, hi - lo)
                ids, side = part["id"].to_pylist(), part["side"].to_pylist()
                up = {x: x for x in part["component"].to_pylist()}

                def root(x: int, up: dict = up) -> int:
                    while up[x] != x:
                        up[x] = x = up[up[x]]
                    return x

                where = part["component"].to_pylist()
                sets = shingle_sets(part["text"], words)
                for i in range(len(ids)):
                    for j in range(i):
                        if side[i] and side[j] or root(where[i]) == root(where[j]) or not linked(sets[i], sets[j]):
                            continue
                        found_a.append(ids[i])
                        found_b.append(ids[j])
                        up[root(where[i])] = root(where[j])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Words are split at ASCII white space after lower-casing A-Z; a set holds the
    distinct shingles of ``words`` words, or the whole sequence as one shingle
    where there are fewer. Null or blank text has an empty set and is linked
    with nothing. component_id is the smallest key reachable through links; kept
    marks the row with that key. Rows that share a key but not a set are members
    of their own: each has the links of its own text. Equal rows give equal
    rows; a null key gives a null component_id and is kept. Other columns do not
    pass.
    """
    work = Workspace(spark, "near")
    feats = work.save(features(docs, key, text, words), "features")
    several = feats.where("n > 0 and id is not null").groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi")
    if several.isEmpty():
        return _linked(spark, docs, feats, work, key, text, words, leaf, depth)
    # Each row gets a number of its own and is a member by that; components then get their smallest key.
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = work.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so that the numbers stay
    found = _linked(spark, rows, work.save(features(rows, "row", "text", words), "row-features"), work, "row", "text", words, leaf, depth)
    named = work.save(found.join(rows.select("row", "key"), "row").select("key", "n_shingles", "component_id"), "named")
    least = named.groupBy("component_id").agg(F.min("key").alias("least"))
    out = named.join(least, "component_id").select(F.col("key").alias(key), "n_shingles", F.col("least").alias("component_id"), (F.col("key") == F.col("least")).alias("kept"))
    unnamed = feats.where("id is null").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(unnamed)


def _linked(spark: SparkSession, docs: DataFrame, feats: DataFrame, work: Workspace, key: str, text: str, words: int, leaf: int, depth: int) -> DataFrame:
    """The result for keys each of which stands for one set."""
    least = work.save(feats.where("n > 0").groupBy("digest").agg(F.min("id").alias("class")), "classes")
    classes = feats.where("n > 0").join(least.where("class is not null").select("digest", F.col("class").alias("id")), ["digest", "id"], "left_semi").groupBy("id").agg(F.first("sketch").alias("sketch"), F.first("roots").alias("roots"))
    classes = work.save(classes, "sketches")

    # Down the trees.
    level = classes.select(F.explode("roots").alias("node"), "id")
    leaves, large, stars = [], None, []
    for d in range(1, depth + 1):
        size = level.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("first")).where("size > 1")
        members = work.save(level.join(size, "node"), f"level{d}")
        leaves.append(members.where(F.col("size") <= leaf).select("node", "id"))
        large = members.where(F.col("size") > leaf)
        if large.isEmpty():
            large = None
            break
        stars.append(large.select(F.col("first").alias("a"), F.col("id").alias("b")).where("a <> b"))
        if d < depth:
            level = large.select("node", "id").join(classes.select("id", "sketch"), "id").select("node", "id", "sketch").mapInArrow(_branch, "node long, id long")
            level = work.save(level, f"branched{d}")  # read twice, for the sizes and for the members: written, so that each member branches once
    leaf_rows = leaves[0]
    for x in leaves[1:]:
        leaf_rows = leaf_rows.union(x)

    # Stars, confirmed on full sets.
    sketches = classes.select("id", "sketch")
    pairs = leaf_rows.join(sketches, "id").select("node", "id", "sketch").repartition("node").sortWithinPartitions("node", "id").mapInArrow(_stars, "a long, b long")
    if stars:
        wide = stars[0]
        for x in stars[1:]:
            wide = wide.union(x)
        wide = wide.distinct().join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
        pairs = pairs.union(wide.select("a", "b", "sa", "sb").mapInArrow(_close, "a long, b long"))
    pairs = work.save(pairs.distinct(), "pairs")
    wanted = pairs.select("a").union(pairs.select("b"))
    if large is not None:
        wanted = wanted.union(large.select("id"))
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    texts = work.save(source.join(wanted.distinct().toDF("id").hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    confirmed = pairs.join(texts.select(F.col("id").alias("b"), "text"), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    links = work.save(confirmed.select("a", "b", "text", "text_a").mapInArrow(_verify_pairs(words), "a long, b long"), "links")
    found = work.save(components(links, work), "components")

    # What shares a node and is still apart, compared exactly.
    apart = _apart(leaf_rows, large, texts, sketches, found, leaf)
    more = work.save(apart.mapInArrow(_verify_groups(words), "a long, b long").distinct(), "more")
    if not more.isEmpty():
        found = work.save(components(links.union(more), work, "again"), "all")

    rep = least.join(found.withColumnRenamed("id", "class"), "class", "left").select("digest", F.coalesce("component", "class").alias("component_id"))
    out = feats.select("id", "n", "digest").join(rep, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, TOKENS) for k in (2, 3))
        ok = pa.array((x == y).mean(axis=1) >= CLOSE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def _apart(leaf_rows: DataFrame, large: DataFrame | None, texts: DataFrame, sketches: DataFrame, found: DataFrame, leaf: int) -> DataFrame:
    """Members, with texts, of the nodes whose members are in several components, sorted by node.

    In a node above the leaf size, members outside the largest component meet
    all others in blocks: both sides are dealt into blocks of the leaf size.
    """
    labelled = texts.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    def mixed(rows: DataFrame) -> DataFrame:
        rows = rows.join(labelled, "id")
        several = rows.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("node")
        return rows.join(several, "node", "left_semi")

    out = mixed(leaf_rows).select("node", "id", "component", F.lit(0).alias("side"))
    if large is not None:
        rows = mixed(large.select("node", "id"))
        sizes = rows.groupBy("node", "component").agg(F.count("*").alias("k"))
        most = sizes.groupBy("node").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("total"), (F.sum("k") - F.max("k")).alias("rest"))
        rows = rows.join(most, "node")
        across = F.ceil(F.col("total") / leaf).cast("int")
        down = F.ceil(F.col("rest") / leaf).cast("int")
        own = F.col("component") != F.col("main")
        block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
        minor = rows.where(own).withColumn("i", block(down, 1)).withColumn("j", F.explode(F.sequence(F.lit(0), across - 1))).withColumn("side", F.lit(0))
        every = rows.withColumn("j", block(across, 2)).withColumn("i", F.explode(F.sequence(F.lit(0), down - 1))).withColumn("side", F.lit(1))
        blocks = minor.unionByName(every).select(F.xxhash64("node", "i", "j").alias("node"), "id", "component", "side")
        out = out.union(blocks)
    near = out.join(sketches, "id").select("node", "id", "component", "side", "sketch").repartition("node").sortWithinPartitions("node", "id").mapInArrow(_still_close, "node long, id long, component long, side int")
    return near.join(texts.hint("merge"), "id").repartition("node").sortWithinPartitions("node", "id").select("node", "id", "component", "side", "text")


def _still_close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members whose sketch is close to that of a member of another component in their node."""
    for table in whole_groups(batches, "node"):
        node = table["node"].to_numpy()
        component = table["component"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, TOKENS)
        keep = np.zeros(len(node), bool)
        bounds = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            for k in range(lo, hi):
                close = (sketch[lo:hi] == sketch[k]).mean(axis=1) >= CLOSE
                keep[k] = (close & (component[lo:hi] != component[k])).any()
        yield table.select(["node", "id", "component", "side"]).filter(pa.array(keep)).combine_chunks().to_batches(max_chunksize=1 << 20)[0] if keep.any() else pa.RecordBatch.from_pylist([], schema=table.select(["node", "id", "component", "side"]).schema)
