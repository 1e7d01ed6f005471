"""Exact Jaccard join of word n-gram sets by signature trees.

A set has a signature, a bitmap with one bit for each hashed token, twice to
four times as wide as the set is large. A tree over sets has in each node the
OR of the bitmaps below it, the range of the set sizes, and how many tokens at
most share a bit with another one. Two nodes are walked down together only if
some pair below them could still reach the similarity: by their sizes, and by the
most tokens they can share, which is the number of common bits and the tokens
that bits may hide. What is left at the bottom is confirmed on the full sets.

One tree over everything has full bitmaps at its top and prunes nothing there,
so Spark deals the sets to many small trees first, without losing a link: two
sets at similarity s share one of the first n - ceil(s n) + 1 tokens of any
common order (tokens that start very many sets come last, then by hash).
Each such token has a tree; its place in the order also bounds the overlap, since
at the first token a pair shares nothing before it is common.

Sets that share minwise tokens are linked and confirmed first. The trees then
skip all pairs inside one component, as whole nodes where they can. What the trees
of small nodes leave is confirmed as pairs. A node of more than SMALL sets has the
sets themselves at its leaves and gives the links that join its members, never
more than it has members; one of more than BLOCK sets is cut into cells in which
those outside its largest component meet all others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planespark.llm.common import Workspace, list_array, slices
from planespark.llm.components import components
from planespark.llm.near_duplicates import STEP_BYTES, linked, shingle_sets, whole_groups

#: Sets of a cell, on each of its two sides, at most (on average where cells are dealt by hash).
BLOCK = 1024
#: Nodes of more sets than this are walked with the sets themselves, and signatures this many times as wide.
SMALL = 32
FINE = 16
#: Minwise tokens by which sets are linked before the trees.
ROOTS = 3
#: A token that starts more sets than this comes late in the order; so many such tokens at most, the most frequent ones (any order is exact, the list only saves work).
HEAVY_AT = 16
HEAVY = 1 << 16
#: Bitmap bytes that one step of a traversal looks at.
STEP = 32 << 20
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**62, ROOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_size(n: int, percent: int) -> int:
    """Tokens of which two linked sets share one, whatever the common order."""
    return n - -(-n * percent // 100) + 1


def signature_bits(n: int) -> int:
    return 1 << max(6, int(2 * n - 1).bit_length())


def signature(tokens: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def folded(data: bytes) -> bytes:
    """The signature half as wide: a set bit stays one."""
    half = len(data) // 2
    return (np.frombuffer(data[:half], np.uint8) | np.frombuffer(data[half:], np.uint8)).tobytes()


def _first(tokens: np.ndarray, size: int, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first ``size`` tokens of a sorted set in the common order: those that are not heavy by hash, then the heavy ones by rank."""
    if not len(heavy):
        return tokens[:size]
    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
    is_heavy = heavy[at] == tokens
    light = tokens[~is_heavy][:size]
    if len(light) == size:
        return light
    late = at[is_heavy]
    return np.concatenate([light, heavy[late[np.argsort(rank[late], kind="stable")]][: size - len(light)]])


def _prefixes(words: int, percent: int):
    """The prefix tokens, by hash alone."""
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), STEP_BYTES):
                sets = shingle_sets(batch.column(0).slice(a, b - a), words)
                got = [_first(x, prefix_size(len(x), percent), none, none) for x in sets if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64) if got else none)], names=["token"])

    return run


def _features(words: int, percent: int, heavy: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), STEP_BYTES):
                sets = shingle_sets(batch.column(1).slice(a, b - a), words)
                first = [_first(x, prefix_size(len(x), percent), heavy, rank) if len(x) else x for x in sets]
                roots = [[int((x * f).min().view(np.int64)) for f in _FACTORS] if len(x) else [] for x in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in first])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                        pa.array([signature(x, signature_bits(len(x))) if len(x) else b"" for x in sets], pa.binary()),
                        pa.array(roots, pa.list_(pa.int64())),
                        list_array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64), ends),
                    ],
                    names=["id", "n", "digest", "bits", "roots", "prefix"],
                )

    return run


# Trees. All trees of one depth and one width of signature are walked at once: node k of a level has the children 2 k and 2 k + 1.


class Forest:
    """Full binary trees side by side; a padded place has sizes that fit no other."""

    def __init__(self, place: np.ndarray, count: int, bits: np.ndarray, n: np.ndarray, rest: np.ndarray, component: np.ndarray, side: np.ndarray):
        words = np.zeros((count, bits.shape[1]), np.uint64)
        words[place] = bits
        fill = lambda values, empty: _put(np.full(count, empty, np.int64), place, values)
        hidden = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(words, fill(n, 1 << 50), fill(n, -1), fill(rest, -1), fill(hidden, 0), fill(component, np.iinfo(np.int64).max), fill(component, np.iinfo(np.int64).min), fill(side, 1))]

    def grow(self, depth: int) -> Forest:
        for _ in range(depth):
            w, lo, hi, rest, hidden, c_lo, c_hi, side = ((x[0::2], x[1::2]) for x in self.levels[-1])
            self.levels.append((w[0] | w[1], np.minimum(*lo), np.maximum(*hi), np.maximum(*rest), np.maximum(*hidden), np.minimum(*c_lo), np.maximum(*c_hi), np.minimum(*side)))
        return self

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs, each once, that may be linked and are in different components."""
        roots = np.arange(len(self.levels[-1][1]))
        todo, found = [(len(self.levels) - 1, roots, roots)], []
        most = max(1, STEP // (8 * self.levels[0][0].shape[1]))
        while todo:
            level, p, q = todo.pop()
            if len(p) > most:
                todo += [(level, p[k : k + most], q[k : k + most]) for k in range(0, len(p), most)]
                continue
            keep = self._may_link(level, p, q, percent)
            p, q = p[keep], q[keep]
            if not level:
                found.append((p, q))
            elif len(p):
                a, b = np.concatenate([2 * p, 2 * p, 2 * p + 1, 2 * p + 1]), np.concatenate([2 * q, 2 * q + 1, 2 * q, 2 * q + 1])
                once = a <= b if level > 1 else a < b
                todo.append((level - 1, a[once], b[once]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in range(2))

    def _may_link(self, level: int, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
        words, lo, hi, rest, hidden, c_lo, c_hi, side = self.levels[level]
        keep = (100 * hi[p] >= percent * lo[q]) & (100 * hi[q] >= percent * lo[p])
        keep &= ~((c_lo[p] == c_hi[p]) & (c_lo[q] == c_hi[q]) & (c_lo[p] == c_lo[q]))
        keep &= (side[p] == 0) | (side[q] == 0)
        at = np.flatnonzero(keep)
        needed = percent * (lo[p[at]] + lo[q[at]])
        most = np.minimum(np.minimum(rest[p[at]], rest[q[at]]), np.minimum(hi[p[at]], hi[q[at]]))
        on = (100 + percent) * most >= needed
        at, needed = at[on], needed[on]
        common = np.bitwise_count(words[p[at]] & words[q[at]]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[p[at]], hidden[q[at]])
        out = np.zeros(len(p), bool)
        out[at[(100 + percent) * common >= needed]] = True
        return out


def _put(out: np.ndarray, place: np.ndarray, values: np.ndarray) -> np.ndarray:
    out[place] = values
    return out


def candidates(node, side, component, n, rest, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of pairs of one node that may be linked and are in different components; rows come sorted by node."""
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    found = [(np.zeros(0, np.int64),) * 2]
    for w in np.unique(width):
        on = np.flatnonzero(width == w)
        on = on[np.lexsort((n[on], component[on], node[on]))]
        words = np.frombuffer(b"".join([bits[k] for k in on]), np.uint64).reshape(len(on), -1)
        begin = np.flatnonzero(np.concatenate([[True], node[on][1:] != node[on][:-1]]))
        size = np.diff(np.append(begin, len(on)))
        depth = np.ceil(np.log2(size)).astype(np.int64)
        for d in np.unique(depth[size > 1]):
            mine = np.flatnonzero((depth == d) & (size > 1))
            rows = np.concatenate([np.arange(begin[g], begin[g] + size[g]) for g in mine])
            place = np.concatenate([np.arange(size[g]) + (k << d) for k, g in enumerate(mine)])
            own = on[rows]
            back = np.zeros(len(mine) << d, np.int64)
            back[place] = own
            p, q = Forest(place, len(back), words[rows], n[own], rest[own], component[own], side[own]).grow(int(d)).pairs(percent)
            found.append((back[p], back[q]))
    return tuple(np.concatenate([x[k] for x in found]) for k in range(2))


def _candidates(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            number = lambda name, t=table: t[name].to_numpy()
            cid = number("cid")
            i, j = candidates(number("node"), number("side"), number("component"), number("n"), number("rest"), table["bits"].to_pylist(), percent)
            pairs = np.unique(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _tokens(words: int):
    """The tokens of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), STEP_BYTES):
                sets = [x.tobytes() for x in shingle_sets(batch.column(1).slice(a, b - a), words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["cid", "tokens"])

    return run


def _linked_in_nodes(percent: int):
    """Links that join all that is linked in each large node: candidates of its trees, compared on their tokens unless they are joined by then.

    Signatures are FINE times as wide as in small nodes, made here from the tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            cid, node, side, component, n, rest = (table[x].to_numpy() for x in ("cid", "node", "side", "component", "n", "rest"))
            tokens = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
            width = [FINE * signature_bits(int(k)) >> int(f) for k, f in zip(n, table["narrow"].to_pylist(), strict=True)]
            i, j = candidates(node, side, component, n, rest, [signature(x, w) for x, w in zip(tokens, width, strict=True)], percent)
            up: dict[int, int] = {}

            def root(x: int, up: dict = up) -> int:
                while (higher := up.get(x, x)) != x:
                    up[x] = up.get(higher, higher)
                    x = higher
                return x

            found = []
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                x, y = root(int(component[a])), root(int(component[b]))
                if x != y and linked(tokens[a], tokens[b], percent):
                    up[max(x, y)] = min(x, y)
                    found.append((min(cid[a], cid[b]), max(cid[a], cid[b])))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("bits")
        narrow, bits = batch.column(batch.schema.names.index("narrow")).to_pylist(), batch.column(at).to_pylist()
        yield batch.set_column(at, "bits", pa.array([folded(x) if f else x for x, f in zip(bits, narrow, strict=True)], pa.binary()))


def _confirm(words: int, percent: int):
    """The pairs (a, b, text, text_a) whose full sets are linked; texts of a task that recur are cut into shingles once a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), STEP_BYTES):
                part = batch.slice(a, b - a)
                texts = list(dict.fromkeys(part.column(3).to_pylist()))
                left = dict(zip(texts, shingle_sets(pa.array(texts, pa.string()), words), strict=True))
                right = shingle_sets(part.column(2), words)
                ok = pa.array([linked(left[x], y, percent) for x, y in zip(part.column(3).to_pylist(), right, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    return run


def heavy_tokens(docs: DataFrame, text: str, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that start most sets, sorted, and the rank of each by count: HEAVY of them at most."""
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_prefixes(words, percent), "token long").groupBy("token").agg(F.count("*").alias("k"))
    top = counts.where(F.col("k") > HEAVY_AT).orderBy(F.desc("k"), "token").limit(HEAVY).toPandas()
    tokens, k = top["token"].to_numpy(np.int64).view(np.uint64), top["k"].to_numpy(np.int64)
    order = np.argsort(tokens)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, k))] = np.arange(len(tokens))
    return tokens[order], rank[order]


def jaccard_join(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id.

    Words are split at ASCII white space after lower-casing A-Z; a set holds the
    distinct shingles of ``words`` words, or the whole sequence as one shingle
    where there are fewer. Null or blank text has an empty set and is linked
    with nothing. Sets are linked where 100 * intersection >= percent * union.
    component_id is the smallest key reachable through links, itself included.
    Rows that share a key but not a set each have the links of their own text;
    equal rows give equal rows; a row with a null key links nothing and has a
    null component_id. Other columns do not pass. An empty table gives an empty
    one.
    """
    work = Workspace(spark, "jaccard")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    heavy, rank = heavy_tokens(rows, "text", words, percent)
    whole = work.save(rows.mapInArrow(_features(words, percent, heavy, rank), "id long, n long, digest binary, bits binary, roots array<long>, prefix array<long>"), "features")
    feats = work.save(whole.select("id", "n", "digest"), "digests")
    sets = whole.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("least"), *(F.any_value(x).alias(x) for x in ("n", "bits", "roots", "prefix")))
    sets = work.save(sets.withColumn("cid", F.monotonically_increasing_id()), "sets")  # written, so that the numbers stay
    work.drop("features")

    # Sets that share a minwise token, confirmed.
    minwise = sets.select("cid", F.posexplode("roots").alias("k", "root"))
    first = minwise.groupBy("k", "root").agg(F.min("cid").alias("a"), F.max("cid").alias("last")).where("a < last").select("k", "root", "a")
    pairs = work.save(minwise.join(first, ["k", "root"]).select("a", F.col("cid").alias("b")).where("a <> b").distinct(), "pairs")
    links = work.save(_confirmed(rows, sets, pairs, words, percent, work, "pair-texts"), "links")
    work.drop("pair-texts", "pairs")
    found = work.save(components(links, work), "components")

    # Pairs that are still apart, by the trees.
    members = _members(sets, found, percent, work)
    small = members.where(F.col("size") <= SMALL).withColumn("side", F.col("narrow").cast("int")).join(sets.select("cid", "bits"), "cid")
    small = small.select("node", "cid", "side", "component", "n", "rest", "narrow", "bits").mapInArrow(_fold, "node long, cid long, side int, component long, n long, rest long, narrow boolean, bits binary")
    tried = small.repartition("node").sortWithinPartitions("node", "cid").mapInArrow(_candidates(percent), "a long, b long").distinct()
    tried = work.save(tried, "tried")
    more = _confirmed(rows, sets, tried, words, percent, work, "tried-texts")
    large = members.where(F.col("size") > SMALL)
    if not large.isEmpty():
        texts = _texts(rows, sets, large.select("cid").distinct(), words)
        tokens = work.save(texts.mapInArrow(_tokens(words), "cid long, tokens binary"), "tokens")
        cells = _cells(large, block).join(tokens, "cid")
        more = more.union(cells.repartition("node").sortWithinPartitions("node", "cid").mapInArrow(_linked_in_nodes(percent), "a long, b long"))
    more = work.save(more.distinct(), "more")
    work.drop("members", "shared", "tokens", "tried-texts", "tried")
    if not more.isEmpty():
        found = work.save(components(links.union(more), work, "again"), "all")

    named = sets.select("cid", "digest", "least").join(found.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("digest", "component_id")
    out = feats.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _members(sets: DataFrame, found: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """cid, node, size, component, n, rest, narrow: the sets of each node (prefix token, width of the signature, size band) that holds several components.

    Linked sets have sizes in one band or in neighbouring ones, so a set is also
    in the band below its own. What most tokens have is one set: those rows go
    through two shuffles of a few numbers each, without anything else of the set.
    """
    labelled = sets.select("cid", "n", "prefix", F.octet_length("bits").alias("octets")).join(found.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # A set whose smaller partners may have a signature half as wide is also there with its own folded.
    log = F.length(F.bin("octets")) + 2  # the signature has two to the power of this bits
    labelled = labelled.withColumn("log", log).withColumn("half_n", F.expr("shiftleft(1L, log - 2)"))
    both = (F.col("log") > 6) & (F.col("n") * percent <= 100 * F.col("half_n"))
    labelled = labelled.withColumn("narrow", F.explode(F.when(both, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    spread = labelled.select("cid", "component", "narrow", (F.col("log") - F.col("narrow")).alias("width"), F.posexplode("prefix").alias("at", "token"))
    spread = spread.select(F.xxhash64("token", "width").alias("node"), "cid", "component", (F.col("at") * 2 + F.col("narrow")).alias("at"))
    several = spread.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("node")
    shared = work.save(spread.select("node", "cid", "at").join(several, "node"), "shared")
    sizes = labelled.where("narrow = 0").select("cid", "component", "n")
    named = shared.join(sizes, "cid").withColumns({"rest": F.col("n") - F.floor(F.col("at") / 2), "narrow": F.col("at") % 2 == 1})
    width = max(math.log(100 / percent), 1e-3) * (1 + 1e-6)  # a little wider than linked sizes differ, so that rounding moves no set two bands away
    band = F.floor(F.log(F.col("n").cast("double")) / width)
    named = named.withColumn("band", F.explode(F.array(band, band - 1))).withColumn("node", F.xxhash64("node", "band")).drop("band", "at")
    held = named.groupBy("node").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("node", "size")
    return work.save(named.join(held, "node"), "members")


def _cells(members: DataFrame, block: int) -> DataFrame:
    """cid, node, side, component, n, rest, narrow: nodes of up to ``block`` sets as they are, of larger ones the cells.

    In a small node, sets that are there with a folded signature (side 1) meet only
    those of its own width. In a cell, members outside the node's largest component (side 0, dealt into
    rows of cells) meet all members (side 1, dealt into columns).
    """
    names = ["cid", "node", "side", "component", "n", "rest", "narrow"]
    small = members.where(F.col("size") <= block).withColumn("side", F.col("narrow").cast("int"))
    large = members.where(F.col("size") > block)
    sizes = large.groupBy("node", "component").agg(F.count("*").alias("k"))
    most = sizes.groupBy("node").agg(F.max_by("component", F.struct("k", "component")).alias("main"), (F.sum("k") - F.max("k")).alias("outside"))
    large = large.join(most, "node")
    across, down = F.ceil(F.col("size") / block).cast("int"), F.ceil(F.col("outside") / block).cast("int")
    dealt = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), n).cast("int")
    minor = large.where("component <> main").withColumn("i", dealt(down, 1)).withColumn("j", F.explode(F.sequence(F.lit(0), across - 1))).withColumn("side", F.lit(0))
    every = large.withColumn("j", dealt(across, 2)).withColumn("i", F.explode(F.sequence(F.lit(0), down - 1))).withColumn("side", F.lit(1))
    cells = minor.unionByName(every).withColumn("node", F.xxhash64("node", "i", "j"))
    return small.select(*names).union(cells.select(*names))


def _confirmed(rows: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, percent: int, work: Workspace, name: str) -> DataFrame:
    """The pairs of sets (a, b) that are linked, by the text of one row each."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("cid")
    texts = work.save(_texts(rows, sets, wanted, words), name)
    both = pairs.join(texts.select(F.col("cid").alias("b"), "text"), "b").join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text", "text_a").mapInArrow(_confirm(words, percent), "a long, b long")


def _texts(rows: DataFrame, sets: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cid and text of one row of each set that is wanted."""
    chosen = sets.join(wanted, "cid", "left_semi").select("cid", F.col("least").alias("id"), "digest")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of several texts under one id, the one that has the set."""
        for batch in batches:
            for a, b in slices(batch.column(2), STEP_BYTES):
                part = batch.slice(a, b - a)
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in shingle_sets(part.column(2), words)]
                ok = pa.array([x == y for x, y in zip(digests, part.column(1).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(2).filter(ok)], names=["cid", "text"])

    return rows.join(chosen.hint("merge"), "id").select("cid", "digest", "text").mapInArrow(own, "cid long, text string").dropDuplicates(["cid"])
