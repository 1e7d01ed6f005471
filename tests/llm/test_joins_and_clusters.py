"""Operators 11 to 13 against plain versions: alignment, exact Jaccard join, centroid clustering."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from planespark.llm import alignment, centroids, common, jaccard, queries
from planespark.llm.common import Workspace
from planespark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
BYTE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = ["", None, " ", "  two  spaces ", "It's <|endoftext|> ok.<s></s>", "été É, naïve!", "\x1c a\x1db\t\n", "日本語 😀😀 ｶ", "x" * 9000, "ab1!é" * 3000, "a b c d", "a b c d", "▁ low line", " ▁a", "nul\x00 byte", "　wide", "café é"]


def aligned_plainly(texts):
    """Rows of the alignment, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(tokenizer(BYTE)), SentencePieceProcessor(model_file=tokenizer(PIECE))
    a_lib.encode_special_tokens = True
    letters = {chr(b): b for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
    letters |= {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if chr(x) not in letters)}
    rows, count = [], Counter()
    for text in texts:
        want = b" " + (text or "").encode()
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = [np.cumsum([0, *map(len, x)]).tolist() for x in (a_bytes, b_bytes)]
        links, j = [], 0
        for i in range(len(a)):
            while j and spans[1][j] > spans[0][i]:
                j -= 1
            k = j
            while k < len(b) and spans[1][k] < spans[0][i + 1]:
                if spans[1][k + 1] > spans[0][i]:
                    links.append((a[i], b[k]))
                k += 1
            j = max(0, k - 1)
        ends = sorted(set(spans[0][1:]) & set(spans[1][1:]))
        text_of, at = [], [0, 0]
        for e in ends:
            n = [spans[s].index(e) for s in range(2)]
            text_of.append(",".join(map(str, a[at[0] : n[0]])) + "|" + ",".join(map(str, b[at[1] : n[1]])))
            at = n
        rows.append((len(a), len(b), len(ends), links, ";".join(text_of)))
        count.update(set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return [(na, nb, ng, len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), digest(g)) for na, nb, ng, x, g in rows]


def test_alignment(spark):
    """Also in short runs, and with counts that most pairs have to look up by a join."""
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["stone", "river's", "naïve", "42", "--", "日本", "<s>"]) for _ in range(rng.randrange(1, 400))) for _ in range(12)]
    docs = spark.createDataFrame([(k // 2 if k else None, x, 1, "r") for k, x in enumerate(texts)], "doc_id long, text string, n_a int, row string").repartition(3)
    want = sorted((str(k // 2 if k else None), *r) for k, r in enumerate(aligned_plainly(texts)))
    for block, hot in ((alignment.BLOCK, alignment.HOT), (7, 5)):
        got = alignment.align(spark, docs, tokenizer(BYTE), tokenizer(PIECE), block=block, hot=hot)
        assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()) == want
        assert alignment.align(spark, docs.limit(0), tokenizer(BYTE), tokenizer(PIECE), block=block, hot=hot).count() == 0


def test_alignment_groups(spark):
    docs = spark.createDataFrame([(1, "unaligned wörds"), (2, "")], "doc_id long, text string")
    rows = sorted(map(tuple, alignment.groups(docs, tokenizer(BYTE), tokenizer(PIECE), block=2).collect()))
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, _, a, b in rows)
    assert hashlib.sha256(text.encode()).hexdigest() == aligned_plainly(["unaligned wörds"])[0][-1]
    assert [r[1] for r in rows[1:]] == [r[2] for r in rows[:-1]] and rows[-1][2] == len(" unaligned wörds".encode()) and {r[0] for r in rows} == {1}


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *x) for r, x in zip(docs, aligned_plainly([r.text for r in docs]), strict=True))
    assert sorted(tuple(r) for r in queries.op11_alignment(spark, SF).collect()) == want


def sets_of(texts, words):
    out = []
    for x in texts:
        w = (x or "").lower().split()
        out.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return out


@pytest.mark.parametrize(("small", "block", "percent", "heavy"), [(32, 1024, 85, 16), (2, 4, 85, 2), (32, 1024, 50, 16), (3, 8, 60, 1)])
def test_jaccard_join(spark, monkeypatch, small, block, percent, heavy):
    """Small nodes and blocks send groups through the cells; low similarities put pairs in trees of folded signatures."""
    monkeypatch.setattr(jaccard, "HEAVY_AT", heavy)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(percent + block)
    texts = [None, "", "  ", "one two", "ONE two", "short text here", "a", "a"]
    passage = [f"p{k}" for k in range(40)]
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 16, 33, 70, 140]))] + passage * (g % 3 == 0)
        for _ in range(3 + 3 * g):
            out = list(base)
            for _ in range(rng.randrange(0, 6)):
                out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(out[: rng.choice([len(out), int(len(out) * 0.9)])]))
    sets = sets_of(texts, 3)
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    docs = spark.createDataFrame([(k, x, 1, b"") for k, x in enumerate(texts)], "doc_id long, text string, component int, bits binary").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark, docs, words=3, percent=percent, block=block).collect()}
    assert got == {k: (len(sets[k]), root(k)) for k in range(len(texts))}


def test_jaccard_join_of_odd_rows(spark):
    """Different texts under one id, repeated rows, null ids, an empty table."""
    first, second = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(5, first), (5, second), (5, second), (9, second + " end"), (7, first + " end"), (None, first), (8, ""), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r.doc_id, r.component_id)) for r in jaccard.jaccard_join(spark, table).collect())
    assert got == sorted(map(str, [(5, 5), (5, 5), (5, 5), (9, 5), (7, 5), (None, None), (8, 8), (3, 3)]))
    assert jaccard.jaccard_join(spark, table.limit(0)).count() == 0


def test_bounds_of_trees_lose_no_pair():
    """Every pair that is linked is among the candidates of a node that holds both."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(20, 60))) for _ in range(60)]
    bits = [jaccard.signature(x, 64) for x in sets]  # far too narrow: many tokens share a bit
    n = np.array([len(x) for x in sets])
    zero = np.zeros(60, np.int64)
    i, j = jaccard.candidates(zero, zero, np.arange(60), n, n, bits, 10)
    near = {(a, b) for a in range(60) for b in range(a) if jaccard.linked(sets[a], sets[b], 10)}
    assert near and near <= {(max(x), min(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
    assert np.array_equal(np.frombuffer(jaccard.folded(jaccard.signature(sets[0], 128)), np.uint8), np.frombuffer(bits[0], np.uint8))


def plain_clusters(vectors, start, rounds):
    c = [list(x) for x in start]

    def nearest(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, z, strict=True)) for z in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        label = [nearest(x)[0] for x in vectors]
        for k in range(len(c)):
            own = [x for x, z in zip(vectors, label, strict=True) if z == k]
            if own:
                c[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [nearest(x) for x in vectors], c


@pytest.mark.parametrize(("tree", "leaf", "spread", "size"), [(4096, 32, 1.0, 1), (16, 2, 0.05, 1), (50, 4, 0.02, 40_000.0), (64, 1, 0.0, 1)])
def test_centroids(spark, tree, leaf, spread, size):
    """Few dimensions and tight clusters, so that boxes rule centroids out; values beyond exact floats; many ties."""
    rng = np.random.default_rng(int(spread * 100) + tree)
    middles = rng.normal(size=(6, 3))
    values = (middles[rng.integers(0, 6, 300)] + spread * rng.normal(size=(300, 3))) * size
    rows = [(k // 2 * 2 if k < 20 else k, v.tolist(), 7) for k, v in enumerate(values)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(4)
    got = centroids.cluster(spark, table, n=8, rounds=3, dim=3, tree=tree, leaf=leaf).collect()
    x = [[int(np.floor(256 * c)) for c in v] for _, v, _ in rows]
    order = sorted((hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), v) for r, v in zip(rows, x, strict=True))
    label, c = plain_clusters(x, [v for _, v in order[:8]], 3)
    inertia = Counter()
    for k, d in label:
        inertia[k] += d
    name = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in c]
    want = sorted((r[0], k, d, inertia[k], sum(inertia.values()), name[k]) for r, (k, d) in zip(rows, label, strict=True))
    assert sorted(map(tuple, got)) == want


def test_boxes_spare_comparisons(spark):
    rng = np.random.default_rng(9)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(8, 2))[rng.integers(0, 8, 800)] * 20 + rng.normal(size=(800, 2)))], "vec_id long, embedding array<double>")
    vectors = centroids.quantised(table, dim=2)
    trees = Workspace(spark, "boxes").save(centroids.plant(vectors, 2, 400, 8), "trees")
    spared, whole = centroids.saved_work(trees, np.array(centroids.start(vectors, 8), np.int64))
    assert spared > 0.5 and whole > 0.3


def test_centroids_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.5]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [1e300, -1e300]), (8, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroids.cluster(spark, table, dim=2).collect()
    assert sorted(str((r.vec_id, r.distance)) for r in got) == sorted(map(str, [(1, 0), (1, 0), (None, 64**2), (7, 0)])) or len(got) == 4
    assert {r.vec_id: r.distance for r in got}[7] == 0
    empty = centroids.cluster(spark, table.limit(0), dim=2)
    assert empty.count() == 0 and empty.columns == got[0].__fields__
    assert centroids.cluster(spark, table.where(F.col("vec_id").isNull()), dim=2).count() == 0


def test_saved_tables_leave_no_shuffle_files(spark):
    """Shuffle files that led to a table go when it is written, without a collection of the driver's garbage."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def ours():
        files = blocks.getAllFiles()
        return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}

    before, setting = ours(), spark.conf.get(common.CLEANUP)
    Workspace(spark, "left").save(spark.range(20_000).groupBy(F.xxhash64("id").alias("k")).count(), "table")
    end = time.time() + 20
    while ours() - before and time.time() < end:
        time.sleep(0.2)
    assert not ours() - before
    assert spark.conf.get(common.CLEANUP) == setting
