"""The corpus pipeline, stage by stage, against plain versions."""

import re
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from planespark.llm import language_id, toxicity
from planespark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


def plain_groups(texts, words):
    """Smallest key of each text's component, by comparing all pairs of shingle sets."""
    sets = {}
    for k, x in texts.items():
        w = [y for y in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")) if y]
        sets[k] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    up = {k: k for k in texts}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in texts}


def test_whole_run(spark):
    """run() keeps the documents that plain versions of the stages keep, and its pieces are all their tokens, once each."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    text = dict(docs.select("doc_id", "text").collect())
    assert len(text) == docs.count()
    said = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    letters = {k: sum(c.isalpha() for c in x or "") for k, x in text.items()}
    kept = {k for k in text if said[k].lang_pred != "und" and (said[k].score >= corpus_pipeline.LEAST_SCORE or letters[k] < corpus_pipeline.LEAST_LETTERS)}
    assert 0 < len(kept) <= len(text)
    now = docs.where(docs.doc_id.isin(sorted(kept)))
    scores = {r.doc_id: r.score for r in toxicity.score(now, toxicity.train(now, labels)).collect()}
    kept = {k for k in kept if scores[k] < toxicity.THRESHOLD}
    groups = plain_groups({k: text[k] for k in kept}, 5)
    kept = {k for k in kept if groups[k] == k}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == kept
    lib, at, sizes = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), dict.fromkeys(kept, 0), {}
    for r in sorted(rows, key=lambda r: r.start):
        ids = [*lib.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.doc_tokens) == (at[r.doc_id], len(ids))
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert all(at[k] == len(lib.encode(text[k], add_special_tokens=False).ids) + 1 for k in kept)
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sizes.get(r.sequence_id, 0)
        sizes[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())


def test_stages_on_odd_tables(spark):
    """Empty tables, null and blank texts, repeated rows and columns of the stages' own names."""
    good = "The anthly erhation was whing, and the one of them there. " * 8
    rows = [(k, f"{good} {k}", "en", k, k / 2) for k in (1, 1, *range(10, 22))] + [(2, None, "en", 1, 2.0), (3, "", None, 1, 2.0), (4, "12 34", "en", 1, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _pred int, _score double").withColumn("_row", F.lit(5))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert name == "packing" or got.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        got.collect()
    kept = corpus_pipeline.language(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 1, *range(10, 22)]
    assert all((r._pred, r._score, r._row) == (r.doc_id, r.doc_id / 2, 5) for r in kept)
    assert [tuple(r) for r in corpus_pipeline.distinct(spark, docs.where("doc_id < 10 and text <> '12 34'"), SF).select("doc_id", "_row").collect()] in ([(1, 5), (3, 5)], [(3, 5), (1, 5)])


def test_pipeline_keeps_different_texts_under_one_id(spark):
    first, second, third = (" ".join(f"{c}{k}" for k in range(80)) for c in "abc")
    rows = [(5, first), (5, second), (5, first), (9, second + " end"), (2, third), (7, third), (3, ""), (3, ""), (3, None), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    got = corpus_pipeline.distinct(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(5, first), (5, second), (2, third), (3, ""), (3, None), (None, "x"), (None, "x")]
    assert sorted(map(str, (tuple(r)[:2] for r in got.collect()))) == sorted(map(str, want))
