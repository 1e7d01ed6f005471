"""The classifiers against plain versions: exact n-gram sets, a dense refit, and held-out rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from planespark.llm import language_id, toxicity

SF = "/root/testdata/sf0.01"


def held_out(key):
    return zlib.crc32(str(key).encode()) % 3 == 1


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def plain_grams(text):
    """4-byte windows with two letters at least, of the text between two spaces."""
    at = b" " + bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in text.encode()) + b" "
    return [at[k : k + 4] for k in range(len(at) - 3) if 4 - at[k : k + 4].count(b" ") >= 2]


def test_language_filter_against_exact_sets(spark):
    """The filter's corrected hits stay close to those of exact sets of n-grams, and both give the same language."""
    docs, _ = tables(spark)
    rows = docs.where("text is not null").select("doc_id", "text", "lang").collect()
    seen, sizes = {}, {}
    for r in rows:
        if r.lang is not None and not held_out(r.doc_id):
            sizes[r.lang] = sizes.get(r.lang, 0) + 1
            for g in set(plain_grams(r.text)):
                seen.setdefault(g, {}).setdefault(r.lang, 0)
                seen[g][r.lang] += 1
    owned = {}
    for g, n in seen.items():
        rate = {k: n[k] / sizes[k] for k in n}
        owned[g] = {k for k in n if n[k] >= language_id.LEAST_DOCS and rate[k] >= language_id.LEAST_SHARE * max(rate.values())}
    model = language_id.train(docs)
    assert model.languages == sorted(sizes)
    some = [r for r in rows if re.search(r"[^\W\d_]", r.text)][:150]
    hits, total = model.hits(pa.array([r.text for r in some]))
    for r, h, n in zip(some, hits, total, strict=True):
        grams = plain_grams(r.text)
        exact = np.array([sum(k in owned.get(g, ()) for g in grams) for k in model.languages])
        assert n == len(grams) and np.abs(h - exact).max() <= 3 + 0.05 * n
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    out = [r for r in rows if r.lang is not None and held_out(r.doc_id) and got[r.doc_id].lang_pred != "und"]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) >= 0.99 * len(out)


def test_language_of_tables_with_clashing_columns(spark):
    docs, _ = tables(spark)
    model = language_id.train(docs)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    odd = docs.select("doc_id", "text", F.lit(1).alias("_text"), F.lit("x").alias("lang_pred"), F.lit(2).alias("SCORE"))
    got = language_id.predict(odd.union(odd.limit(5)), model)
    assert got.columns == ["doc_id", "text", "_text", "lang_pred", "score"]
    assert {r.doc_id: (r.lang_pred, r.score) for r in got.collect()} == plain
    assert language_id.predict(odd.limit(0), model).count() == 0


def plain_features(text):
    """Words and word beginnings, by the definition."""
    found = set()
    for w in re.findall(rb"[a-z\x80-\xff]+", toxicity.lower(np.frombuffer(text.encode(), np.uint8)).tobytes()):
        found |= {(0, w)} | {(k, w[:k]) for k in toxicity.PREFIXES if len(w) >= k}
    return found


def test_word_features_are_one_to_one():
    texts = ["Été idiot IDIOTS, x", "", None, "a-b idiot", "ÜBER über"]
    h, doc = toxicity.word_features(pa.array(texts))
    mine = [{int(x) for x in h[doc == k]} for k in range(len(texts))]
    plain = [plain_features(x or "") for x in texts]
    assert [len(x) for x in mine] == [len(x) for x in plain]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(mine[i] & mine[j]) == len(plain[i] & plain[j])


def test_fit_against_dense_descent():
    """Weights are those of plain gradient descent on the dense matrix, counterfactual penalty included."""
    rng = np.random.default_rng(3)
    x = (rng.random((80, 6)) < 0.4).astype(float)
    y = ((x @ [2, -1, 1, 0, 0, 1] + rng.normal(size=80)) > 1).astype(int)
    pairs = [(np.array([0, 3]), np.array([0, 4])), (np.array([5]), np.array([2])), (np.array([1]), np.array([1]))]
    d = np.array([np.isin(range(6), b).astype(float) - np.isin(range(6), a) for a, b in pairs])
    kept, toxicity.RIDGE = toxicity.RIDGE, 0.01
    try:
        w, b = toxicity.fit([(np.flatnonzero(r), k) for r, k in zip(x, y, strict=True)], pairs, 6, 2.0)
    finally:
        toxicity.RIDGE = kept
    weight = np.where(y == 1, toxicity.TOXIC_WEIGHT, 1.0) / 80

    def cost(v):
        z = x @ v[:6] + v[6]
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.01 / 2 * (v[:6] ** 2).sum() + 2.0 / 2 * ((d @ v[:6]) ** 2).mean()

    v = np.zeros(7)
    for _ in range(20_000):
        z = x @ v[:6] + v[6]
        e = weight * (1 / (1 + np.exp(-z)) - y)
        v -= 0.3 * np.append(x.T @ e + 0.01 * v[:6] + 2.0 * d.T @ (d @ v[:6]) / len(d), e.sum())
    assert cost(np.append(w, b)) - cost(v) < 1e-3
    assert np.abs(w - v[:6]).max() < 0.1


def test_counterfactuals_on_given_tables(spark):
    """The corpus names no group, yet there are pairs; paying for them moves the names' weights and calms mentions."""
    docs, labels = tables(spark)
    found = toxicity.sample(docs, labels)
    assert len(found.pairs) > 100 and len(found.rows) > len(found.pairs) / 10
    names = np.concatenate(list(toxicity.term_features(toxicity.IDENTITY_TERMS).values()))
    at = np.searchsorted(found.features, np.unique(names))
    assert (found.features[at] == np.unique(names)).all()
    free, paid = (toxicity.ToxicityModel(found.features, *toxicity.fit(found.rows, found.pairs, len(found.features), c)) for c in (0.0, toxicity.COUNTERFACTUAL))
    assert np.abs(free.weights[at] - paid.weights[at]).max() > 0.01
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").where("text is not null").select("text").limit(100).collect()]
    shift = [np.abs(m.scores(pa.array([f"{x} muslim" for x in clean])) - m.scores(pa.array([f"{x} christian" for x in clean]))).mean() for m in (free, paid)]
    assert shift[1] < shift[0] / 2


def test_toxicity_scores_by_plain_sums(spark):
    """op3's scores are the logistic of the bias and the weights of the text's features; labels of other folds change nothing."""
    docs, labels = tables(spark)
    model = toxicity.train(docs, labels)
    rows = docs.select("doc_id", "text").limit(60).collect()
    got = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text", F.lit(3).alias("score"), F.lit(1).alias("features")), model).collect()}
    table = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    for r in rows:
        h, _ = toxicity.word_features(pa.array([r.text]))
        z = model.bias + sum(table.get(x, 0.0) for x in set(h.tolist()))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.train(docs, other).weights == model.weights).all()
    doubled = toxicity.train(docs.union(docs), labels.union(labels))
    assert len(doubled.weights) > 0 and toxicity.score(docs.limit(0), doubled).count() == 0
    assert len(toxicity.train(docs.limit(0), labels).weights) == 0


def test_mentions():
    found = list(toxicity.mentions("Women and WOMEN, a man"))
    assert [(toxicity.IDENTITY_TERMS[i][j], rest) for i, j, rest in found] == [("man", "Women and WOMEN, a  "), ("women", "  and  , a man")]
    assert list(toxicity.mentions("romans")) == []


def test_random_words_have_no_mention():
    rng = random.Random(0)
    assert not list(toxicity.mentions(" ".join("".join(rng.choice("xyz") for _ in range(5)) for _ in range(50))))
