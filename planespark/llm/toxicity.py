"""Toxicity: logistic regression over words and word beginnings, regularised by counterfactuals.

The features of a text are its distinct words and the first bytes of its words
(so that inflected forms share a feature). Those that go with the label are
selected from counts made in Spark; the features of the names of groups are
always among them. Every labelled text that names a group gives counterfactuals,
in which the name is swapped for each other one of its line, and the fit pays
for every change of score between a text and its counterfactuals. As a corpus
may name few groups, a share of the labelled texts gets a name put in: these
count as labelled texts too, and give counterfactuals like the others. A mere
mention of a group is so kept from raising scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planespark.llm.common import slices, text_bytes

#: Labelled documents of each class that are learned from, at most (chosen by a hash of their id).
TRAIN_DOCS = 10_000
#: Features of the model, at most; documents that must have one; and its least G-squared against the label.
FEATURES = 4000
LEAST_DOCS = 4
LEAST_G2 = 8.0
#: Lengths in bytes of the word beginnings.
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of the squared change of the score (before the logistic function) under a swap, and of the squared weights.
COUNTERFACTUAL = 5.0
RIDGE = 3e-5
#: Weight of a toxic text against a clean one in the fit: toxic texts are few, and a missed one costs more.
TOXIC_WEIGHT = 8.0
THRESHOLD = 0.7
#: One in so many of the labelled documents that name no group gets a name put in (chosen by a hash of the id, as is the name).
PUT_IN = 4
#: Names of groups, swapped within each line; the last is the neutral word.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "person"),
    ("black", "white", "asian", "latino", "african", "person"),
    ("women", "men", "people"),
    ("woman", "man", "person"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "person"),
    ("immigrants", "refugees", "foreigners", "people"),
    ("old", "young", "disabled", "blind", "deaf", "person"),
)

_RANDOM = np.random.Generator(np.random.PCG64(7))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TAG = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []
#: Sieve before the exact look-up of a feature.
_SIEVE_BITS = 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, (1 << 20) + 1), base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


def lower(raw: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and Latin-1 letters of UTF-8 bytes."""
    raw = raw.copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    if len(raw) > 1:
        after = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        raw[1:][after] += 32
    return raw


def word_features(column) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of every word of each text (words and beginnings, repeats included) and the text each belongs to."""
    raw, offsets = text_bytes(column)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = lower(raw)
    letter = (raw >= 0x80) | ((raw >= 97) & (raw <= 122))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, stop = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:-1]
    stop[:-1] &= ~letter[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up, out=sums[1:])
    doc = np.searchsorted(offsets, first, "right") - 1
    hashes, docs = [(sums[last] - sums[first]) * down[first] + _TAG[0]], [doc]
    for k in PREFIXES:
        on = np.flatnonzero(last - first >= k)
        hashes.append((sums[first[on] + k] - sums[first[on]]) * down[first[on]] + _TAG[k])
        docs.append(doc[on])
    h = np.concatenate(hashes)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), np.concatenate(docs)


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self.features >> np.uint64(64 - _SIEVE_BITS)] = True

    def present(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature number) of every feature that a text has, once each."""
        h, doc = word_features(column)
        on = np.flatnonzero(self.sieve[h >> np.uint64(64 - _SIEVE_BITS)])
        h, doc = h[on], doc[on]
        at = np.minimum(np.searchsorted(self.features, h), max(len(self.features) - 1, 0))
        hit = self.features[at] == h if len(self.features) else np.zeros(len(h), bool)
        pairs = np.unique(doc[hit] * np.int64(len(self.features) + 1) + at[hit])
        return pairs // (len(self.features) + 1), pairs % (len(self.features) + 1)

    def scores(self, column) -> np.ndarray:
        doc, feature = self.present(column)
        z = self.bias + np.bincount(doc, self.weights[feature], len(column)) if len(doc) else np.full(len(column), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def mentions(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Iterator[tuple[int, int, str]]:
    """Line and number of each group name in the text, and the text with that name taken out; one copy of the text at a time."""
    names = {word: (i, j) for i, line in enumerate(terms) for j, word in enumerate(line[:-1])}
    if not names:
        return
    seen = {m.lower() for m in re.findall(rf"\b(?:{'|'.join(map(re.escape, names))})\b", text, re.IGNORECASE)}
    for word in sorted(seen & set(names)):
        yield *names[word], re.sub(rf"\b{re.escape(word)}\b", " ", text, flags=re.IGNORECASE)


def term_features(terms: tuple[tuple[str, ...], ...]) -> dict[str, np.ndarray]:
    """Feature hashes of every name."""
    return {word: np.unique(word_features(pa.array([word], pa.string()))[0]) for line in terms for word in line}


def fit(rows: list[tuple[np.ndarray, int]], pairs: list[tuple[np.ndarray, np.ndarray]], n: int, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and bias from (features, label) and from (features, features after a swap); gradient steps with momentum."""
    y = np.array([x[1] for x in rows], float)
    each = np.where(y == 1, TOXIC_WEIGHT, 1.0) / max(len(rows), 1)
    row = np.repeat(np.arange(len(rows)), [len(x[0]) for x in rows])
    col = np.concatenate([x[0] for x in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    gone = [np.setdiff1d(a, b) for a, b in pairs]
    come = [np.setdiff1d(b, a) for a, b in pairs]
    p_row = np.repeat(np.arange(len(pairs)).repeat(2), [len(x) for ab in zip(gone, come, strict=True) for x in ab]) if pairs else np.zeros(0, np.int64)
    p_col = np.concatenate([x for ab in zip(gone, come, strict=True) for x in ab]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    p_sign = np.concatenate([np.full(len(x), s) for ab in zip(gone, come, strict=True) for x, s in zip(ab, (-1.0, 1.0), strict=True)]) if pairs else np.zeros(0)
    w, b = np.zeros(n), 0.0
    m_w, v_w, m_b, v_b = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, 601):
        z = b + np.bincount(row, w[col], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * each
        g_w = np.bincount(col, error[row], n) + RIDGE * w
        if len(p_row):
            change = np.bincount(p_row, p_sign * w[p_col], len(pairs))
            g_w += counterfactual * np.bincount(p_col, p_sign * change[p_row], n) / len(pairs)
        g_b = error.sum()
        m_w, m_b = 0.9 * m_w + 0.1 * g_w, 0.9 * m_b + 0.1 * g_b
        v_w, v_b = 0.99 * v_w + 0.01 * g_w**2, 0.99 * v_b + 0.01 * g_b**2
        rate = 0.1 / (1 + step / 150)
        w = w - rate * (m_w / (1 - 0.9**step)) / (np.sqrt(v_w / (1 - 0.99**step)) + 1e-8)
        b = b - rate * (m_b / (1 - 0.9**step)) / (np.sqrt(v_b / (1 - 0.99**step)) + 1e-8)
    return w, float(b)


@dataclass
class Sample:
    """What the fit sees: hashes of the features, (features, label) of each text, (features, features after a swap) of each counterfactual."""

    features: np.ndarray
    rows: list[tuple[np.ndarray, int]]
    pairs: list[tuple[np.ndarray, np.ndarray]]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_DOCS, counterfactual: float = COUNTERFACTUAL, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> ToxicityModel:
    """Fit on the labelled rows of the training fold, at most ``most`` documents of each class.

    A document with several labels counts as toxic if one says so. Labels
    other than 0 and 1, and null texts, are left out; of rows that share an id
    one is learned from. Without a toxic and a clean document the model says
    the toxic share of what there is, or 0.
    """
    found = sample(docs, labels, key, text, label, most, terms)
    if isinstance(found, float):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.clip(30 * (2 * found - 1), -30, 30)))
    weights, bias = fit(found.rows, found.pairs, len(found.features), counterfactual)
    return ToxicityModel(found.features, weights, bias)


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_DOCS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Sample | float:
    """The sample that ``train`` fits; the toxic share (0 for no document) where there is only one class."""
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1
    known = labels.where(fold & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("label"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = part if picked is None else picked.union(part)
    texts = docs.where(fold & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    chosen_texts = texts.join(F.broadcast(picked), "id").select("text", "label", F.xxhash64("id").alias("draw"))  # at most 2 * most ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20):
                h, doc = word_features(batch.column(0).slice(a, b - a))
                y = batch.column(1).slice(a, b - a).to_numpy()
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[new], doc[new]
                values, which = np.unique(h, return_inverse=True)
                n = np.bincount(which, minlength=len(values))
                toxic = np.bincount(which, y[doc], len(values)).astype(np.int64) if len(values) else np.zeros(0, np.int64)
                docs_of = np.zeros((len(values) + 1, 2), np.int64)
                docs_of[:-1, 0], docs_of[:-1, 1] = n, toxic
                docs_of[-1] = b - a, y.sum()  # the row of all documents
                yield pa.RecordBatch.from_arrays([pa.array([*values.view(np.int64).tolist(), None], pa.int64()), pa.array(docs_of[:, 0]), pa.array(docs_of[:, 1])], names=["feature", "n", "toxic"])

    counts = chosen_texts.select("text", "label").mapInArrow(count, "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("feature").isNull() | (F.col("n") >= LEAST_DOCS))
    all_docs = counts.where("feature is null").head()
    total, positive = (all_docs["n"], all_docs["toxic"]) if all_docs else (0, 0)
    if not 0 < positive < total:
        return positive / total if total else 0.0
    share = positive / total
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    n, t = F.col("n"), F.col("toxic")
    g2 = 2 * (part(t, n * share) + part(n - t, n * (1 - share)))
    chosen = counts.where("feature is not null").where((t > n * share) & (g2 >= LEAST_G2)).orderBy(g2.desc(), "feature").limit(FEATURES).select("feature")
    of_terms = term_features(terms)
    features = np.unique(np.concatenate([np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64), *of_terms.values()]))
    shell = ToxicityModel(features, np.zeros(len(features)), 0.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line", pa.int32()), ("word", pa.int32()), ("rest", pa.list_(pa.int32()))]))
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20):
                texts = batch.column(0).slice(a, b - a)
                doc, feature = shell.present(texts)
                own = np.split(feature, np.searchsorted(doc, np.arange(1, b - a)))
                named = [[{"line": i, "word": j, "rest": shell.present(pa.array([rest], pa.string()))[1].tolist()} for i, j, rest in mentions(x, terms)] for x in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([x.tolist() for x in own], pa.list_(pa.int32())), pa.array(named, kind)], names=["label", "draw", "own", "named"])

    shown = chosen_texts.mapInArrow(present, "label int, draw long, own array<int>, named array<struct<line:int,word:int,rest:array<int>>>")
    once = shown.groupBy("draw").agg(F.min(F.struct("label", "own", "named")).alias("one")).select("draw", "one.*")  # bounded by the sample, also where ids repeat
    number = {word: np.searchsorted(features, h) for word, h in of_terms.items()}
    rows, pairs = [], []
    for r in once.orderBy("draw").collect():
        own = np.array(r["own"], np.int64)
        rows.append((own, r["label"]))
        named = [(x["line"], x["word"], np.array(x["rest"], np.int64)) for x in r["named"]]
        draw = r["draw"] % (1 << 62)
        if not named and terms and draw % PUT_IN == 0:
            line = draw // PUT_IN % len(terms)
            word = draw // PUT_IN // len(terms) % (len(terms[line]) - 1)
            named = [(line, word, own)]
            rows.append((np.union1d(own, number[terms[line][word]]), r["label"]))
        for line, word, rest in named:
            here = np.union1d(rest, number[terms[line][word]])
            pairs += [(here, np.union1d(rest, number[other])) for k, other in enumerate(terms[line]) if k != word]
    return Sample(features, rows, pairs)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; null and empty texts get that of a text without features."""
    rows = docs.drop(out)
    names = [*rows.columns, out]
    kind = docs.drop(out).schema.add(out, "double")
    at = rows.columns.index(text)
    model_on = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_on.value
        for batch in batches:
            for a, b in slices(batch.column(at), 1 << 20):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.scores(part.column(at)), pa.float64())], names=names)

    return rows.mapInArrow(run, kind)
