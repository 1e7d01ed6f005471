"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: it is bit-sliced, so a slot holds a bit
for each language, and the AND of the slots of an n-gram gives every language
that contains it. A text's n-grams are looked up at once; the hits of each
language, less those that false positives would give, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planespark.llm.common import slices, text_bytes, unused

#: Bytes of an n-gram, slots of the filter and slots that each n-gram sets.
GRAM = 4
SLOT_BITS = 20
PROBES = 2
#: Documents of each language that are learned from, at most (chosen by a hash of their id).
TRAIN_DOCS = 2000
#: An n-gram belongs to a language if at least so many of its documents have it, and at least this share of the rate in the language that has it most.
LEAST_DOCS = 3
LEAST_SHARE = 0.1
#: Text without a letter, or null.
UNDETERMINED = "und"
#: Values of the language column, at most: one with more is no column of languages, and training on it raises.
MOST_LANGUAGES = 1024

_PROBE = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_CLASS = np.full(256, 32, np.uint8)  # letters stay, lower-cased; all else is a space
_CLASS[0x80:] = np.arange(0x80, 0x100)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of each text, as 32-bit values, and where each text's begin.

    Texts count as having a space on both sides; n-grams with fewer than
    two letters are left out.
    """
    raw, offsets = text_bytes(column)
    at = np.insert(_CLASS[raw], np.repeat(offsets, 2)[1:-1], 32)
    ends = offsets + 2 * np.arange(len(offsets))
    n = max(len(at) - GRAM + 1, 0)
    value = np.zeros(n, np.uint32)
    letters = np.zeros(n, np.uint8)
    for k in range(GRAM):
        value |= at[k : k + n].astype(np.uint32) << np.uint32(8 * k)
        letters += at[k : k + n] != 32
    keep = letters >= 2
    if n:  # none across two texts
        for k in range(1, GRAM):
            last = ends[1:-1] - k
            keep[last[(last >= 0) & (last < n)]] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return value[keep], kept[np.minimum(ends, n)]


def slots(values: np.ndarray) -> list[np.ndarray]:
    return [(values * _PROBE[k]) >> np.uint32(32 - SLOT_BITS) for k in range(PROBES)]


@dataclass
class LanguageModel:
    """Languages in order of their bits, the slots (one row for each 8 languages), false-positive rates, and the commonest language."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    common: int

    def hits(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits (texts x languages) and n-grams of each text."""
        values, at = grams(column)
        total = np.diff(at)
        out = np.zeros((len(total), len(self.languages)))
        if not self.languages:
            return out, total
        places = slots(values)
        for plane in range(len(self.table)):
            mask = self.table[plane][places[0]]
            for p in places[1:]:
                mask &= self.table[plane][p]
            for bit in range(min(8, len(self.languages) - 8 * plane)):
                seen = np.concatenate([[0], np.cumsum(mask >> bit & 1, dtype=np.int64)])
                out[:, 8 * plane + bit] = seen[at[1:]] - seen[at[:-1]]
        return np.clip((out - total[:, None] * self.false_rate) / (1 - self.false_rate), 0, None), total


def in_training(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_DOCS) -> LanguageModel:
    """Filter of the languages of the training fold; at most ``most`` documents of each language are read for it.

    The counts of n-grams are summed in Spark, and so are the bits of each
    slot; only the slots, whose number is fixed, come to the driver, and the
    sizes of at most MOST_LANGUAGES languages.
    """
    rows = docs.where(in_training(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).agg(F.count("*")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang}")
    languages = sorted(sizes)
    empty = np.zeros((-(-len(languages) // 8), 1 << SLOT_BITS), np.uint8)
    if not languages:
        return LanguageModel([], empty, np.zeros(0), 0)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, most / sizes[k]))])
    unit = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) / (1 << 20)
    sample = rows.where(unit < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    order = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                values, at = grams(batch.column(1).slice(a, b - a))
                which = np.array([order[x] for x in batch.column(0).slice(a, b - a).to_pylist()], np.int64)
                pairs = np.unique(np.repeat(np.arange(b - a, dtype=np.int64), np.diff(at)) << 32 | values.astype(np.int64))
                of, n = np.unique(which[pairs >> 32] << 32 | pairs & 0xFFFFFFFF, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(of & 0xFFFFFFFF), pa.array((of >> 32).astype(np.int32)), pa.array(n)], names=["gram", "language", "n"])

    taken = F.create_map(*[F.lit(x) for k in languages for x in (order[k], float(min(sizes[k], most)))])
    counts = sample.mapInArrow(count, "gram long, language int, n long").groupBy("gram", "language").agg(F.sum("n").alias("n")).withColumn("rate", F.col("n") / taken[F.col("language")])
    best = counts.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("language", "n", "rate")).alias("all"))
    owned = best.select("gram", "best", F.inline("all")).where((F.col("n") >= LEAST_DOCS) & (F.col("rate") >= LEAST_SHARE * F.col("best")))
    places = F.array(*[F.shiftrightunsigned(F.pmod(F.col("gram") * F.lit(int(p)), F.lit(1 << 32)), 32 - SLOT_BITS) for p in _PROBE[:PROBES]])
    bits = owned.select(F.explode(places).alias("slot"), (F.col("language") / 8).cast("int").alias("plane"), F.expr("shiftleft(1, language % 8)").alias("bit"))
    for r in bits.groupBy("plane", "slot").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        empty[r[0], r[1]] = r[2]
    fill = np.array([np.mean(empty[k // 8] >> (k % 8) & 1) for k in range(len(languages))])
    return LanguageModel(languages, empty, fill**PROBES, max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k)))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and the share of the text's n-grams that it contains.

    Ties go to the language first in order; a text whose n-grams no language
    contains gets the commonest language and score 0; null text, or text
    without a letter, gets ``und`` and 0. Columns of the results' names are
    replaced; all other columns pass.
    """
    rows = docs.drop(lang_out, score_out)
    names = [*rows.columns, lang_out, score_out]
    rows = rows.withColumn(unused(rows, "_text"), F.when(F.col(text).rlike("\\p{L}"), F.col(text)))
    model_on = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_on.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(texts, 1 << 20):
                part = texts.slice(a, b - a)
                hits, total = m.hits(part)
                known = part.is_valid().to_numpy(zero_copy_only=False)
                best = hits.argmax(axis=1) if m.languages else np.zeros(len(part), int)
                top = hits[np.arange(len(part)), best] if m.languages else np.zeros(len(part))
                best = np.where(top > 0, best, m.common)
                score = np.where(known, np.clip(top / np.maximum(total, 1), 0, 1), 0.0)
                pred = [m.languages[k] if ok and m.languages else UNDETERMINED for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns[:-1]), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    kind = docs.drop(lang_out, score_out).schema.add(lang_out, "string").add(score_out, "double")
    return rows.mapInArrow(run, kind)
