"""The corpus pipeline: language, toxicity, near-duplicates, packing. Part of the ``llm`` subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planespark.llm import language_id, near_duplicates, packing, toxicity
from planespark.llm.common import Workspace, read, unused
from planespark.llm.queries import tokenizer

#: A document of at least so many letters whose n-grams are this rarely in any language is not in one.
LEAST_LETTERS = 40
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages: those without a letter, null texts, and long texts that no language knows go."""
    pred, score = unused(docs, "_pred"), unused(docs, "_score")
    found = language_id.predict(docs, language_id.train(docs), lang_out=pred, score_out=score)
    letters = F.length(F.regexp_replace("text", "[^\\p{L}]", ""))
    known = (F.col(pred) != language_id.UNDETERMINED) & ((F.col(score) >= LEAST_SCORE) | (letters < LEAST_LETTERS))
    return found.where(known).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below the threshold."""
    model, score = toxicity.train(docs, read(spark, sf_dir, "labels")), unused(docs, "_score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8), that with the smallest id; rows with a null id stay.

    Rows are members by a number of their own: different texts under one id are
    compared like any others and both stay unless they are near-duplicates.
    Rows that repeat id and text are one; texts without a word are near nothing.
    """
    work, row = Workspace(spark, "distinct"), unused(docs, "_row")
    named = docs.where("doc_id is not null")
    blank = F.coalesce(F.btrim("text", F.lit("\t\n\x0b\x0c\r ")), F.lit("")) == ""
    rows = work.save(named.where(~blank).withColumn(row, F.monotonically_increasing_id()), "rows")  # written, so that the numbers stay
    groups = near_duplicates.near_duplicates(spark, rows, key=row, words=5).select(F.col(row).alias("row"), "component_id")
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    kept = groups.join(ids, "row").groupBy("component_id").agg(F.min(F.struct("id", "row"))["row"].alias(row)).select(row)
    filled = rows.join(kept, row, "left_semi").select(*docs.columns)
    return filled.unionByName(named.where(blank).dropDuplicates(["doc_id", "text"])).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("packing", pack)]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again as the next one's documents."""
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
