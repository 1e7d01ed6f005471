"""The ``opN_`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planespark.llm.common import Workspace, read


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm.near_duplicates import near_duplicates

    return near_duplicates(spark, read(spark, sf_dir, "documents"), words=4)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm.bpe import decode, encode

    path = tokenizer("word_bpe_49k.json")
    both = decode(encode(read(spark, sf_dir, "documents"), path, "doc_id"), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of this run alone, so that every run does all the work: one half of the documents first, then all, which finds the half."""
    from planespark.llm.token_counts import count_tokens, fill

    cache, path = f"{Workspace(spark, 'token-cache').path}/cache", tokenizer("byte_bpe_50k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    fill(spark, docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), path, cache)
    counted = count_tokens(spark, docs, path, cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm import toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm import language_id

    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm import warc

    work = Workspace(spark, "warc")
    folder = f"{work.path}/archives"
    manifest = work.save(warc.write(warc.classified(read(spark, sf_dir, "pages"), work), folder), "manifest")
    return warc.read(manifest, folder).drop("url", "payload")


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm import gif

    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), gif.payload(F.col("text")).alias("payload"))
    shown = gif.frames(gif.to_media(docs, "payload")).select("doc_id", "n_bytes", "media", gif.samples("frames").alias("back"), F.expr(f"aggregate(frames, array_repeat(0L, {gif.BINS}), (a, f) -> zip_with(a, f.histogram, (x, y) -> x + y))").alias("bins"), F.size("frames").alias("n_frames"))
    return shown.select(
        "doc_id", "n_bytes", F.octet_length("back").cast("long").alias("payload_bytes"), F.sha2("back", 256).alias("payload_sha256"), F.crc32(F.expr("substring(back, -16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), F.col("n_frames"), F.lit(";bins="), F.array_join(F.col("bins").cast("array<string>"), ",")).alias("feature"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm import chat

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(tricky)))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm import topk

    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.search(spark, vectors, "vec_id % 100 = 0")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm.alignment import align

    return align(spark, read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm.jaccard import jaccard_join

    return jaccard_join(spark, read(spark, sf_dir, "documents"), words=4, percent=85)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planespark.llm.centroids import cluster

    return cluster(spark, read(spark, sf_dir, "embeddings"))
