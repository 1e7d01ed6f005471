"""Encoding, decoding and counting against the tokenizers library: joins of long texts, the cache, and the queries' own columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from planespark.llm import bpe, queries, token_counts
from planespark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
TEXTS = ["", None, " ", "It's  <|endoftext|> ok.", "<|ENDOFTEXT|>x, y", "<|endoftext|>x, y", "It's  <|endoftext|> OK.", "été É, naïve!", "x" * 9000, "a b c", "a b c", "a  b c"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def long_texts():
    rng = random.Random(12)
    words = ["the", "Straße", "été", "it's", "don't", "x" * 40, "naïve", "42", "3.14", "日本", "😀", "<|endoftext|>", "é", "O'Neil", "a_b", "--", "..."]
    prose = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\n\n", "\t", "", ", "]) for _ in range(9000))
    return [
        prose, prose[::-1], "ab" * 20_000, "a" * 30_011, " " * 9000 + "x" + "\n" * 9000, "<|endoftext|>" * 2500, "é" * 20_001,
        prose[:9000] + "q" * 15_000 + prose[:9000], " ".join(rng.choice(words) for _ in range(5000)), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(12_000)),
    ]


@pytest.mark.parametrize("piece", [1000, 4096])
@pytest.mark.parametrize("name", [WORD, BYTE])
def test_long_texts_are_joined_exactly(spark, name, piece):
    lib, texts = library(name), long_texts()
    rows = spark.createDataFrame([(k // 2, x, 1, 2) for k, x in enumerate([*texts, texts[0]])], "doc_id long, text string, ids int, _copy int")
    got = bpe.encode(rows, tokenizer(name), "doc_id", piece_chars=piece).collect()
    want = [(k // 2, lib.encode(x, add_special_tokens=False).ids) for k, x in enumerate([*texts, texts[0]])]
    assert sorted((r.doc_id, r.ids) for r in got) == sorted(want)


def test_pieces_are_joined_by_windows(spark, monkeypatch):
    """Long prose goes through pieces whose ends alone are looked at: each join sees less than two whole pieces."""
    c, seen = bpe.codec(tokenizer(WORD)), []
    text = " ".join(random.Random(1).choice(["stone", "river", "ox", "tall"]) for _ in range(8000))
    cuts = bpe.cut_points(len(text), 4096)
    level = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = text[a:b]
        first, last = c.ends(piece)
        level.append(bpe.Half((piece[:first], c.spans(piece[:first])), bpe.np.array(c.tokenizer.encode(piece[first:last], add_special_tokens=False).ids, bpe.np.int32), (piece[last:], c.spans(piece[last:]))))
    join = c._join
    monkeypatch.setattr(c, "_join", lambda text, *rest: seen.append(len(text)) or join(text, *rest))
    while len(level) > 1:
        level = [bpe.join_halves(c, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    assert level[0].ids().tolist() == c.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(seen) == len(cuts) - 2 and max(seen) < 4 * bpe.END_CHARS


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_second_pass_encodes_only_new_contents(spark, tmp_path, name, monkeypatch):
    lib, cache = library(name), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(k, x, k, "c", 9) for k, x in enumerate(TEXTS)], "doc_id long, text string, content long, _copies string, n_tokens int")
    half = docs.where("doc_id < 6")
    for part in (half, docs, docs, docs.limit(0)):
        before = spark.read.parquet(cache).count() if part is not half else 0
        got = token_counts.count_tokens(spark, part, tokenizer(name), cache)
        assert got.columns == ["doc_id", "text", "content", "_copies", "n_tokens"]
        for r in got.collect():
            assert r.n_tokens == len(lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids) and r.content == r.doc_id
        c = bpe.codec(tokenizer(name))
        contents = {token_counts.content_digest(token_counts.normalised(c, x or "")) for x in (TEXTS if part is not half else TEXTS[:6])}
        assert spark.read.parquet(cache).count() == len(contents) >= before
    assert len(contents) < len({x or "" for x in TEXTS}) or name == BYTE  # what is normalised to the same text is encoded once
    assert token_counts.shared_cache(spark, tokenizer(name)) == token_counts.shared_cache(spark, tokenizer(name))


def test_query_columns_against_the_library(spark):
    """Every column of op2 and op9 on whole tables."""
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lib = library(WORD)
    got = {r.doc_id: r for r in queries.op2_bpe(spark, SF).collect()}
    assert set(got) == set(docs)
    for k, text in docs.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        r = got[k]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(lib.decode(ids, skip_special_tokens=False)))
    lib = library(BYTE)
    got = {r.doc_id: r for r in queries.op9_token_counts(spark, SF).collect()}
    assert set(got) == set(docs)
    for k, text in docs.items():
        n = len(lib.encode(text or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, None)], "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, tokenizer(WORD), "doc_id"), tokenizer(WORD)).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 0), (1, 1), (1, 2), (1, 2)]
    assert bpe.decode(bpe.encode(docs.limit(0), tokenizer(WORD), "doc_id"), tokenizer(WORD)).count() == 0
    assert docs.select(F.col("doc_id")).limit(0).count() == 0
