"""GIF streams against a plain decoder that follows the format code by code."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planespark.llm import gif, queries

SF = "/root/testdata/sf0.001"


def plain_decode(data, code_size):
    """LZW one code at a time, with a table of strings."""
    clear, end, out, at, width = 1 << code_size, (1 << code_size) + 1, bytearray(), 0, code_size + 1
    value = int.from_bytes(data, "little")
    table, before = {}, None
    while at + width <= 8 * len(data):
        code = value >> at & (1 << width) - 1
        at += width
        if code == end:
            break
        if code == clear:
            table, width, before = {k: bytes([k]) for k in range(clear)}, code_size + 1, None
            free = end + 1
            continue
        text = table[code] if code in table else before + before[:1]
        if before is not None and free < 4096:
            table[free] = before + text[:1]
            free += 1
        if free == 1 << width and width < 12:
            width += 1
        out += text
        before = text
    return bytes(out)


def plain_encode(samples, code_size, deferred):
    """LZW that never clears a full table (``deferred``), or clears it at once; code_size + 1 to 12 bits."""
    clear, end = 1 << code_size, (1 << code_size) + 1
    bits, at = 0, 0
    chunks, first = [], 0

    def put(code, width):
        nonlocal bits, at
        bits |= code << at
        at += width
        if at > 4096:
            chunks.append((bits & (1 << 4096) - 1).to_bytes(512, "little"))
            bits >>= 4096
            at -= 4096

    width, table, free, codes = code_size + 1, {}, end + 1, 0
    put(clear, width)
    run = b""
    for x in samples:
        if run + bytes([x]) in table or not run:
            run += bytes([x])
            continue
        put(table[run] if len(run) > 1 else run[0], width)
        codes += 1
        if free < 4096:
            table[run + bytes([x])] = free
            free += 1
            if free > 1 << width and width < 12:
                width += 1
        elif not deferred:
            put(clear, width)
            table, free, width = {}, end + 1, code_size + 1
        run = bytes([x])
    if run:
        put(table[run] if len(run) > 1 else run[0], width)
        if free < 4096 and free + 1 > 1 << width and width < 12:
            width += 1
    put(end, width)
    return b"".join(chunks) + bits.to_bytes((at + 7) // 8, "little"), codes


@pytest.mark.parametrize(("code_size", "n", "deferred"), [(8, 20_000, True), (8, 20_000, False), (8, 3_000_000, True), (2, 60_000, True), (2, 60_000, False), (8, 1, True), (8, 4000, True)])
def test_streams(code_size, n, deferred):
    rng = random.Random(n)
    samples = bytes(rng.randrange(1 << code_size) if n < 100_000 else rng.choice(b"aab") + k % 3 for k in range(n))
    data, codes = plain_encode(samples, code_size, deferred)
    if n <= 60_000:
        assert plain_decode(data, code_size) == samples
    if (n, code_size) == (20_000, 8):
        assert codes > 8192
    assert gif.unpack_lzw(data, code_size, n) == samples
    if n > 1:
        with pytest.raises(ValueError, match="samples in the stream"):
            gif.unpack_lzw(data, code_size, n + 1)


def test_own_streams_by_plain_decoder():
    rng = random.Random(8)
    images = [bytes(rng.randrange(256) if k % 2 else rng.choice(b"ab") for _ in range(192 * (k % 16 + 1))) for k in range(40)]
    for image, codes in zip(images, gif.lzw_codes([np.frombuffer(x, np.uint8) for x in images]), strict=True):
        assert plain_decode(gif.pack_codes(codes), 8) == image


def test_query_against_plain_columns(spark):
    """Every digest column of op8 on a whole table; the stored form read by the plain decoder."""
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op8_gif(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        whole = raw + b" " * (192 - len(raw) if len(raw) < 192 else -len(raw) % 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest())
        assert r.tail_crc32 == zlib.crc32(whole[-16:])
        assert r.feature.startswith(f"frames={-(-len(whole) // 3072)};")
    rows = spark.createDataFrame([(1, "x" * 500, 7), (1, "x" * 500, 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, frames int")
    media = gif.to_media(rows.withColumn("p", gif.payload(F.col("text"))), "p")
    assert gif.frames(media).columns == ["doc_id", "text", "media", "frames"]
    one, two = (bytes(r.media) for r in media.where("doc_id = 1").collect())
    assert one == two
    assert gif.frames(media.limit(0)).count() == 0


def test_long_text_is_joined_in_linear_time(spark):
    text = "".join(random.Random(1).choice("abcdef gh") for _ in range(3_000_000))
    rows = spark.createDataFrame([(text,)], "text string").select(gif.payload(F.col("text")).alias("p"))
    back = gif.frames(gif.to_media(rows, "p")).select(gif.samples("frames").alias("b")).collect()[0].b
    assert bytes(back).rstrip(b" ") == text.encode().rstrip(b" ")
