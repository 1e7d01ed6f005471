"""The dealt operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planespark.llm import bpe, chat, common, gif, language_id, near_duplicates, packing, token_counts, topk, toxicity, warc
from planespark.llm.common import Workspace
from planespark.llm.chat_template import TemplateError, compile_template
from planespark.llm.queries import tokenizer

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
TEXTS = ["", None, " ", "It's  <|endoftext|> ok.", "<|ENDOFTEXT|>x, y", "été É, naïve!", "\x1c a\x1db", "日本語 😀😀", "x" * 9000, "ab1!é" * 3000, "a b c d e f g h", "a b c d e f g h", "tab\t\tnew\n\n line \n"]


def docs(spark, texts):
    return spark.createDataFrame([(k, x, "en", 1.5, k) for k, x in enumerate(texts)], "doc_id long, text string, lang string, score double, _key long")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_bpe(spark, name):
    path, lib = tokenizer(name), library(name)
    rows = bpe.decode(bpe.encode(docs(spark, TEXTS), path, "doc_id", piece_chars=500), path).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs(spark, TEXTS).limit(0), path, "doc_id").count() == 0


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_tree_concatenation(name):
    rng, c = random.Random(5), bpe.Codec(tokenizer(name))
    for alphabet in ("ab", "abcdefgh'!é1😀", "éxX<|>"):
        text = "".join(rng.choice(alphabet) for _ in range(4000))
        assert c.tree(text, 100) == c.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    lib = library(WORD)
    rows = packing.pack(docs(spark, [*TEXTS, "w " * 9000]).repartition(2), tokenizer(WORD)).collect()
    for k, x in enumerate([*TEXTS, "w " * 9000]):
        ids, at = [*lib.encode(x or "", add_special_tokens=False).ids, 2], 0
        for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sizes = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sizes.get(r.sequence_id, 0)
        sizes[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())


def test_fullest_against_all_subsets():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}
        taken = packing.fullest(counts, 50)
        totals = {max(counts)}
        for n, c in counts.items():
            for _ in range(c - (n == max(counts))):
                totals |= {t + n for t in totals}
        assert sum(n * c for n, c in taken.items()) == max(t for t in totals if t <= 50)
        assert all(c <= counts[n] for n, c in taken.items())


def similar(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("leaf", [200, 6])
def test_near_duplicates(spark, leaf):
    """Leaves of 6 send the groups down the tree and through the blocks."""
    rng = random.Random(2)
    texts = [None, "", "  ", "one two", "ONE two", "short text here"]
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        texts += [similar(rng, base, rng.randrange(0, 5)) for _ in range(3 + 5 * g)]
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(spark, docs(spark, texts), words=4, leaf=leaf).collect()}
    sets = []
    for x in texts:
        w = (x or "").lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), root(k), root(k) == k) for k in range(len(texts))}
    assert near_duplicates.near_duplicates(spark, docs(spark, texts).limit(0)).count() == 0


def test_near_duplicates_that_share_a_key(spark):
    """Different texts under one id: each has the links of its own text."""
    first, second = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(5, first), (5, second), (9, second + " end"), (7, first + " end"), (None, first), (8, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1))
    got = sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(spark, table).collect())))
    assert got == sorted(map(str, [(5, 5, True), (5, 5, True), (9, 5, False), (7, 5, False), (None, None, True), (8, 8, True)]))
    assert near_duplicates.meets(0.8, 3) > 0.999 and near_duplicates.meets(0.8, 0) > 0.9999


def test_near_duplicates_branch_once(spark, monkeypatch, tmp_path):
    """Each member of a large node branches once, and twice the group makes about twice the rows."""
    rng, branch = random.Random(23), near_duplicates._branch
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [similar(rng, base, 1) for _ in range(600)]
    rows = []
    for n in (300, 600):
        folder = tmp_path / str(n)
        folder.mkdir()

        def counted(batches, folder=str(folder), branch=branch):
            for batch in batches:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.writelines(f"{node} {i}\n" for node, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                yield from branch([batch])

        monkeypatch.setattr(near_duplicates, "_branch", counted)
        assert {r.component_id for r in near_duplicates.near_duplicates(spark, docs(spark, texts[:n]), words=4, leaf=40).collect()} == {0}
        seen = [x for f in folder.iterdir() for x in f.read_text().splitlines()]
        assert len(seen) == len(set(seen))
        rows.append(len(seen))
    assert 0 < rows[0] and rows[1] < 3 * rows[0]


def test_gif_round_trip_and_rules(spark):
    rows = docs(spark, TEXTS).select("doc_id", gif.payload(F.col("text")).alias("payload"))
    want = {r.doc_id: bytes(r.payload) for r in rows.collect()}
    shown = gif.frames(gif.to_media(rows, "payload")).collect()
    assert {r.doc_id: b"".join(bytes(f.pixels) for f in r.frames) for r in shown} == want
    assert all(sum(sum(f.histogram) for f in r.frames) == len(want[r.doc_id]) for r in shown)
    # Two frames of 2 x 1: red and blue, then one transparent pixel and a red one; the first is restored to nothing.
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x80, 0, 0, 255, 0, 0, 0, 0, 255])
    image = b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0, 2])

    def lzw(*codes):
        bits = sum(c << 3 * k for k, c in enumerate([4, *codes, 5]))
        data = bits.to_bytes((3 * (len(codes) + 2) + 7) // 8, "little")
        return bytes([len(data)]) + data + b"\0"

    data = head + b"\x21\xf9\x04\x08\x05\x00\x00\x00" + image + lzw(0, 1) + b"\x21\xf9\x04\x01\x0a\x00\x01\x00" + image + lzw(1, 0) + b"\x3b"
    one, two = gif.read_gif(data)
    assert one.canvas.tolist() == [[[255, 0, 0, 255], [0, 0, 255, 255]]] and (two.at_ms, two.delay_ms) == (50, 100)
    assert two.canvas.tolist() == [[[0, 0, 0, 0], [255, 0, 0, 255]]]


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 200), (2, None, "x" * 200), (3, "u\r\nv", "x"), (4, "u", "x"), (5, "u", None), (None, "u", "x" * 200), (1, "http://a/", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "record_type": F.lit(1)})
    folder, work = f"file://{tmp_path}/warc", Workspace(spark, "warc-test")
    manifest = work.save(warc.write(warc.classified(pages, work), folder), "manifest")
    assert sum(r.records for r in manifest.collect()) == len(rows)
    want = sorted([(1, 200, "response", None)] * 2 + [(2, 200, "revisit", 1), (3, 1, "response", None), (4, 1, "response", None), (5, 0, "response", None), (0, 200, "revisit", 1)], key=lambda x: x[0])
    shown = lambda df: sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in df.collect())
    assert shown(warc.read(manifest, folder)) == shown(warc.read(warc.archives(spark, folder))) == want
    # An archive that a lost attempt left is not read.
    (tmp_path / "warc" / "part-000000-99-00000.warc.gz").write_bytes((tmp_path / "warc" / manifest.first().file).read_bytes())
    assert shown(warc.read(manifest, folder)) == want
    none = work.save(warc.write(warc.classified(pages.limit(0), work), f"file://{tmp_path}/none"), "nothing")
    assert warc.read(none, folder).count() == 0
    (tmp_path / "empty").mkdir()
    assert warc.read(warc.archives(spark, f"file://{tmp_path}/empty")).count() == 0
    with pytest.raises(ValueError):
        list(warc.records([b"\x1f\x8b"]))


def test_join_hot(spark):
    """Heavy, light, unknown and null keys get what a plain left join gives."""
    rows = spark.createDataFrame([(k % 50 if k % 3 else 7, k) for k in range(3000)] + [(None, 1), (None, 2), (999, 3)], "g int, k int")
    table = rows.where("g < 60").groupBy("g").agg(F.count("*").alias("n"), F.max("k").alias("most"))
    want = sorted(map(tuple, rows.join(table, "g", "left").select("g", "k", "n", "most").collect()), key=str)
    common.HOT_KEYS, kept = 3, common.HOT_KEYS
    try:
        got = common.join_hot(rows, table, "g", "n", ["k"])
        assert got.columns == ["g", "k", "n", "most"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    finally:
        common.HOT_KEYS = kept


def brute_topk(rows, asked, k=10):
    """By Python's whole numbers; ``rows`` are (id, vector) pairs, and only a query's own row is left out."""
    out = []
    for n, (q, own) in enumerate(rows):
        if asked(q):
            product = [(v, max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, x, strict=False))))) for m, (v, x) in enumerate(rows) if m != n]
            out += [(q, r + 1, v, p) for r, (v, p) in enumerate(sorted(product, key=lambda t: (-t[1], t[0]))[:k])]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = [[float(v) for v in rng.normal(size=6)] for _ in range(300)]
    rows = [(k, v, 0) for k, v in enumerate(x)] + [(300, None, 0), (301, [float("nan")] * 6, 0), (302, [None] * 6, 0), (303, x[0], 0), (304, x[0], 0), (305, [], 0), (306, [1.0], 0), (None, x[1], 0), (304, x[0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"x": F.lit(1), "pivot": F.lit(2)})
    vectors = topk.quantised(table)
    got = topk.search(spark, vectors, "vec_id % 100 = 0").collect()
    kept = [(r[0], [math.floor(1024 * float(np.float32(v))) for v in r[1]]) for r in rows if r[0] is not None and r[0] not in (300, 301, 302)]
    assert sorted(map(tuple, got)) == brute_topk(kept, lambda q: q % 100 == 0)
    few = vectors.where("vec_id < 4")
    assert topk.search(spark, few, "vec_id = 0").count() == 3
    assert topk.search(spark, vectors.limit(0), "vec_id = 0").count() == 0
    assert topk.search(spark, vectors, "vec_id < 0").count() == 0


def test_topk_of_rows_that_share_an_id(spark, tmp_path):
    """Other vectors under one id are candidates of their own, as in the query's SQL."""
    import duckdb

    from planespark.llm import queries, sql

    rng = np.random.default_rng(8)
    rows = [(k // 3 + 1, rng.normal(size=4).round(2).tolist()) for k in range(90)] + [(0, [1.0, -1.0, 0.5, 2.0]), (5, [3.0, 1.0, 0.0, 0.0]), (5, [0.0, 9.0, 0.0, 0.0]), (5, [0.0, 9.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    columns = "query_id, rank, vec_id, score"
    assert sorted(map(tuple, queries.op5_topk(spark, str(tmp_path)).collect())) == sorted(con.sql(f"select {columns} from ({sql.TOPK})").fetchall())


def test_topk_of_large_components(spark):
    """Components whose products do not fit 53 or 64 bits."""
    rng = random.Random(3)
    rows = [(k, [rng.choice((1.0, -1.0)) * rng.random() * 10 ** rng.choice((0, 3, 6.5, 9, 15)) for _ in range(3)]) for k in range(60)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(spark, vectors, "vec_id % 10 = 0", k=5).collect()
    assert sorted(map(tuple, got)) == brute_topk([(k, [math.floor(1024 * v) for v in x]) for k, x in rows], lambda q: q % 10 == 0, 5)


def test_topk_rules_annuli_out(spark):
    """Vectors in tight clusters of several lengths: most annuli are never compared, and the result is that of brute force."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * rng.choice([1, 4], size=(20, 1))
    x = centres[rng.integers(0, 20, 800)] + rng.normal(size=(800, 8)) / 50
    vectors = topk.quantised(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    work = Workspace(spark, "pruned")
    got = topk.search(spark, vectors, "vec_id % 40 = 0", work=work, group=1)
    assert sorted(map(tuple, got.collect())) == brute_topk([(k, np.floor(1024 * v).astype(int).tolist()) for k, v in enumerate(x)], lambda q: q % 40 == 0)
    assert topk.ruled_out(work) > 0.5


def test_chat(spark):
    said = [(1, 0, "user", "</s>[INST]\\<s>"), (1, 1, "assistant", None), (1, 2, "assistant", "a\\</s>\n"), (2, 0, None, "x"), (1, 2, "assistant", "a\\</s>\n")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == digest("user\n</s>[INST]\\<s>\nassistant\n\nassistant\na\\</s>\n\nassistant\na\\</s>\n\n")
    assert got[1].loss_sha256 == digest("a\\</s>\n" * 2) and got[2].turns_sha256 == digest("\nx\n")
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_template_is_folded_and_closed():
    run = compile_template("a{{ 'b' ~ 1 }}{%- if 1 == 2 %}no{% elif messages %} yes{% endif %}{% for m in messages %}{{ loop.index }}{{ m.text | upper }}{{ m.text.__class__ }}{% endfor %}")
    assert [t for t, _ in run([{"text": "q"}])] == ["ab1", " yes", "1", "Q"]
    for bad in ("{{ a.b() }}", "{% import os %}", "{% for x in y %}", "{{ x | evil }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


def test_language(spark):
    rng = random.Random(4)
    words = {"aa": ["boro", "kiva", "sulo", "mipe"], "bb": ["trench", "stroff", "glimp", "brusk"]}
    rows = [(k, " ".join(rng.choice(words[g]) for _ in range(20)), g, "s") for k in range(120) for g in [("aa", "bb")[k % 2]]]
    rows += [(500, None, "aa", "s"), (501, "", None, "s"), (502, "12 34 !", "bb", "s"), (503, "漢字", None, "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(table)
    got = {r.doc_id: r for r in language_id.predict(table, model).collect()}
    assert all(got[k].lang_pred == g for k, _, g, _ in rows[:120])
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred in ("aa", "bb")
    nothing = language_id.train(table.limit(0))
    assert language_id.predict(table, nothing).where("lang_pred = 'und'").count() == len(rows)


def test_toxicity_counterfactual(spark):
    """Mentions of a group that the labels happen to go with score less when swaps are paid for."""
    rng = random.Random(6)
    filler = ["table", "garden", "window", "river", "paper", "music"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 2
        text = [rng.choice(filler) for _ in range(12)] + (["scumbag"] if toxic and rng.random() < 0.8 else []) + (["muslim"] if rng.random() < (0.6 if toxic else 0.1) else [])
        rows.append((k, " ".join(text)))
        labels.append((k, toxic))
    docs_, labels_ = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    ask = spark.createDataFrame([(0, "my muslim garden"), (1, "my garden scumbag"), (2, None), (3, "")], "doc_id long, text string")
    scored = [{r.doc_id: r.score for r in toxicity.score(ask, toxicity.train(docs_, labels_, counterfactual=c)).collect()} for c in (0.0, 50.0)]
    assert scored[1][0] < scored[0][0] and scored[1][1] > 0.7 and scored[1][2] == scored[1][3]
    empty = toxicity.train(docs_, labels_.limit(0))
    assert toxicity.score(ask, empty).where("score > 0.5").count() == 0
