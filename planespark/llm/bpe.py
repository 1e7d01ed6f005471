"""BPE encoding and decoding over Spark partitions, equal to the tokenizers library.

Two ideas carry the work.

* *Units.* No merge crosses the place where white space starts, so a text is
  cut there and equal units are encoded once per worker. The unit table is an
  Arrow string array plus flat id arrays; it is bounded and refilled.
* *Tree concatenation.* Long text is cut in halves until the pieces are short,
  every piece is encoded whole in a task of its own, and the halves are joined
  again up the tree: a window around the join is encoded anew and grows until
  it shares a token, at the same characters, with the left half and one with the
  right half. All neighbours in the joined sequence then stood next to each
  other in some true encoding, which makes the sequence the encoding of the
  whole. A half carries the text and tokens of its ends up to a place that no
  merge crosses; only a run without such a place is carried whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planespark.llm.common import list_array, slices, text_bytes

#: ASCII white space; both vocabularies split before it.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True
#: Last bytes of the two-byte letters U+00C0 to U+00FF, which start with LATIN_LEAD.
LATIN_LEAD = 0xC3
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
#: Marks that always start a new pre-token after a letter; not ' (contractions) nor | (special strings).
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{}~']] = True
#: White space beyond ASCII: texts with it are not cut where white space is kept.
WIDE_SPACE = "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: A unit of plain letters, with at most one space or line feed before it.
PLAIN = "^[ \\n]?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Plain units that the lean tokenizer gets in one text.
PLAIN_ROWS = 500
#: Units longer than this are not remembered.
UNIT_MEMORY_BYTES = 64
#: Units remembered by one worker before it starts again.
UNIT_MEMORY_ROWS = 1_000_000
#: Unsplit runs of more characters than this inside one piece are encoded by tree concatenation.
LEAF_CHARS = 4096
#: Documents of more characters than this are dealt out as pieces.
PIECE_CHARS = 16384
#: The end of a half that a join may look at has at least so many characters, and goes on to the next place that no merge crosses.
END_CHARS = 256
#: First half width of the window around a join.
WINDOW_CHARS = 32


def _byte_letters() -> dict[int, str]:
    """Byte-level letter of each byte: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    table |= {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in table)}
    return table


BYTE_LETTERS = _byte_letters()
LETTER_BYTES = {c: b for b, c in BYTE_LETTERS.items()}


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part


class Codec:
    """One vocabulary file with its unit table. Kept per worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.lean = Tokenizer(self.tokenizer.model)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        self.words = '"Lowercase"' in parts and '"Split"' in parts and '"ByteLevel"' in parts
        self.bytewise = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space")
        self.joined_by_space = spec["decoder"] is None
        if not (self.words or self.bytewise):
            raise ValueError(f"no unit rule for the pre-tokenizer of {path}")
        bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if self.words:
            self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_only])
        else:
            self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.Split(" ", "merged_with_next"), bytes_only])
        names = [self.lean.id_to_token(i) or "" for i in range(self.lean.get_vocab_size())]
        #: Tokens that end a unit (word ends), or start one (a space or line feed before).
        self.bound = np.array([x.endswith("</w>") if self.words else x[:1] in (BYTE_LETTERS[32], BYTE_LETTERS[10]) for x in names])
        self._forget()

    def _forget(self) -> None:
        self.units = pa.array([], pa.string())
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1, np.int64)

    # units

    def _cuts(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, offsets of the rows and offsets of the units."""
        raw, offsets = text_bytes(column)
        n = len(raw)
        cut = np.zeros(n + 1, bool)
        if n:
            space = SPACE[raw]
            cut[1:-1] = space[1:] & ~space[:-1]
            letter = LETTER[raw[:-1]]
            letter[1:] |= LATIN[raw[1:-1]] & (raw[:-2] == LATIN_LEAD)
            cut[1:-1] |= MARK[raw[1:]] & letter
            if self.bytewise:
                wide = np.flatnonzero(pc.match_substring_regex(pc.fill_null(column, ""), WIDE_SPACE).to_numpy(zero_copy_only=False))
                for k in wide:
                    cut[offsets[k] : offsets[k + 1]] = False
        cut[offsets] = True
        return raw, offsets, np.flatnonzero(cut)

    def _plain(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of units that match PLAIN: each is one pre-token, a line feed before it another."""
        if self.words:
            texts = pc.utf8_lower(pc.ascii_trim_whitespace(units))
        else:
            bare = ~pc.match_substring_regex(units, "^[ \\n]").to_numpy(zero_copy_only=False)
            texts = pc.if_else(pa.array(bare), pc.binary_join_element_wise("\n", units, ""), units)
        between = " " if self.words else ""
        rows = texts.to_pylist()
        blocks = self.lean.encode_batch_fast([between.join(rows[k : k + PLAIN_ROWS]) for k in range(0, len(rows), PLAIN_ROWS)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.int32) for x in blocks]) if blocks else np.zeros(0, np.int32)
        marks = np.flatnonzero(self.bound[ids])
        ends = np.concatenate([[0], marks + 1]) if self.words else np.append(marks, len(ids))
        if len(ends) != len(rows) + 1:
            raise ValueError("units and their tokens do not line up")
        if not self.words and bare.any():  # drop the line feed that was put before
            keep = np.ones(len(ids), bool)
            keep[ends[:-1][bare]] = False
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            ids = ids[keep]
        return ids, ends

    def _encode_other(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        short = [k for k, x in enumerate(units) if len(x) <= LEAF_CHARS]
        found: dict[int, list[int]] = {k: x.ids for k, x in zip(short, self.tokenizer.encode_batch_fast([units[k] for k in short], add_special_tokens=False), strict=True)}
        found |= {k: self.tree(x) for k, x in enumerate(units) if k not in found}
        ids = [i for k in range(len(units)) for i in found[k]]
        return np.array(ids, np.int32), np.concatenate([[0], np.cumsum([len(found[k]) for k in range(len(units))])]).astype(np.int64)

    def _append(self, ids: np.ndarray, ends: np.ndarray) -> None:
        first = int(self.starts[-1])
        total = first + len(ids)
        if total > len(self.ids):
            grown = np.zeros(max(total, 2 * len(self.ids)), np.int32)
            grown[:first] = self.ids[:first]
            self.ids = grown
        self.ids[first:total] = ids
        self.starts = np.concatenate([self.starts, first + ends[1:]])

    def _codes(self, units: pa.Array) -> np.ndarray:
        """Row of each unit in the tables; units that are not known yet are encoded first."""
        if len(self.units) > UNIT_MEMORY_ROWS:
            self._forget()
        codes = pc.index_in(units, value_set=self.units)
        missing = np.flatnonzero(pc.is_null(codes).to_numpy(zero_copy_only=False))
        codes = pc.fill_null(codes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            left = units.take(pa.array(missing))
            fresh = left.unique()
            plain = pc.match_substring_regex(fresh, PLAIN)
            small = pc.less_equal(pc.binary_length(fresh), UNIT_MEMORY_BYTES)
            known = len(self.units)
            keep = [fresh.filter(pc.and_(plain, small)), fresh.filter(pc.and_(pc.invert(plain), small))]
            extra = fresh.filter(pc.invert(small))
            self._append(*self._plain(keep[0]))
            self._append(*self._encode_other(keep[1].to_pylist()))
            self.units = pa.concat_arrays([self.units, *keep])
            self._append(*self._encode_other(extra.to_pylist()))
            codes[missing] = known + pc.index_in(left, value_set=pa.concat_arrays([*keep, extra])).to_numpy(zero_copy_only=False)
        return codes

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a string column and the offsets of its rows in them."""
        raw, offsets, cuts = self._cuts(column)
        units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
        codes = self._codes(units)
        size = (self.starts[1:] - self.starts[:-1])[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.starts[codes] - ends[:-1], size) + np.arange(ends[-1])
        ids = self.ids[place]
        self.starts = self.starts[: len(self.units) + 1]  # long units are not remembered
        return ids, ends[np.searchsorted(cuts, offsets)]

    def count_column(self, column) -> np.ndarray:
        """Number of ids of each row of a string column."""
        raw, offsets, cuts = self._cuts(column)
        units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
        codes = self._codes(units)
        ends = np.concatenate([[0], np.cumsum((self.starts[1:] - self.starts[:-1])[codes])])
        self.starts = self.starts[: len(self.units) + 1]
        return np.diff(ends[np.searchsorted(cuts, offsets)])

    # tree concatenation

    def ends(self, text: str) -> tuple[int, int | None]:
        """Where the head of a piece ends and its tail begins: at places that no merge crosses; (length, None) where it has no two of them."""
        raw, _, cuts = self._cuts(pa.array([text], pa.string()))
        chars = np.cumsum((raw & 0xC0) != 0x80)  # characters up to and with each byte
        inner = chars[cuts[1:-1] - 1] if len(cuts) > 2 else np.zeros(0, np.int64)
        first, last = inner[inner >= END_CHARS], inner[inner <= len(text) - END_CHARS]
        if not len(first) or not len(last) or first[0] > last[-1]:
            return len(text), None
        return int(first[0]), int(last[-1])

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(first character, one past the last, id) of each token; a long text by the tree."""
        if len(text) <= LEAF_CHARS:
            return self._spans(text)
        return self.tree_spans(text)

    def _spans(self, text: str, at: int = 0) -> list[tuple[int, int, int]]:
        """(first character, one past the last, id) of each token."""
        x = self.tokenizer.encode(text, add_special_tokens=False)
        return [(a + at, b + at, i) for (a, b), i in zip(x.offsets, x.ids, strict=True)]

    def _join(self, text: str, left: list, cut: int, right: list, first: int, last: int) -> list:
        """Tokens of text[first:last] from those of text[first:cut] and text[cut:last]."""
        half = WINDOW_CHARS
        while True:
            a, b = max(first, cut - half), min(last, cut + half)
            if a == first and b == last:
                return self._spans(text[a:b], a)
            window = self._spans(text[a:b], a)
            lone = _lone(window)
            head = tail = None
            if a == first:
                head = (0, 0)
            else:
                seen = {x: k for k, x in enumerate(left) if k in _Lone(left) and a < x[0] and x[1] < cut}
                for k in range(len(window)):
                    if lone[k] and window[k] in seen:
                        head = (seen[window[k]], k)
                        break
            if b == last:
                tail = (len(right), len(window))
            else:
                seen = {x: k for k, x in enumerate(right) if k in _Lone(right) and cut < x[0] and x[1] < b}
                for k in range(len(window) - 1, -1, -1):
                    if lone[k] and window[k] in seen:
                        tail = (seen[window[k]], k)
                        break
            if head and tail and head[1] <= tail[1]:
                return left[: head[0]] + window[head[1] : tail[1]] + right[tail[0] :]
            half *= 2

    def tree(self, text: str, leaf: int = LEAF_CHARS) -> list[int]:
        """Ids of an unsplit text: pieces encoded one by one, then joined pairwise up the tree."""
        return [i for _, _, i in self.tree_spans(text, leaf)]

    def tree_spans(self, text: str, leaf: int = LEAF_CHARS) -> list[tuple[int, int, int]]:
        cuts = cut_points(len(text), leaf)
        return self.join_all(text, [(a, b, self._spans(text[a:b], a)) for a, b in zip(cuts, cuts[1:], strict=False)])

    def join_all(self, text: str, level: list[tuple[int, int, list]]) -> list:
        """Join neighbouring (first, last, tokens) halves until one is left."""
        while len(level) > 1:
            up = []
            for k in range(0, len(level) - 1, 2):
                (a, m, left), (_, b, right) = level[k], level[k + 1]
                up.append((a, b, self._join(text, left, m, right, a, b)))
            level = up + level[len(level) - len(level) % 2 :]
        return level[0][2] if level else []

    # decoding

    def token_texts(self) -> pa.Array:
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        if self.joined_by_space:
            return pa.array([x.encode() for x in names], pa.binary())
        return pa.array([bytes(LETTER_BYTES[c] for c in x) if all(c in LETTER_BYTES for c in x) else x.encode() for x in names], pa.binary())

    def decode_column(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        if not hasattr(self, "texts"):
            self.texts = self.token_texts()
        tokens = self.texts.take(pa.array(ids))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), b" " if self.joined_by_space else b"")
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


def _lone(tokens: list) -> list[bool]:
    """Whether each token shares its characters with no neighbour (pieces of one character do)."""
    last = len(tokens) - 1
    return [a < b and (k == 0 or tokens[k - 1][1] <= a) and (k == last or b <= tokens[k + 1][0]) for k, (a, b, _) in enumerate(tokens)]


class _Lone:
    """Positions of a token list that share their characters with no neighbour, looked up one at a time."""

    def __init__(self, tokens: list):
        self.tokens = tokens

    def __contains__(self, k: int) -> bool:
        t = self.tokens
        a, b, _ = t[k]
        return a < b and (k == 0 or t[k - 1][1] <= a) and (k == len(t) - 1 or b <= t[k + 1][0])


def cut_points(n: int, leaf: int) -> list[int]:
    """Ends of the leaves that halving n characters gives, until none has more than ``leaf``."""
    parts = 1
    while n > leaf * parts:
        parts *= 2
    return sorted({n * k // parts for k in range(parts + 1)})


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this worker process for a vocabulary file (a path that every executor has)."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _extended(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType([*(x for x in schema if x.name not in columns), *(T.StructField(k, v) for k, v in columns.items())])


def _with(batch: pa.RecordBatch, rows: tuple[int, int], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    part = batch.slice(rows[0], rows[1] - rows[0])
    names = [x for x in batch.schema.names if x not in columns]
    return pa.RecordBatch.from_arrays([*(part.column(batch.schema.names.index(x)) for x in names), *columns.values()], names=[*names, *columns])


def encode(df: DataFrame, path: str, key: str, text: str = "text", out: str = "ids", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Ids of every text: columns ``key`` and ``out`` (array<int>); other columns do not pass.

    ``key`` should be unique; rows that share a key are kept apart as long as
    their texts differ in some way, and equal rows give equal rows. Null text
    counts as empty and has no ids. Texts of more than ``piece_chars``
    characters are cut in halves until no piece is longer, the pieces are dealt
    to all tasks and encoded there, and the tree of joins restores the ids of
    the whole text.
    """
    texts = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = T.StructType([T.StructField("_key", texts.schema["_key"].dataType), T.StructField("_ids", T.ArrayType(T.IntegerType()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                ids, offsets = c.encode_column(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), list_array(ids, offsets)], names=["_key", "_ids"])

    long = F.length("_text") > piece_chars
    short = texts.where(~long).mapInArrow(whole, kind)
    joined = _encode_long(texts.where(long), path, kind, piece_chars)
    return short.unionByName(joined).select(F.col("_key").alias(key), F.col("_ids").alias(out))


class Half:
    """Tokens of a stretch of a long text: ids, and the text and tokens of both ends.

    ``head`` and ``tail`` are (text, tokens); a stretch without a place that no
    merge crosses is all head, and has no body and no tail.
    """

    def __init__(self, head: tuple[str, list], body: np.ndarray, tail: tuple[str, list] | None):
        self.head, self.body, self.tail = head, body, tail

    def ids(self) -> np.ndarray:
        last = self.tail[1] if self.tail else []
        return np.concatenate([np.array([x[2] for x in self.head[1]], np.int32), self.body, np.array([x[2] for x in last], np.int32)])


def _moved(tokens: list, by: int) -> list:
    return [(a + by, b + by, i) for a, b, i in tokens]


def join_halves(c: Codec, left: Half, right: Half) -> Half:
    """The stretch that two neighbouring ones make: the window around their join grows inside the ends that meet."""
    a, b = left.tail or left.head, right.head
    text, cut = a[0] + b[0], len(a[0])
    tokens = c._join(text, a[1], cut, _moved(b[1], cut), 0, len(text))
    ids = np.array([x[2] for x in tokens], np.int32)
    if left.tail and right.tail:
        return Half(left.head, np.concatenate([left.body, ids, right.body]), right.tail)
    if left.tail:
        return Half(left.head, left.body, (text, tokens))
    return Half((text, tokens), right.body, right.tail)


def _encode_long(texts: DataFrame, path: str, kind: T.StructType, piece_chars: int) -> DataFrame:
    """Pieces as rows, each encoded whole where it lies, then the joins up the tree of each document."""
    key = kind["_key"].dataType
    pieces_of = T.StructType([T.StructField("_key", key), T.StructField("_copy", T.LongType()), T.StructField("_at", T.IntegerType()), T.StructField("_piece", T.StringType())])
    spans = T.ArrayType(T.IntegerType())
    ends_of = [T.StructField(x, t) for x, t in (("_head", T.StringType()), ("_head_spans", spans), ("_body", spans), ("_tail", T.StringType()), ("_tail_spans", spans))]
    nodes_of = T.StructType([*list(pieces_of)[:3], *ends_of])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                ends = cut_points(len(text), piece_chars)
                parts = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * n, batch.schema.field(0).type), pa.array([batch.column(2)[k].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], names=pieces_of.names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            pieces = batch.column(3)
            for a, b in slices(pieces):
                part = pieces.slice(a, b - a)
                ids, offsets = c.encode_column(part)
                heads, bodies, tails = [], [], []
                for k, x in enumerate(part.to_pylist()):
                    own = ids[offsets[k] : offsets[k + 1]]
                    first, last = c.ends(x)
                    head = c.spans(x[:first])
                    tail = None if last is None else c.spans(x[last:])
                    heads.append((x[:first], np.array(head, np.int32).ravel()))
                    bodies.append(own[len(head) : len(own) - len(tail)] if tail is not None else own[:0])
                    tails.append((None, None) if tail is None else (x[last:], np.array(tail, np.int32).ravel()))
                columns = [pa.array([x[0] for x in heads], pa.string()), pa.array([x[1] for x in heads], pa.list_(pa.int32())), pa.array(bodies, pa.list_(pa.int32())), pa.array([x[0] for x in tails], pa.string()), pa.array([x[1] for x in tails], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), *columns], names=nodes_of.names)

    def joined(table: pa.Table) -> pa.Table:
        c = codec(path)
        table = table.sort_by("_at").combine_chunks()
        triples = lambda name, row: list(map(tuple, table[name][row].values.to_numpy(zero_copy_only=False).reshape(-1, 3).tolist()))
        level = []
        for row in range(table.num_rows):
            tail = table["_tail"][row].as_py()
            level.append(Half((table["_head"][row].as_py(), triples("_head_spans", row)), table["_body"][row].values.to_numpy(zero_copy_only=False).astype(np.int32), None if tail is None else (tail, triples("_tail_spans", row))))
        while len(level) > 1:
            level = [join_halves(c, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        ids = level[0].ids()
        return pa.table({"_key": table["_key"].slice(0, 1), "_ids": list_array(ids, np.array([0, len(ids)]))})

    # A number for each row keeps apart texts under one key.
    marked = texts.withColumn("_copy", F.monotonically_increasing_id())
    nodes = marked.mapInArrow(cut, pieces_of).repartition("_copy", "_at").mapInArrow(leaves, nodes_of)
    return nodes.groupBy("_copy").applyInArrow(joined, kind)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Text of every id list, special tokens kept, as the library's decode gives it; null ids give an empty text."""
    if out in df.columns:
        df = df.drop(out)
    kind = _extended(df.schema, **{out: T.StringType()})
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = pc.fill_null(batch.column(at), []) if batch.column(at).null_count else batch.column(at)
            for a in range(0, max(batch.num_rows, 1), 1000):
                part = column.slice(a, 1000)
                sizes = np.diff(np.asarray(part.offsets))
                texts = c.decode_column(part.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
                yield _with(batch, (a, min(a + 1000, batch.num_rows)), {out: texts})

    return df.mapInArrow(run, kind)
