"""GIF media columns: texts stored as 8-bit samples in animated GIFs, and GIFs decoded to timed frames with colour histograms."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planespark.llm.common import slices

#: Samples of a row, and rows of a frame, of stored payloads. A frame has fewer samples than the code table has room.
WIDTH = 192
FRAME_ROWS = 16
#: Frames that are compressed side by side, and strings that each of them can look up.
LANES = 1024
SLOT_BITS = 12
DELAY_MS = 40
#: Bins of a frame's histogram, by brightness.
BINS = 8

_CLEAR, _END = 256, 257
#: Codes of a full table, and codes that the reader looks at before it looks further for the end of a run.
TABLE = 1 << 12
LOOK = 1 << 13


@functools.cache
def _growing_widths(code_size: int) -> np.ndarray:
    return np.array([code_size + 1] + [min(12, ((1 << code_size) + 1 + k).bit_length()) for k in range(1, TABLE)], np.int64)


def code_widths(code_size: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: they grow with the table and stay at 12 once it is full."""
    return np.concatenate([_growing_widths(code_size), np.full(max(n - TABLE, 0), 12, np.int64)])[:n]


@functools.cache
def _first_look(code_size: int) -> tuple[np.ndarray, np.ndarray]:
    widths = code_widths(code_size, LOOK)
    return widths, np.cumsum(widths)


_WIDTHS = code_widths(8, TABLE)


# Writing


def lzw_codes(images: list[np.ndarray]) -> list[np.ndarray]:
    """Codes of each image (1 to WIDTH * FRAME_ROWS samples), clear and end code left out.

    The images advance together, one sample a step. Strings are looked up in a
    table where a later string takes the place of an earlier one that falls on
    the same slot: the stream stays right and is a little longer.
    """
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(images)
    order = sorted(range(len(images)), key=lambda k: -len(images[k]))
    for lo in range(0, len(order), LANES):
        lanes = order[lo : lo + LANES]
        sizes = np.array([len(images[k]) for k in lanes])
        steps, n = int(sizes[0]), len(lanes)
        data = np.zeros((n, steps), np.uint8)
        for row, k in enumerate(lanes):
            data[row, : sizes[row]] = images[k]
        data = np.ascontiguousarray(data.T)
        active = np.searchsorted(-sizes, -np.arange(steps), "left")
        base = np.arange(n, dtype=np.int64) << SLOT_BITS
        keys = np.full(n << SLOT_BITS, -1, np.int32)
        values = np.zeros(n << SLOT_BITS, np.int32)
        run, count = data[0].astype(np.int32), np.zeros(n, np.int32)
        out = np.full((steps, n), -1, np.int16)
        for t in range(1, steps):
            m = active[t]
            c, r = data[t, :m], run[:m]
            key = r << 8 | c
            slot = (key.view(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOT_BITS)) + base[:m]
            hit = keys[slot] == key
            new = np.flatnonzero(~hit)
            out[t - 1, new] = r[new]
            run[:m] = np.where(hit, values[slot], c)
            slot = slot[new]
            keys[slot] = key[new]
            values[slot] = count[new] + (_END + 1)
            count[new] += 1
        out[sizes - 1, np.arange(n)] = run
        out = np.ascontiguousarray(out.T)
        for row, k in enumerate(lanes):
            found[k] = out[row][out[row] >= 0].astype(np.int64)
    return found


def pack_codes(codes: np.ndarray) -> bytes:
    """Clear code, codes and end code as a stream of bits, least significant first, with the widths that the table's growth gives."""
    value = np.concatenate([[_CLEAR], codes, [_END]])
    width = np.concatenate([[9], _WIDTHS[: len(codes) + 1]])
    end = np.cumsum(width)
    at = end - width
    value = value << (at & 7)
    first = at >> 3
    out = np.zeros(int(end[-1] + 7) // 8 + 3)
    for k in range(3):
        out += np.bincount(first + k, value >> 8 * k & 255, len(out))
    return out.astype(np.uint8)[: int(end[-1] + 7) // 8].tobytes()


def _blocks(data: bytes) -> bytes:
    out = bytearray()
    for k in range(0, len(data), 255):
        part = data[k : k + 255]
        out.append(len(part))
        out += part
    out.append(0)
    return bytes(out)


def write_gifs(payloads: list[bytes], delay_ms: int = DELAY_MS) -> list[bytes]:
    """An animated GIF for each payload: frames of FRAME_ROWS rows of WIDTH samples, grey palette."""
    size = WIDTH * FRAME_ROWS
    images, owner = [], []
    for k, x in enumerate(payloads):
        if len(x) % WIDTH or not x:
            raise ValueError(f"samples must fill rows of {WIDTH}")
        raw = np.frombuffer(x, np.uint8)
        images += [raw[a : a + size] for a in range(0, len(raw), size)]
        owner += [k] * -(-len(raw) // size)
    files = []
    for x in payloads:
        rows = min(len(x) // WIDTH, FRAME_ROWS)
        files.append([b"GIF89a" + WIDTH.to_bytes(2, "little") + rows.to_bytes(2, "little") + b"\xf7\x00\x00" + np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()])
    for k, image, codes in zip(owner, images, lzw_codes(images), strict=True):
        head = b"\x21\xf9\x04\x04" + (delay_ms // 10).to_bytes(2, "little") + b"\x00\x00\x2c\x00\x00\x00\x00"
        files[k].append(head + WIDTH.to_bytes(2, "little") + (len(image) // WIDTH).to_bytes(2, "little") + b"\x00\x08" + _blocks(pack_codes(codes)))
    return [b"".join(x) + b"\x3b" for x in files]


# Reading


def unpack_lzw(data: bytes, code_size: int, most: int) -> bytes:
    """The first ``most`` samples of an LZW code stream, worked through one run between clear codes at a time.

    A run may be of any length: once the table is full it stays as it is. A
    stream with fewer samples, or with a code that is not in the table, raises.
    """
    if not 1 <= code_size <= 8:
        raise ValueError(f"code size {code_size}")
    clear, end = 1 << code_size, (1 << code_size) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    bits, at = 8 * len(data), 0
    out: list[bytes] = []
    size = 0
    while at < bits and size < most:
        look = LOOK
        while True:
            if look == LOOK:
                widths, ends = _first_look(code_size)
            else:
                widths = code_widths(code_size, look)
                ends = np.cumsum(widths)
            n = int(np.searchsorted(ends, bits - at, "right"))
            place = at + ends[:n] - widths[:n]
            first = place >> 3
            codes = (raw[first] | raw[first + 1] << 8 | raw[first + 2] << 16) >> (place & 7) & (1 << widths[:n]) - 1
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or n < look:
                break
            look *= 4
        last = int(stops[0]) if len(stops) else n
        for part in _expand(codes[:last], clear):
            out.append(part)
            size += len(part)
            if size >= most:
                break
        if last == n or codes[last] == end:
            break
        at += int(ends[last])
    if size < most:
        raise ValueError(f"{size} samples in the stream, {most} in the image")
    return b"".join(out)[:most]


def _expand(codes: np.ndarray, clear: int) -> Iterator[bytes]:
    """Samples of the codes of one run, in parts.

    The entry that the k-th code makes is its string and the next sample, so
    its samples stand in the output from where that code starts: each sample
    points back to an earlier one, and following the pointers in doubling steps
    ends at a literal. Codes that come once the table is full are copies of
    strings that stand in that first part.
    """
    entries = TABLE - (clear + 2)
    made = codes - (clear + 2)
    literal = codes < clear
    if (~literal & (made >= np.minimum(np.arange(len(codes)), entries))).any():
        raise ValueError("code beyond the table")
    n = min(len(codes), entries + 1)
    if not n:
        return
    own, up, lit = np.arange(n), np.where(literal[:n], np.arange(n), made[:n]), literal[:n]
    step = np.where(lit, 0, 1)
    while True:
        higher = up[up]
        if (higher == up).all():
            break
        step = step + step[up]
        up = higher
    length = step + 1
    begin = np.cumsum(length) - length
    back = np.where(lit, 0, begin - begin[np.where(lit, own, made[:n])])
    source = np.arange(int(length.sum())) - np.repeat(back, length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.zeros(len(source), np.uint8)
    value[begin[lit]] = codes[:n][lit]
    value = value[source]
    yield value.tobytes()
    strings = np.concatenate([value, np.arange(clear, dtype=np.uint8)])
    for k in range(n, len(codes), 512):
        part, alone = made[k : k + 512], literal[k : k + 512]
        entry = np.where(alone, 0, part)
        size = np.where(alone, 1, length[entry] + 1)
        first = np.where(alone, len(value) + codes[k : k + 512], begin[entry])
        yield strings[np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))].tobytes()


@dataclass
class Frame:
    """One shown picture: the whole canvas as RGBA after the frame was drawn, and when."""

    at_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]
    indices: np.ndarray
    canvas: np.ndarray


def read_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, with palettes, transparency and the disposal of earlier frames applied."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    word = lambda at: int.from_bytes(data[at : at + 2], "little")
    width, height, flags = word(6), word(8), data[10]
    at, palette = 13, None
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        palette = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3)
        at += size
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, clear_index, delay, clock = 0, None, 0, 0
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body, at = _sub_blocks(data, at)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                clear_index = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, flags = word(at), word(at + 2), word(at + 4), word(at + 6), data[at + 8]
        at += 9
        colours = palette
        if flags & 0x80:
            size = 3 << (flags & 7) + 1
            colours = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3)
            at += size
        code_size = data[at]
        body, at = _sub_blocks(data, at + 1)
        index = np.frombuffer(unpack_lzw(body, code_size, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:  # interlaced: rows 0, 8, ..; 4, 12, ..; 2, 6, ..; 1, 3, ..
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = index[: area.shape[0], : area.shape[1]]
        drawn = np.full((*seen.shape, 4), 255, np.uint8)
        if colours is not None:
            drawn[..., :3] = colours[np.minimum(seen, len(colours) - 1)]
        if clear_index is None:
            area[...] = drawn
        else:
            shown = seen != clear_index
            area[shown] = drawn[shown]
        yield Frame(clock, delay, (left, top, w, h), index, canvas.copy())
        clock += delay
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        disposal, clear_index, delay = 0, None, 0


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


# Columns


def payload(text: F.Column) -> F.Column:
    """UTF-8 bytes of a text (null: none) with spaces up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    missing = F.greatest(F.lit(WIDTH) - size, F.pmod(-size, F.lit(WIDTH)))
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), missing), "UTF-8"))


def to_media(df: DataFrame, column: str, out: str = "media") -> DataFrame:
    """``df`` with the binary ``column`` (rows of WIDTH samples; null gives null) replaced by its GIF in ``out``."""
    names = [x for x in df.columns if x not in (column, out)]
    kind = df.select(*names).schema.add(out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(a, b - a)
                held = part.column(part.num_columns - 1).to_pylist()
                media = iter(write_gifs([x for x in held if x is not None]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([None if x is None else next(media) for x in held], pa.binary())], names=[*names, out])

    return df.select(*names, column).mapInArrow(run, kind)


FRAME = T.StructType([*(T.StructField(k, T.IntegerType()) for k in ("at_ms", "delay_ms", "width", "height", "channels")), T.StructField("pixels", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.LongType()))])


def frames(df: DataFrame, media: str = "media", out: str = "frames") -> DataFrame:
    """``df`` with the timed frames of the GIFs in ``media``: size, pixels and colour histogram of each (null gives null).

    Pixels are those of the frame's box on the canvas: one byte each where
    all are opaque greys, else red, green, blue and alpha. The histogram has
    the pixels in each of BINS bands of brightness. A broken file, and one
    whose code stream is too short for its image, raises.
    """
    rows = df.drop(out)
    kind = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(FRAME))])
    at = rows.columns.index(media)
    names = [*rows.columns, out]
    inner = pa.list_(pa.struct([("at_ms", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [None if x is None else [_row(f) for f in read_gif(x)] for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, inner)], names=names)

    return rows.mapInArrow(run, kind)


def samples(frames_column: str) -> F.Column:
    """The pixels of all frames after one another, joined in time that grows with their size."""
    return F.unhex(F.array_join(F.transform(frames_column, lambda f: F.hex(f["pixels"])), ""))


def _row(frame: Frame) -> dict:
    left, top, w, h = frame.box
    area = frame.canvas[top : top + h, left : left + w]
    grey = bool((area[..., 3] == 255).all() and (area[..., 0] == area[..., 1]).all() and (area[..., 1] == area[..., 2]).all())
    light = area[..., 0] if grey else (area[..., :3].astype(np.uint16).sum(axis=2) // 3).astype(np.uint8)
    pixels = area[..., 0].tobytes() if grey else area.tobytes()
    return {"at_ms": frame.at_ms, "delay_ms": frame.delay_ms, "width": area.shape[1], "height": area.shape[0], "channels": 1 if grey else 4, "pixels": pixels, "histogram": np.bincount((light >> 5).ravel(), minlength=BINS).tolist()}
