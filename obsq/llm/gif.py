"""GIF images as media columns: LZW code streams, palettes, disposal and transparency, timed frames (operator 10).

encode() keeps bytes as the palette indices of frames of a timed image, without loss, in code streams that refer to
their table and clear it when it is full. decode() reads any GIF: sub-blocks, code streams of all widths with deferred
clears, interlacing, local and global palettes, transparency, and the three ways to dispose of a frame; it gives the
samples of each frame, its time, and the canvas as shown. As a table grows by one entry with each code, the widths of
the codes up to the next clear are known beforehand, so all are cut out of the stream at once.

store() writes texts as images to the shared folder, and frames() and media() read images from any binary column: a row
for each frame, or for each image, with times and the colour histograms of the canvases.

Defined cases: null text counts as empty; an empty payload is filled to one row; equal texts give equal bytes and
features; texts of any length are stored whole, in as many frames as they take; an empty table gives no rows; other
columns are ignored; an image that is null has no frames. Damaged files raise an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from obsq.llm.common import cut, fit_columns, ship

WIDTH, ROWS, DELAY = 192, 64, 4
CLEAR, END = 256, 257
MOST = 4096
#: Colours spread over the cube, by a rule.
COLOURS = bytes(v for i in range(256) for v in (i, 3 * i & 255, 7 * i & 255))
#: What stands before a payload's digest in a comment.
DIGEST = b"sha256 "


@lru_cache(maxsize=None)
def _places(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of each code after a clear and its bit offset from there, up to the one that fills the table."""
    first = (1 << depth) + 2
    size = first + np.maximum(np.arange(MOST - first + 1) - 1, 0)
    width = np.minimum(np.maximum(depth + 1, np.floor(np.log2(size)).astype(np.int64) + 1), 12)
    return width, np.cumsum(width) - width


def _codes(samples: bytes) -> bytes:
    """The code stream of bytes, with minimum code size 8."""
    out, since = [CLEAR], [0]
    table: dict[int, int] = {}
    size, now, get = END + 1, samples[0], table.get
    for s in samples[1:]:
        key = now << 8 | s
        to = get(key)
        if to is not None:
            now = to
            continue
        out.append(now)
        if size < MOST:
            table[key] = size
            size += 1
        else:
            out.append(CLEAR)
            since.append(len(out) - 1)
            table.clear()
            size = END + 1
        now = s
    out += (now, END)
    code = np.array(out, np.int64)
    start = np.array(since)
    k = np.arange(len(code))
    after = k - start[np.searchsorted(start, k, "right") - 1] - 1  # codes since the last clear; a clear belongs to those before
    after[start[1:]] = start[1:] - start[:-1] - 1
    widths = _places(8)[0]
    width = np.where(after < 0, 9, widths[np.minimum(after, len(widths) - 1)])
    at = np.cumsum(width) - width
    value, byte = code << (at & 7), at >> 3
    n = int(at[-1] + width[-1] + 7) >> 3
    total = sum(np.bincount(byte + j, weights=value >> 8 * j & 255, minlength=n + 2) for j in range(3))
    return total[:n].astype(np.uint8).tobytes()


def _blocks(raw: bytes) -> bytes:
    whole = len(raw) // 255
    out = np.empty((whole, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(raw, np.uint8, whole * 255).reshape(whole, 255)
    rest = raw[whole * 255 :]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY, palette: bytes = COLOURS, transparent: int | None = None, disposals: tuple[int, ...] = (1, 2, 3)) -> bytes:
    """A GIF whose frames hold the payload, a multiple of `width` bytes, row by row; `delay` hundredths of a second each.

    disposals: how frames are disposed of, in turn. transparent: an index that shows what is below. A comment has the
    payload's digest, which media() compares with what it reads.
    """
    if not payload or len(payload) % width:
        raise ValueError("the payload must be whole rows, at least one")
    height = min(rows, len(payload) // width)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    parts += [b"\x21\xfe", _blocks(DIGEST + hashlib.sha256(payload).hexdigest().encode())]
    step, clear = rows * width, transparent is not None
    for k, at in enumerate(range(0, len(payload), step)):
        some = payload[at : at + step]
        control = struct.pack("<BHBB", disposals[k % len(disposals)] << 2 | clear, delay, transparent or 0, 0)
        parts += [b"\x21\xf9\x04", control, b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(some) // width, 0), b"\x08", _blocks(_codes(some))]
    return b"".join([*parts, b"\x3b"])


def _cut_out(bits: np.ndarray, place: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Codes of given widths at bit offsets; bits: the bytes, with eight more at the end."""
    byte = place >> 3
    value = bits[byte].astype(np.int64) | bits[byte + 1].astype(np.int64) << 8 | bits[byte + 2].astype(np.int64) << 16
    return value >> (place & 7) & ((1 << width) - 1)


def lzw(raw: bytes, depth: int, wanted: int) -> np.ndarray:
    """The first `wanted` samples of a GIF code stream; depth: its minimum code size."""
    if not 1 <= depth <= 11:
        raise ValueError("code size")
    clear = 1 << depth
    bits, total = np.frombuffer(raw + b"\0" * 8, np.uint8), 8 * len(raw)
    single = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at = n = 0
    table, before, fresh = single.copy(), b"", True
    while n < wanted:
        if fresh:
            widths, offsets = _places(depth)
        else:  # the table is full and isn't cleared yet
            widths, offsets = np.full(MOST, 12), 12 * np.arange(MOST)
        room = int(np.searchsorted(offsets + widths, total - at, "right"))
        if not room:
            raise ValueError("the code stream ends early")
        codes = _cut_out(bits, at + offsets[:room], widths[:room])
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        k = int(marks[0]) if len(marks) else room
        size = len(table)
        for code in codes[:k].tolist():
            if code < size:
                now = table[code]
            elif code == size and before:
                now = before + before[:1]
            else:
                raise ValueError("a code beyond the table")
            out.append(now)
            n += len(now)
            if before and size < MOST:
                table.append(before + now[:1])
                size += 1
            before = now
            if n >= wanted:
                break
        if n >= wanted or k < room and codes[k] == clear + 1:
            break
        if k < room:
            at += int(offsets[k] + widths[k])
            table, before, fresh = single.copy(), b"", True
        else:
            at += int(offsets[room - 1] + widths[room - 1])
            fresh = False
            if room < len(widths):
                raise ValueError("the code stream ends early")
    if n < wanted:
        raise ValueError("fewer samples than the frame has")
    return np.frombuffer(b"".join(out), np.uint8, wanted)


@dataclass
class Frame:
    """samples: palette indices, a row each; delay in hundredths of a second; canvas: RGBA as shown, if asked for."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    transparent: int | None
    disposal: int
    delay: int
    canvas: np.ndarray | None = None


def _gather(raw: bytes, at: int) -> tuple[bytes, int]:
    """The contents of sub-blocks, and where they end."""
    parts = []
    n = len(raw)
    while True:
        full = 0
        if raw[at] == 255:  # as many full blocks as there are in a row
            heads = np.frombuffer(raw, np.uint8)[at::256]
            full = int(np.argmax(heads != 255)) if (heads != 255).any() else len(heads)
            full = min(full, (n - at) // 256)
            if full:
                parts.append(np.frombuffer(raw, np.uint8, full * 256, at).reshape(full, 256)[:, 1:].tobytes())
                at += full * 256
                continue
        size = raw[at]
        if at + 1 + size > n:
            raise ValueError("a block ends early")
        at += 1
        if not size:
            return b"".join(parts), at
        parts.append(raw[at : at + size])
        at += size


def decode(raw: bytes, canvases: bool = True) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a GIF."""
    every = list(frames_in(raw, canvases))
    return (*struct.unpack_from("<HH", raw, 6), every)


def frames_in(raw: bytes, canvases: bool = True) -> Iterator[Frame]:
    """The frames of a GIF one by one."""
    try:
        yield from _frames(raw, canvases)
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def _frames(raw: bytes, canvases: bool) -> Iterator[Frame]:
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at = 13
    common = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    control = (0, 0, None)
    canvas = np.zeros((height, width, 4), np.uint8) if canvases else None
    while raw[at] != 0x3B:
        kind = raw[at]
        if kind == 0x21:
            label = raw[at + 1]
            body, at = _gather(raw, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, delay, index if packed & 1 else None)
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", raw, at + 1)
        at += 10
        palette = common
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise ValueError("a frame without a palette")
        depth = raw[at]
        stream, at = _gather(raw, at + 1)
        samples = lzw(stream, depth, w * h).reshape(h, w)
        if flags & 0x40:  # interlaced: every eighth row, those between, and so on
            order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
            rows = np.empty_like(samples)
            rows[order] = samples
            samples = rows
        disposal, delay, transparent = control
        frame = Frame(left, top, samples, palette, transparent, disposal, delay)
        if canvas is not None:
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            seen = samples[: area.shape[0], : area.shape[1]]
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(palette), :3], colours[:, 3] = palette, 255
            if transparent is None:
                area[:] = colours[seen]
            else:
                drawn = seen != transparent
                area[drawn] = colours[seen[drawn]]
            frame.canvas = canvas.copy()
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
        yield frame
        control = (0, 0, None)


def histogram(frame: Frame) -> np.ndarray:
    """How many points of the canvas where a frame lies have a colour in each eighth of the cube, and how many none."""
    height, width = frame.samples.shape
    points = frame.canvas[frame.top : frame.top + height, frame.left : frame.left + width].reshape(-1, 4)
    eighth = (points[:, 0] >> 7) * 4 + (points[:, 1] >> 7) * 2 + (points[:, 2] >> 7)
    return np.bincount(np.where(points[:, 3] > 0, eighth, 8), minlength=9).astype(np.int64)


_FRAME = "doc_id long, frame int, time_ms long, duration_ms long, disposal int, width int, height int, histogram array<long>"
_IMAGE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long, times_ms array<long>, histogram array<long>"


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most 512, or of about `most` bytes in binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) == 512 or size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _kinds(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "binary[]": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the image of every text, written to the shared folder and read from there.

    Samples are coloured; frames stay, are cleared and are taken back in turn. No sample is transparent, as each is a byte
    of the text.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, media binary"

    def one(text: bytes) -> bytes:
        size = -(-max(len(text), 1) // WIDTH) * WIDTH
        return encode(text.ljust(size, b" "))

    def run(batches):
        for b in batches:
            texts = ((d.as_py(), x.as_buffer().to_pybytes() if x.is_valid else b"") for d, x in zip(b.column(0), b.column(1)))
            yield from _batches(((d, len(t), one(t)) for d, t in texts), _kinds(schema))

    return cut(fit_columns(docs, "doc_id", "text").mapInArrow(run, schema), "media")


def frames(images: DataFrame, canvases: bool = False) -> DataFrame:
    """A row for each frame of the GIFs in the column media: when it shows, for how long, and its canvas's colours.

    canvases: with the canvas, four bytes a point.
    """
    ship(images.sparkSession)
    schema = _FRAME + ", canvas binary" * canvases

    def rows(doc_id, raw: bytes):
        time = 0
        for k, f in enumerate(frames_in(raw)):
            row = (doc_id, k, time, f.delay * 10, f.disposal, f.canvas.shape[1], f.canvas.shape[0], histogram(f).tolist())
            yield (*row, f.canvas.tobytes()) if canvases else row
            time += f.delay * 10

    def run(batches):
        for b in batches:
            yield from _batches((r for d, x in zip(b.column(0), b.column(1)) if x.is_valid for r in rows(d.as_py(), x.as_py())), _kinds(schema))

    return fit_columns(images, "doc_id", "media").mapInArrow(run, schema)


def media(images: DataFrame) -> DataFrame:
    """What is read back from each stored image of store(): its payload's and its own digests, its frames' times and colours."""
    ship(images.sparkSession)

    def one(doc_id, n_bytes: int, raw: bytes) -> tuple:
        whole, tail, size, rows = hashlib.sha256(), b"", 0, 0
        times, colours, time = [], np.zeros(9, np.int64), 0
        for f in frames_in(raw):
            some = f.samples.tobytes()
            whole.update(some)
            tail = (tail + some)[-16:]
            size += len(some)
            rows += len(f.samples)
            times.append(time)
            time += f.delay * 10
            colours += histogram(f)
        if raw.find(DIGEST + whole.hexdigest().encode(), 0, 2048) < 0:
            raise ValueError(f"what was read isn't what was stored, document {doc_id}")
        feature = f"{f.samples.shape[1]}x{rows}/{len(times)}/{time}ms:" + "-".join(map(str, colours.tolist()))
        return (doc_id, n_bytes, size, whole.hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), feature, len(times), time, times, colours.tolist())

    def run(batches):
        for b in batches:
            yield from _batches((one(d.as_py(), n.as_py(), x.as_py()) for d, n, x in zip(*(b.column(i) for i in range(3)))), _kinds(_IMAGE))

    return fit_columns(images, "doc_id", "n_bytes", "media").mapInArrow(run, _IMAGE)


def op10_gif(docs: DataFrame) -> DataFrame:
    return media(store(docs))
