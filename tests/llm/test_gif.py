import hashlib
import struct
import zlib

import numpy as np
import pytest

from obsq.llm.gif import decode, encode, lzw, op10_gif

SCHEMA = "doc_id long, text string, media string"


def compress(samples, depth, deferred=False):
    """A plain LZW encoder, for streams that do refer to the table."""
    clear = 1 << depth
    bits, n = 0, 0

    def put(code, width):
        nonlocal bits, n
        bits |= code << n
        n += width

    table, width = {bytes([i]): i for i in range(clear)}, depth + 1
    put(clear, width)
    size, now = clear + 2, b""
    for s in samples:
        if now + bytes([s]) in table:
            now += bytes([s])
            continue
        put(table[now], width)
        if size < 4096:
            table[now + bytes([s])] = size
            size += 1
            if size > 1 << width and width < 12:
                width += 1
        elif not deferred:
            put(clear, width)
            table, width, size = {bytes([i]): i for i in range(clear)}, depth + 1, clear + 2
        now = bytes([s])
    put(table[now], width)
    put(clear + 1, width)
    return bits.to_bytes(-(-n // 8), "little")


@pytest.mark.parametrize("depth,deferred,n", [(8, False, 30000), (8, True, 30000), (2, False, 5000), (4, False, 9000), (8, False, 1)])
def test_code_streams_that_use_the_table(depth, deferred, n):
    r = np.random.default_rng(n + depth)
    samples = np.repeat(r.integers(0, 1 << depth, n), r.integers(1, 4, n))[:n].astype(np.uint8)
    assert lzw(compress(samples.tolist(), depth, deferred), depth, n).tolist() == samples.tolist()


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200])
def test_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, 192 * n, dtype=np.uint8).tobytes()
    raw = encode(payload)
    width, height, frames = decode(raw)
    assert b"".join(f.samples.tobytes() for f in frames) == payload
    assert (width, height, len(frames)) == (192, min(n, 64), -(-n // 64))
    assert all(f.delay == 4 for f in frames)
    assert frames[-1].canvas[: len(frames[-1].samples), :, 0].tobytes() == frames[-1].samples.tobytes()


def image(frames, width=4, height=2):
    """frames: (left, top, rows of samples, disposal, transparent, interlaced, local palette)."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + palette
    for left, top, rows, disposal, transparent, interlaced, local in frames:
        raw = compress([s for r in rows for s in r], 2)
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), 7, transparent or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, len(rows[0]), len(rows), (0x81 if local else 0) | 0x40 * interlaced) + (local or b"")
        out += b"\x02" + bytes([len(raw)]) + raw + b"\0"
    return out + b"\x21\xfe\x02hi\0\x3b"


def test_disposal_and_transparency():
    full = [[1] * 4, [1] * 4]
    _, _, f = decode(image([(0, 0, full, 1, None, False, None), (1, 0, [[2, 3]], 3, 3, False, None), (0, 1, [[3]], 2, None, False, None), (3, 1, [[0]], 0, None, False, bytes([9, 9, 9]) * 4)]))
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert f[0].canvas.tolist() == [[red] * 4] * 2
    assert f[1].canvas.tolist() == [[red, green, red, red], [red] * 4]
    assert f[2].canvas.tolist() == [[red] * 4, [blue, red, red, red]]
    assert f[3].canvas.tolist() == [[red] * 4, [none, red, red, [9, 9, 9, 255]]]
    assert [x.delay for x in f] == [7] * 4


def test_interlaced_rows():
    rows = [[y % 4] * 2 for y in range(10)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    _, _, f = decode(image([(0, 0, [rows[y] for y in order], 0, None, True, None)], 2, 10))
    assert f[0].samples.tolist() == rows


def test_damage_is_found():
    raw = encode(b"x" * 192)
    for bad in (b"GIF88a" + raw[6:], raw[:-30], raw[:900], raw[:5]):
        with pytest.raises(ValueError):
            decode(bad)


def test_over_a_table(spark):
    texts = [None, "", "a", "é" * 96, "x" * 193, "long é " * 20000, "a"]
    got = {r.doc_id: r for r in op10_gif(spark.createDataFrame([(d, t, "x") for d, t in enumerate(texts)], SCHEMA)).collect()}
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        stored = encode(payload)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert sum(r.histogram) == len(payload)
    assert tuple(got[2])[1:] == tuple(got[6])[1:]
    assert op10_gif(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 191, 4000, 60000])
def test_written_code_streams_are_those_of_a_plain_encoder(n):
    """Long, repetitive and random samples, with tables that fill up and are cleared."""
    from obsq.llm.gif import _codes

    r = np.random.default_rng(n)
    for samples in (r.integers(0, 256, n, dtype=np.uint8), r.integers(97, 100, n).astype(np.uint8), np.full(n, 7, np.uint8), np.frombuffer(b"the cat and the dog " * n, np.uint8, n)):
        assert lzw(_codes(samples.tobytes()), 8, n).tolist() == samples.tolist()
        assert lzw(compress(samples[:6000].tolist(), 8), 8, len(samples[:6000])).tolist() == samples[:6000].tolist()
    text = b"the cat and the dog " * 500
    assert len(_codes(text)) < len(text) // 3


def test_frames_of_a_column(spark):
    """Rows for frames, with times and what is seen, by transparency and disposal."""
    from obsq.llm.gif import frames

    full = [[1] * 4, [1] * 4]
    raw = image([(0, 0, full, 1, None, False, None), (1, 0, [[2, 3]], 3, 3, False, None), (0, 1, [[3]], 2, None, False, None), (3, 1, [[0]], 0, None, False, bytes([9, 9, 9]) * 4)])
    df = spark.createDataFrame([(1, raw, "x"), (2, None, "y"), (3, bytearray(encode(b"a" * 192 * 70)), "z")], "doc_id long, media binary, frame string")
    got = {(r.doc_id, r.frame): r for r in frames(df, canvases=True).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (3, 0), (3, 1)]
    assert [got[1, k].time_ms for k in range(4)] == [0, 70, 140, 210] and [got[1, k].disposal for k in range(4)] == [1, 3, 2, 0]
    assert got[1, 0].histogram == [0, 0, 0, 0, 8, 0, 0, 0, 0] and got[1, 1].histogram == [0, 0, 1, 0, 1, 0, 0, 0, 0]
    _, _, want = decode(raw)
    assert [bytes(got[1, k].canvas) for k in range(4)] == [f.canvas.tobytes() for f in want]
    assert frames(spark.createDataFrame([], df.schema)).count() == 0


def test_a_stored_image_that_is_changed_is_found(spark):
    from obsq.llm.gif import media

    raw = encode(b"a" * 192)
    bad = raw.replace(b"sha256 ", b"sha256 0", 1)[: len(raw)]
    with pytest.raises(Exception):
        media(spark.createDataFrame([(1, 5, bytearray(bad))], "doc_id long, n_bytes long, media binary")).collect()
