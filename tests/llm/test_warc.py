import base64
import gzip
import hashlib
import io

import pytest

from obsq.llm.warc import archive_bytes, op5_warc, read_archive, read_archives, write_archives

SCHEMA = "page_id long, html string, url string, refers_to int, path string"


def brute(pages):
    first = {}
    for p, html, *_ in pages:
        if p is not None:
            first[html or ""] = min(first.get(html or "", p), p)
    out = []
    for p, html, *_ in pages:
        raw = (html or "").encode()
        f = first.get(html or "")
        again = p is not None and f < p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = [(9, "<p>a</p>", "http://x/ü y"), (3, "<p>a</p>", None), (5, "é\r\n\r\n", "u"), (7, None, "u"), (2, "", "v"), (None, "<p>a</p>", "u"), (3, "<p>a</p>", "u"), (9, "other", "u"), (11, "z" * 300_000, "u"), (9, "<p>a</p>", "u")]
    df = spark.createDataFrame([(p, h, u, 1, "x") for p, h, u in pages], SCHEMA).repartition(3)
    assert sorted(map(tuple, op5_warc(df).collect()), key=str) == brute(pages)
    assert op5_warc(df.limit(0)).count() == 0
    small = write_archives(df, least_bytes=5)
    back = read_archives(small, payloads=True).collect()
    assert {r.record_type for r in back if r.payload_bytes < 5} == {"response"}
    assert {(r.page_id, r.payload.decode()) for r in back if r.record_type == "response"} >= {(3, "<p>a</p>"), (11, "z" * 300_000), (7, ""), (2, "")}
    assert write_archives(df, most=1).count() == len(pages)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_reader_in_chunks_of_any_size(chunk):
    a = archive_bytes([(1, "u", b"one" * 50, None), (2, "u", b"one" * 50, 1), (3, None, b"", None)])
    got = [(f["warc-record-id"], f["warc-type"], p) for f, _, p in read_archive(a, chunk)]
    assert got == [("<urn:obsq:page:1>", "response", b"one" * 50), ("<urn:obsq:page:2>", "revisit", b""), ("<urn:obsq:page:3>", "response", b"")]


def test_damage_is_found():
    raw = archive_bytes([(1, "u", b"payload", None)]).getvalue()
    plain = gzip.decompress(raw)
    for bad in (plain.replace(b"payload", b"Payload"), plain.replace(b"\r\n\r\nHTTP", b"\r\n\r\nXTTP"), plain[:-2], plain.replace(b"WARC/1.1", b"JUNK/1.1")):
        with pytest.raises(ValueError):
            list(read_archive(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(raw[:-9])))
