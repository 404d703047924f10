"""WARC archives: a writer with one gzip member for each record, and a sequential reader (operator 5).

A record holds an HTTP response: its header with the payload's Content-Length, and the payload in UTF-8. Records whose
payload equals that of a record with a smaller page_id are `revisit` records (identical-payload-digest): the HTTP header
alone, the payload's digest, and the id of the record that has the payload. The reader inflates member after member in
chunks, takes the block's length from Content-Length, and checks the digests of block and payload; what doesn't match
raises an error.

Defined cases: null html counts as an empty payload; rows with a null page_id are responses that nothing refers to; of
rows that repeat a page_id and its payload all are what the first of them is; rows that share the smallest page_id are all
responses; a null url is left out; an empty table gives no archives and no rows; other columns are ignored. A task that
is run again writes another archive, and only those that the manifest names are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.llm.common import cut, filesystem, fit_columns, shared_dir, ship

URN = "urn:obsq:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    name = f"{URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if " " < c else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Inflated:
    """The bytes of one gzip member after another, as they are asked for."""

    def __init__(self, stream, chunk: int) -> None:
        self.stream, self.chunk, self.raw = stream, chunk, b""

    def next(self) -> bool:
        """Begin a member; False at the end of the file."""
        self.z, self.out = zlib.decompressobj(31), bytearray()
        if not self.raw:
            self.raw = self.stream.read(self.chunk)
        return bool(self.raw)

    def more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(self.chunk)
            if not self.raw:
                raise ValueError("the archive ends within a gzip member")
        self.out += self.z.decompress(self.raw)
        self.raw = self.z.unused_data if self.z.eof else b""
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (i := self.out.find(mark, at)) < 0:
            at = max(0, len(self.out) - len(mark) + 1)
            if not self.more():
                raise ValueError("a record's header has no end")
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise ValueError("a record is shorter than its Content-Length")
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def rest(self) -> bytes:
        while self.more():
            pass
        return bytes(self.out)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith(("WARC/1.", "HTTP/1.")):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def read_archive(stream, chunk: int = 1 << 16) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(fields, HTTP fields, payload) of every record; the payload of a revisit is empty."""
    source = _Inflated(stream, chunk)
    while source.next():
        fields = _fields(source.until(b"\r\n\r\n"))
        block = source.take(int(fields["content-length"]))
        if source.rest() != b"\r\n\r\n":
            raise ValueError("a member holds more or less than one record")
        if fields["warc-block-digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"block digest of {fields['warc-record-id']}")
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head)
        if fields["warc-type"] == "response":
            if len(payload) != int(http["content-length"]):
                raise ValueError(f"payload length of {fields['warc-record-id']}")
            if fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
                raise ValueError(f"payload digest of {fields['warc-record-id']}")
        yield fields, http, payload


def first_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with an equal payload, where that is another one."""
    pages = fit_columns(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long")).withColumn("html", F.coalesce("html", F.lit("")))
    keyed = pages.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("n")).where(F.col("page_id").isNotNull() & (F.col("n") >= least_bytes))
    groups = keyed.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    later = keyed.join(groups.hint("merge"), "sha").where("page_id > first").select("page_id", F.col("sha").alias("_sha"), "first").distinct()
    # A repeated page_id can have several payloads, so the payload's hash is part of the key.
    sha = F.sha2("html", 256)
    return pages.withColumn("_sha", sha).join(later.hint("merge"), ["page_id", "_sha"], "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, most: int = 256 << 20) -> DataFrame:
    """Write the archives, each of at most about `most` bytes; returns their manifest (path, records)."""
    ship(pages.sparkSession)
    folder = folder or shared_dir(pages.sparkSession, "warc")

    def write(batches):
        fs, top = filesystem(folder)
        stream = name = None
        n = 0

        def done():
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(i) for i in range(4))):
                if stream is None:
                    fs.create_dir(top, recursive=True)
                    name, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    stream = fs.open_output_stream(f"{top}/{name}", compression=None)
                payload = html.as_buffer().to_pybytes()
                stream.write(member(record(page_id.as_py(), url.as_py(), payload, digest(payload), refers_to.as_py())))
                n += 1
                if stream.tell() >= most:
                    yield done()
                    stream = None
        if stream is not None:
            yield done()

    return cut(first_copies(pages, least_bytes).mapInArrow(write, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload, if asked for) of every record."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def page(name: str | None) -> int | None:
        return int(name[len(URN) + 1 : -1]) if name and name.startswith(f"<{URN}") else None

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = filesystem(path)
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for fields, http, payload in read_archive(stream):
                        rows.append((page(fields["warc-record-id"]), int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], page(fields.get("warc-refers-to")), payload)[: 5 + payloads])
                        size += len(payload) * payloads
                        if len(rows) >= 4096 or size >= 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names[: len(rows[0])])

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, schema)


def op5_warc(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages))


def archive_bytes(rows) -> io.BytesIO:
    """An archive in memory of (page_id, url, payload, refers_to), for small uses."""
    return io.BytesIO(b"".join(member(record(i, u, p, digest(p), r)) for i, u, p, r in rows))


#: The same in SQL, by way of the digest's bits.
ORACLE = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
    SELECT *, unhex(sha1(html))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY html) AS least FROM p
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * i + 1, 1)::INTEGER + 8 * substr(bits, 5 * i + 2, 1)::INTEGER
           + 4 * substr(bits, 5 * i + 3, 1)::INTEGER + 2 * substr(bits, 5 * i + 4, 1)::INTEGER + substr(bits, 5 * i + 5, 1)::INTEGER)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to
FROM d
"""
