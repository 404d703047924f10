"""Token ids of documents in files of fixed-width bit-packed integers, in ascending doc_id order (operator 2).

Each id takes the fewest bits that hold the vocabulary. A file is a header, blocks of `block` ids (the last one padded
with zeros to eight ids), the offset of every block, the documents with their token counts, and a tail that says where
those start; ids are unpacked by numpy, eight lanes at a time, and any span is read by itself.

Defined cases: a null text counts as empty and has the end id alone; rows with equal doc_id keep their rows, in any
order; null doc_id comes first; an empty table gives no files and no rows; columns besides doc_id and text are ignored.
A task that is run again writes another file, and only files that the manifest names are read.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsq.llm.common import cut, filesystem, fit_columns, shared_dir, ship
from obsq.llm.tokenise import Encoder, documents_ids

MAGIC = b"OBSQIDS1"
HEAD = struct.Struct("<8sBxxxI")
TAIL = struct.Struct("<QQQ8s")


def width(vocabulary: int) -> int:
    """Bits for ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, lowest bit first; the count is filled up with zeros to a multiple of eight."""
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.ravel()[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, byte + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack(raw: bytes | np.ndarray, bits: int) -> np.ndarray:
    """The ids of a run of whole groups of eight."""
    groups = np.frombuffer(raw, np.uint8).reshape(-1, bits)
    out = np.empty((len(groups), 8), "<u4")
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(len(groups), np.uint64)
        for k in range((shift + bits + 7) // 8):
            value |= groups[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.ravel()


class Writer:
    """One file; ids are written block by block, so memory holds one block and the table of documents."""

    def __init__(self, stream, bits: int, block: int) -> None:
        if bits > 32 or block % 8:
            raise ValueError("at most 32 bits an id, and blocks of a multiple of 8 ids")
        self.stream, self.bits, self.block = stream, bits, block
        self.rest: list[np.ndarray] = []
        self.held = self.at = self.total = 0
        self.offsets: list[int] = []
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self._put(HEAD.pack(MAGIC, bits, block))

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def add(self, docs: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs.astype("<i8"))
        self.nulls.append(null.astype(np.uint8))
        self.counts.append(counts.astype("<u8"))
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            self._flush(self.held - self.held % self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.rest)
        raw, each = pack(ids[:n], self.bits), self.block * self.bits // 8
        self.offsets += range(self.at, self.at + len(raw), each)
        self._put(raw)
        self.rest, self.held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        """(documents, ids)"""
        if self.held:
            self._flush(self.held)
        table = self.at
        for x in (np.array(self.offsets, "<u8"), *(np.concatenate(y) if y else np.zeros(0, "u1") for y in (self.docs, self.nulls, self.counts))):
            self._put(x.tobytes())
        n = sum(map(len, self.docs))
        self._put(TAIL.pack(table, len(self.offsets), n, MAGIC))
        self.stream.close()
        return n, self.total


class Reader:
    """Random access to one file: documents, and any span of ids."""

    def __init__(self, stream) -> None:
        self.stream = stream
        magic, self.bits, self.block = HEAD.unpack(self._read(0, HEAD.size))
        size = stream.size()
        table, blocks, n, end = TAIL.unpack(self._read(size - TAIL.size, TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a file of packed ids")
        raw = self._read(table, size - TAIL.size - table)
        self.offsets = np.frombuffer(raw, "<u8", blocks)
        self.docs = np.frombuffer(raw, "<i8", n, 8 * blocks)
        self.null = np.frombuffer(raw, "u1", n, 8 * (blocks + n)).astype(bool)
        self.counts = np.frombuffer(raw, "<u8", n, 8 * (blocks + n) + n).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.table = table

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def span(self, start: int, n: int) -> np.ndarray:
        """ids start to start + n of the file; reads the blocks that hold them."""
        if not n:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.table
        ids = unpack(self._read(int(self.offsets[first]), end - int(self.offsets[first])), self.bits)
        return ids[start - first * self.block :][:n]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.counts[k]))


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, block: int = 1 << 14, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Write the files; returns the manifest (number, path, n_docs, n_tokens, start), a row for each file.

    Rows are dealt by ranges of doc_id and sorted, so that files in the order of their number hold ascending doc_id.
    """
    spark = ship(docs.sparkSession)
    folder = folder or shared_dir(spark, "ids")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = fit_columns(docs, "doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        from pyspark import TaskContext

        number, writer = TaskContext.get().partitionId(), None
        fs, top = filesystem(folder)
        path = f"{folder}/ids-{number:06d}-{uuid.uuid4().hex}.bin"
        for batch in batches:
            doc = batch.column(0)
            null, docs_ = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            for row, ids, counts in documents_ids(tokenizer, batch.column(1), end_id):
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    writer = Writer(fs.open_output_stream(f"{top}/{path.rsplit('/', 1)[1]}"), width(Encoder.open(tokenizer).vocabulary), block)
                some = slice(row, row + len(counts))
                writer.add(docs_[some], null[some], counts, ids)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    files = cut(dealt.mapInArrow(write, "number int, path string, n_docs long, n_tokens long"), "manifest", whole=True)
    start, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: r.number):  # one row a file
        rows.append((r.number, r.path, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, "number int, path string, n_docs long, n_tokens long, start long")


def read_ids(manifest: DataFrame, most: int = 1 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document in the files."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as stream:
                    r = Reader(stream)
                    lo = 0
                    while lo < len(r.docs):
                        hi = max(lo + 1, int(np.searchsorted(r.starts + r.counts, r.starts[lo] + most, "right")))
                        ids = r.span(int(r.starts[lo]), int(r.counts[lo:hi].sum()))
                        edge = 4 * (np.append(r.starts[lo:hi], r.starts[hi - 1] + r.counts[hi - 1]) - r.starts[lo])
                        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(edge.astype("<i8")), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r.docs[lo:hi], mask=r.null[lo:hi]), pa.array(r.starts[lo:hi] + base), pa.array(r.counts[lo:hi]), raw.cast(pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        lo = hi

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_output(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files."""
    back = read_ids(write_ids(docs, tokenizer))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
