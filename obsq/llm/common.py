"""What the operators share: the shared folder, files in it, and vectorised hashing of texts in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        at = os.path.join(tempfile.mkdtemp(prefix="obsq-"), f"{root.name}.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(at)
        _SHIPPED.add(app)
    return spark


def one_thread() -> None:
    """Let numpy's matrix products in this process use one thread, as a task has one core; workers are told the executor's cores."""
    try:
        with open("/proc/self/maps") as f:
            paths = {x.split(maxsplit=5)[5].strip() for x in f if "openblas" in x}
    except OSError:
        return
    for path in paths:
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if put := getattr(lib, name, None):
                put(1)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see; a temporary one only where that is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        base = f"file://{tempfile.mkdtemp(prefix='obsq-checkpoint-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/obsq-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, whole: bool = False) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again: ends the lineage and survives executors.

    At most four files for each core are written, so that a table of many small partitions isn't as many small files.
    whole: a task for each partition, for code that goes by the number of its task.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    (df if whole else df.coalesce(max(8, 4 * spark.sparkContext.defaultParallelism))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what cut() wrote, when nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now, not when the driver's heap happens to fill up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hand_back(spark: SparkSession) -> None:
    """Let executors give the heap that finished steps have freed back to the machine; SQL alone, so native steps may begin with it.

    A heap stays as large as any step made it, so the peaks of steps that follow each other add up otherwise. A few small
    tasks for each core reach every executor that is idle. What Python workers hold is trim_workers()'s and trimmed()'s matter.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')").alias("swept")).write.format("noop").mode("overwrite").save()


def trim() -> None:
    """Give back what this process's allocators keep of freed memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run):
    """A function of a partition's batches, as mapInArrow takes it, whose worker gives freed memory back at the end."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def trim_workers(spark: SparkSession) -> None:
    """Let idle Python workers give freed memory back, by a few small tasks for each core."""
    ship(spark)
    tasks = 2 * spark.sparkContext.defaultParallelism

    def run(batches):
        trim()
        yield from batches

    spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI of the shared folder, or of a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fit_columns(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, whatever else the table has: extra columns can't clash with ours."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the table has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list:
    """All columns of the table, whatever signs are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """The table with a broadcast hint if its written size is proven to be under the bound; else Catalyst's own choice."""
    path = getattr(df, "cut_path", None)
    if path is None:
        return df
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return F.broadcast(df) if size <= most_bytes else df


# ---------------------------------------------------------------- texts as bytes


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the word."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit values drawn from a seed."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


#: Spans of more bytes than this are hashed one by one.
LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of spans of a byte array, mixed anew after every eight bytes. Lanes are independent of each other."""
    size = end - start
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0xD1342543DE82EF95 * (lane + 1) % (1 << 64)))
    view = _eights(data)
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        word = view[start[live] + at] & _KEEP[np.minimum(size[live] - at, 8)]
        h[live] = mix((h[live] ^ word) * U64(0xC2B2AE3D27D4EB4F) + U64(at + 1))
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, person=b"span%d" % lane).digest(), "little")
    return h


def same_spans(data: np.ndarray, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> bool:
    """Whether the spans of these sizes at `first` have the bytes of those at `second`, all of them."""
    view = _eights(data)
    live, at = np.flatnonzero((first != second) & (size > 0) & (size <= LONG)), 0
    while len(live):
        keep = _KEEP[np.minimum(size[live] - at, 8)]
        if ((view[first[live] + at] ^ view[second[live] + at]) & keep).any():
            return False
        at += 8
        live = live[size[live] > at]
    other = np.flatnonzero((first != second) & (size > LONG)).tolist()
    return all(np.array_equal(data[first[k] : first[k] + size[k]], data[second[k] : second[k] + size[k]]) for k in other)


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """(hash of each distinct span, one of its spans, which of them each span is), with every span's bytes compared.

    If unlike spans have one hash, each span is distinct and there are no hashes.
    """
    keys, at, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    size = end - start
    if np.array_equal(size, size[at][which]) and same_spans(data, start, start[at][which], size):
        return keys, at, which
    every = np.arange(len(start))
    return None, every, every


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for runs of rows of about `most` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


#: Bytes with A-Z read as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that aren't separators; is_sep: 256 booleans."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~is_sep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Bloom:
    """A fixed-size bit table of 64-bit keys, built in the executors and merged in a tree: false positives only.

    Its size follows the number of keys up to a bound, so what is broadcast never outgrows it.
    """

    MOST_BITS = 1 << 27

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, U64(len(words) * 64 - 1)

    @staticmethod
    def _spots(keys: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
        h = keys.view(U64)
        for salt in (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)):
            yield mix(h + salt) & mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._spots(keys, self.mask):
            out &= (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
        return out

    @classmethod
    def of(cls, keys: DataFrame, count: int) -> "Bloom":
        """keys: one column of longs."""
        size = 1 << 16
        while size < min(cls.MOST_BITS, 12 * count):
            size *= 2

        def fill(batches):
            words = np.zeros(size // 64, U64)
            for b in batches:
                k = b.column(0).drop_null().to_numpy(zero_copy_only=False)
                for at in cls._spots(k, U64(size - 1)):
                    np.bitwise_or.at(words, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
            full = np.flatnonzero(words)
            for i in range(0, len(full), 1 << 16):
                at = full[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(signed(words[at]))], names=["at", "bits"])

        parts = keys.mapInArrow(fill, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits"))
        words = np.zeros(size // 64, U64)
        got = parts.toArrow()  # at most MOST_BITS / 64 rows, whatever the number of keys
        words[got["at"].to_numpy()] = got["bits"].to_numpy().view(U64)
        return cls(words)
