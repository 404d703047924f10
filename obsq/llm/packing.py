"""Packing by power-of-two decomposition (operator 9).

A document's ids, with the end id, are cut into pieces whose lengths are powers of two: as many of the longest as fit,
then the binary digits of the rest from high to low. Pieces of equal length form a bucket, each piece is a sequence by
itself, so no sequence crosses documents and none holds padding. Sequences are numbered bucket by bucket, longest first.

Defined cases: a null text counts as empty and gives one piece with the end id alone; repeated rows give their pieces
again, in sequences of their own; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsq.llm.common import cut, fit_columns, ship, small
from obsq.llm.tokenise import documents_ids


def lengths(n: int, longest: int) -> list[int]:
    """The pieces of a document of n tokens."""
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit) of every piece, and where it was made.

    part and slot: the task that made it and its place among that task's pieces of the same length.
    """
    ship(docs.sparkSession)
    lengths(1, longest)

    def split(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), np.zeros(longest.bit_length(), np.int64)
        powers = 1 << np.arange(longest.bit_length() - 2, -1, -1)
        for batch in batches:
            for row, ids, count in documents_ids(tokenizer, batch.column(1), end_id):
                whole = count // longest
                digits = (count[:, None] & powers[None, :]) != 0
                each = whole + digits.sum(1)
                doc = np.repeat(np.arange(len(count)), each)
                first = np.cumsum(each) - each
                place = np.arange(len(doc)) - first[doc]
                length = np.full(len(doc), longest)
                short = place >= whole[doc]
                length[short] = np.broadcast_to(powers, digits.shape)[digits]
                total = np.cumsum(length) - length
                start = total - total[first][doc]
                level = np.log2(length).astype(np.int64)
                slot = np.empty(len(doc), np.int64)
                for k in np.unique(level):
                    at = np.flatnonzero(level == k)
                    slot[at] = made[k] + np.arange(len(at))
                    made[k] += len(at)
                edge = np.append(total, len(ids)) * 4
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edge.astype("<i8")), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + doc)), pa.array(start), pa.array(length), pa.array(count[doc]), raw.cast(pa.binary()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(slot)],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "slot"],
                )

    return fit_columns(docs, "doc_id", "text").mapInArrow(split, "doc_id long, start long, length long, doc_tokens long, ids binary, part int, slot long")


def number(made: DataFrame) -> DataFrame:
    """sequence_id and offset for rows of pieces(), with whatever columns they still have besides part and slot."""
    made = cut(made, "pieces", whole=True)
    sizes = made.groupBy("length", "part").count()
    at, sums = 0, F.lit(None).cast("long")
    for r in sorted(sizes.groupBy("length").agg(F.sum("count").alias("n")).collect(), key=lambda r: -r["length"]):  # a row for each power of two
        sums = F.when(F.col("length") == r["length"], F.lit(at).cast("long")).otherwise(sums)
        at += r.n
    before = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = cut(sizes.select("length", "part", (sums + before).alias("base")), "bases")  # a row for each task and length
    return made.join(small(bases), ["length", "part"]).withColumn("sequence_id", F.col("base") + F.col("slot")).withColumn("offset", F.lit(0).cast("long")).drop("base", "part", "slot")


def op9_packing(spark: SparkSession, docs: DataFrame, tokenizer: str, longest: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    made = pieces(docs, tokenizer, longest).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return number(made).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
