"""Language identification with hyperdimensional profiles (operator 7).

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram of letters and word ends is bound
as the product of the three vectors, the first rotated twice and the second once. A text's vector bundles (sums) those
of all its trigrams; a language's prototype bundles its labelled texts, each with the same weight however long it is. A text gets the language whose prototype has
the greatest cosine with it, once what all prototypes share has been taken from both. Vectors are sums of integers, so
prototypes don't depend on the order or the split of the data.

Defined cases: null text and text without letters get `und` with score 0, as does everything if nothing is labelled;
equal cosines go to the language first in the alphabet; rows with a null doc_id are neither learned from nor held out;
repeated rows are predicted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsq.llm.common import U64, columns, cut, discard, fit_columns, fresh, mix, one_thread, ship, text_slices, trimmed

SPACE = 32
FOLDS = 5
PRED, SCORE = "_language_pred", "_language_score"
#: What a text adds to its language's prototype in all, in whole numbers, and the trigrams from which on it adds that much.
WHOLE, SHORT = 1 << 20, 100


#: Trigrams that are made into vectors at a time; rows, and counts of a trigram in a row, that are bundled at a time.
BLOCK, ROWS, CELLS = 2048, 256, 1 << 21
#: The code of letters that have none of their own.
OTHER = 63


class Profiles:
    """Trigrams of texts and their vectors; one per worker process and number of dimensions.

    Trigrams get ids as they are met; when there are more than `most`, ids begin anew with the next run of rows. Only the
    vectors of the first `kept` ids are held, in a byte for each dimension; others are made again whenever they are needed.
    So memory is bounded however many trigrams the corpus has.
    """

    _open: dict[int, "Profiles"] = {}

    def __init__(self, dimensions: int, most: int = 1 << 16, kept: int = 1 << 14) -> None:
        self.dimensions, self.most = dimensions, most
        self.kind = np.zeros(0x110000, np.uint8)  # of a code point: 0 unknown, 1 letter, 2 none
        self.kind[SPACE] = 2
        self.vectors = np.zeros((kept, dimensions), np.int8)
        # The first letters met have a code of six bits, and a table has the ids of trigrams of these; OTHER is any other.
        self.code_of, self.coded = np.full(0x110000, OTHER, np.uint8), 1
        self.code_of[SPACE] = 0
        self._empty()
        one_thread()

    def _empty(self) -> None:
        self.keys, self.ids, self.code = (np.zeros(0, np.int64) for _ in range(3))  # sorted keys, their ids; keys by id
        self.held = 0
        self.table = np.full(1 << 18, -1, np.int32)

    @classmethod
    def open(cls, dimensions: int) -> "Profiles":
        if dimensions not in cls._open:
            cls._open[dimensions] = cls(dimensions)
        return cls._open[dimensions]

    def letters(self, points: np.ndarray) -> np.ndarray:
        """A row of +1 and -1 for each code point."""
        words = self.dimensions // 64
        seed = mix(points.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(99))
        bits = mix(seed[:, None] + np.arange(1, words + 1, dtype=U64)[None, :] * U64(0xC2B2AE3D27D4EB4F))
        return (np.unpackbits(bits.view(np.uint8).reshape(len(points), 8 * words), axis=1).astype(np.int8) * 2 - 1).astype(np.int8)

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of trigrams: three letters' vectors, rotated by their places and multiplied."""
        mask = (1 << 21) - 1
        first, second, third = (self.letters(x) for x in (keys >> 42, keys >> 21 & mask, keys & mask))
        return np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of ids, ascending."""
        while self.held < min(len(self.vectors), len(self.code)):
            hi = min(self.held + BLOCK, len(self.vectors), len(self.code))
            self.vectors[self.held : hi] = self.bound(self.code[self.held : hi])
            self.held = hi
        old = ids[: np.searchsorted(ids, self.held)]
        return np.concatenate((self.vectors[old], self.bound(self.code[ids[len(old) :]])))

    def bundled(self, row: np.ndarray, ids: np.ndarray, weight: np.ndarray | None, rows: int, kind: type) -> np.ndarray:
        """For each row the sum of its trigrams' vectors, times their weights. rows: few enough for a count of each trigram."""
        distinct = np.flatnonzero(np.bincount(ids, minlength=len(self.code)))
        rank = np.zeros(len(self.code), np.int64)
        rank[distinct] = np.arange(len(distinct))
        count = np.bincount(row * len(distinct) + rank[ids], weights=weight, minlength=rows * len(distinct)).reshape(rows, len(distinct))
        out = np.zeros((rows, self.dimensions), kind)
        for lo in range(0, len(distinct), BLOCK):
            some = distinct[lo : lo + BLOCK]
            out += count[:, lo : lo + BLOCK].astype(kind) @ self.of(some).astype(kind)
        return out

    def runs(self, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """From and until which trigram runs of whole rows reach, short enough to be bundled together; row: ascending."""
        has, at = np.unique(row, return_index=True)
        at, step = np.append(at, len(row)), min(ROWS, max(1, CELLS // max(1, len(self.code))))
        for lo in range(0, len(has), step):
            yield int(at[lo]), int(at[min(lo + step, len(has))])

    def trigrams(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, trigram id) of every trigram, rows in order. data, offsets: lower-case text as from text_slices()."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        kind = self.kind[points]
        for c in np.unique(points[kind == 0]).tolist():
            self.kind[c] = 1 if chr(c).isalpha() else 2
        letter = self.kind[points] == 1
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after each word
        code = np.where(letter, points, SPACE).astype(np.int64)[keep]
        row = row[keep]
        has = np.flatnonzero(np.bincount(row[code != SPACE], minlength=len(offsets) - 1))
        at = np.concatenate((np.searchsorted(row, has, "right"), np.searchsorted(row, has)))  # an end before the next start
        code, row = np.insert(code, at, SPACE), np.insert(row, at, np.concatenate((has, has)))
        key = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
        inside = (row[:-2] == row[2:]) & (code[1:-1] != SPACE)
        key, row = key[inside], row[1:-1][inside]
        if not len(key):
            return row, key
        if len(self.keys) > self.most:
            self._empty()
        if self.coded < OTHER:
            for c in np.unique(code[self.code_of[code] == OTHER])[: OTHER - self.coded].tolist():
                self.code_of[c] = self.coded
                self.coded += 1
        short = self.code_of[code].astype(np.int32)
        place = (short[:-2] << 12 | short[1:-1] << 6 | short[2:])[inside]
        ids = self.table[place].astype(np.int64)
        if len(rest := np.flatnonzero(ids < 0)):
            ids[rest] = self._ids(key[rest])
            plain = rest[((place[rest] & 63) != OTHER) & ((place[rest] >> 6 & 63) != OTHER) & (place[rest] >> 12 != OTHER)]
            self.table[place[plain]] = ids[plain]
        return row, ids

    def _ids(self, key: np.ndarray) -> np.ndarray:
        spot = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = self.keys[spot] != key if len(self.keys) else np.ones(len(key), bool)
        if new.any():
            found = np.unique(key[new])
            self.ids = np.concatenate((self.ids, np.arange(len(found)) + len(self.code)))
            self.keys, self.code = np.concatenate((self.keys, found)), np.concatenate((self.code, found))
            order = np.argsort(self.keys)
            self.keys, self.ids = self.keys[order], self.ids[order]
            spot = np.searchsorted(self.keys, key)
        return self.ids[spot]


def held_out(doc_id):
    """Whether a row is kept from learning: crc32 of doc_id as text is a multiple of FOLDS. Null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def learn(docs: DataFrame, dimensions: int = 1024, most: int = 4096) -> dict[str, np.ndarray]:
    """The prototype of each language, from all rows that have text and lang and aren't held out.

    most: languages that there may be; more of them are an error.
    """
    ship(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", F.col("lang").cast("string").alias("lang"))

    def run(batches):
        p = Profiles.open(dimensions)
        total: dict[str, np.ndarray] = {}

        def sums():
            for name, c in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(c)], names=["lang", "dimension", "value"])

        for b in batches:
            lang = b.column(1).dictionary_encode()
            names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            for first, data, offsets in text_slices(pc.utf8_lower(b.column(0))):
                row, tri = p.trigrams(data, offsets)
                share = np.rint(WHOLE / np.maximum(np.bincount(row, minlength=len(offsets) - 1), SHORT))[row]
                present, of = np.unique(code[first : first + len(offsets) - 1][row], return_inverse=True)
                step = min(ROWS, max(1, CELLS // max(1, len(p.code))))
                for lo in range(0, len(present), step):
                    here = (of >= lo) & (of < lo + step)
                    made = p.bundled(of[here] - lo, tri[here], share[here], min(step, len(present) - lo), np.float64)
                    for k, v in zip(present[lo : lo + step].tolist(), made):
                        total[names[k]] = total.get(names[k], 0) + np.rint(v).astype(np.int64)
                if len(total) > ROWS:
                    yield from sums()
                    total.clear()
        yield from sums()

    summed = labelled.mapInArrow(trimmed(run), "lang string, dimension int, value long").groupBy("lang", "dimension").agg(F.sum("value").alias("value"))
    summed = cut(summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dimension", "value"))).alias("v")).select("lang", F.col("v.value").alias("v")), "prototypes")
    if summed.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages; prototypes go to every worker, so their number is bounded")
    out = {r.lang: np.array(r.v, np.float64) for r in summed.collect()}  # at most `most` rows
    discard(summed)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = 1024, carry: tuple[str, ...] = ("doc_id",), made: tuple[str, str] = (PRED, SCORE)) -> DataFrame:
    """The carried columns, and the predicted language and its score of every row, named as `made` says."""
    ship(docs.sparkSession)
    names = sorted(prototypes)
    unit = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-9) for n in names]).reshape(len(names), dimensions)
    shared = unit.mean(0) if len(names) > 1 else np.zeros(dimensions)
    shared = shared / max(np.linalg.norm(shared), 1e-9)
    own = unit - np.outer(unit @ shared, shared)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    kept = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{k}") for k, c in enumerate(carry)]  # names by place while in Python
    schema = T.StructType([*docs.select(*kept).schema, T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        p = Profiles.open(dimensions)
        for b in batches:
            for first, data, offsets in text_slices(pc.utf8_lower(b.column(len(carry)))):
                rows = len(offsets) - 1
                row, tri = p.trigrams(data, offsets)
                best, score = np.full(rows, -1), np.zeros(rows)
                for lo, hi in p.runs(row) if names else ():
                    some, of = np.unique(row[lo:hi], return_inverse=True)
                    v = p.bundled(of, tri[lo:hi], None, len(some), np.float32).astype(np.float64)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    rest = v - np.outer(v @ shared, shared)
                    best[some] = np.argmax(np.round(rest @ own.T / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-9), 12), axis=1)
                    score[some] = np.round(np.clip((v * unit[best[some]]).sum(1), 0.0, 1.0), 9)
                pred = pa.array([names[k] if k >= 0 else "und" for k in best.tolist()])
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(first, rows) for i in range(len(carry))), pred, pa.array(score)], names=schema.fieldNames())

    return docs.select(*kept, F.col("text")).mapInArrow(trimmed(run), schema).toDF(*carry, *made)


def op7_language_id(docs: DataFrame, dimensions: int = 1024) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    docs = fit_columns(docs, "doc_id", "text", "lang")
    out = predict(docs, learn(docs, dimensions), dimensions)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col(PRED).alias("lang_pred"), F.col(SCORE).alias("score"))


def identified(docs: DataFrame, least: float = 0.0, dimensions: int = 1024) -> DataFrame:
    """The documents that get a language, with a score of at least `least`; columns as they were, whatever their names."""
    pred, score = made = fresh(docs, PRED, SCORE)
    kept = predict(docs, learn(docs, dimensions), dimensions, tuple(docs.columns), tuple(made))
    return kept.where((F.col(pred) != "und") & (F.col(score) >= least)).select(*columns(docs))
