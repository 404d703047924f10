"""Benchmark decontamination by spaced-seed hashing (operator 1).

Texts become lower-case words. A mask says which words of a window count; the hash of those, at every place of a
benchmark item, is joined with the same hashes of the documents. As a mask ignores some places, a hit survives words
that were swapped there, and with several masks hardly any run of mostly equal words gets by without one. Around a hit
the two texts are compared word by word along its diagonal, and the best stretch is kept: equal words count `MATCH`,
others `MISMATCH`. Stretches count that have at least `least` equal words (or the whole of a shorter item), and of whose
words at most a fifth differ. An item leaks into a document if one of them has at least `enough` equal words, however
long the item is, or if all of them together hold at least `cover` of the item's words.

Benchmark items with equal words are one, named by the smallest item_id. Before the join, hashes of documents pass a
bit table of the benchmark's hashes, of bounded size; what is left is words around hits. Neither side is broadcast
unless its written size is under a bound.

Defined cases: null or blank texts match nothing; items of fewer words than the masks count have one seed of all their
words, and are found whole; those of fewer than `least_item` words are left out, for uses where a phrase that clean text has
too must not count; repeated rows of documents give their
rows again; null ids are kept as they are; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.llm.common import U64, Bloom, constants, cut, fit_columns, mix, ship, signed, small, span_hashes, text_slices, words_of

#: 1: a word that counts, 0: one that is ignored. Each mask has six that count.
MASKS = ("111111", "11011011", "1100110011", "101011010001")
MATCH, MISMATCH = 1, -3
#: ASCII that isn't a letter or digit stands between words; other characters are part of them.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SALT = constants(32, 1234)


def words(column: pa.Array):
    """For runs of rows: (first row, rows, row of each word, hash of each word)."""
    for first, data, offsets in text_slices(pc.utf8_lower(column)):
        start, end, row = words_of(data, offsets, _BETWEEN)
        yield first, len(offsets) - 1, row, span_hashes(data, start, end)


def short(word: np.ndarray) -> np.ndarray:
    """The upper half of each hash: enough to compare words that are aligned, of which a leak needs several."""
    return (signed(word) >> 32).astype(np.int32)


def seeds(row: np.ndarray, word: np.ndarray, masks: tuple[str, ...] = MASKS):
    """(mask, places, hashes) of all windows that lie in one row."""
    for m, mask in enumerate(masks):
        n = len(mask)
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
        h = np.full(len(at), _SALT[16 + m], U64)
        for k, j in enumerate(i for i, c in enumerate(mask) if c == "1"):
            h += word[at + j] * _SALT[k]
        yield m, at, mix(h)


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the stretch with the highest score; it begins and ends with equal words."""
    if not same.any():
        return 0, 0, 0
    total = np.concatenate(([0], np.cumsum(np.where(same, MATCH, MISMATCH))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def stretches(same: np.ndarray, least: int):
    """(start, end, equal words) of stretches that lie apart, have `least` equal words and of which at most a fifth differ."""
    todo = [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if same[lo:hi].sum() < least:
            continue
        start, end, equal = best_stretch(same[lo:hi])
        start, end = lo + start, lo + end
        todo += [(lo, start), (end, hi)]
        if 5 * (end - start - equal) > end - start:  # its halves may do better
            other = start + np.flatnonzero(~same[start:end])
            k = int(other[len(other) // 2])
            todo += [(start, k), (k + 1, end)]
        elif equal >= least:
            yield start, end, equal


def _benchmark(bench: DataFrame) -> DataFrame:
    """item (its words' hash), item_id (the smallest with these words), words."""

    def run(batches):
        for b in batches:
            for first, rows, row, word in words(b.column(1)):
                n = np.bincount(row, minlength=rows)
                edge = np.concatenate(([0], np.cumsum(n)))
                place = np.arange(len(word)) - edge[row]
                key = np.zeros(rows, U64)
                np.add.at(key, row, mix(word + place.astype(U64) * _SALT[30]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, rows), pa.array(signed(mix(key + n.astype(U64)))), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(signed(word)))],
                    names=["item_id", "item", "words"],
                )

    made = fit_columns(bench, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long")).mapInArrow(run, "item_id long, item long, words array<long>").where(F.size("words") > 0)
    return made.groupBy("item").agg(F.min("item_id").alias("item_id"), F.first("words").alias("words"))


def leaks(docs: DataFrame, bench: DataFrame, least: int = 8, least_item: int = 6, cover: float = 0.3, masks: tuple[str, ...] = MASKS, around: int = 64, enough: int = 13) -> DataFrame:
    """doc_id, item_id, start, end, n_equal, n_item, coverage: the stretches of each item that leaks, without
    those that overlap a better one of the same item.

    start, end: places of words of the document. coverage: of the row's stretch alone. around: how many words beside hits are kept for the comparison; the
    longest item's length is used where that is more.
    """
    spark = ship(docs.sparkSession)
    items = cut(_benchmark(bench), "items").where(F.size("words") >= least_item)
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    reach = max(around, longest)
    usual, weight = len(masks), min(m.count("1") for m in masks)
    lengths = sorted(r.n for r in items.select(F.size("words").alias("n")).where(F.col("n") < weight).distinct().collect())  # fewer than a mask counts
    masks = (*masks, *("1" * n for n in lengths))

    def item_seeds(batches):
        for b in batches:
            lists = b.column(1).combine_chunks() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1)
            word = lists.flatten().to_numpy().view(U64)
            n = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            edge = np.cumsum(n) - n
            for m, at, h in seeds(row, word, masks):
                if m >= usual:  # for items of this length alone
                    own = n[row[at]] == len(masks[m])
                    at, h = at[own], h[own]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), b.column(0).take(pa.array(row[at])), pa.array((at - edge[row[at]]).astype(np.int32))], names=["seed", "item", "place"])

    known = cut(items.select("item", "words").mapInArrow(item_seeds, "seed long, item long, place int"), "seeds")
    count = known.count()
    bloom = Bloom.of(known.select("seed"), count)
    held = spark.sparkContext.broadcast(bloom.words)  # bounded by Bloom.MOST_BITS

    def windows(batches):
        table = Bloom(held.value)
        for b in batches:
            tag = uuid.uuid4().hex
            for first, rows, row, word in words(b.column(1)):
                n = np.bincount(row, minlength=rows)
                edge = np.cumsum(n) - n
                at, h = [], []
                for _, places, hashes in seeds(row, word, masks):
                    hit = np.flatnonzero(table.has(signed(hashes)))
                    at.append(places[hit])
                    h.append(hashes[hit])
                at, h = np.concatenate(at), np.concatenate(h)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                owner = row[at]
                # Hits that lie within reach of each other share a window.
                new = np.ones(len(at), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (np.diff(at) > 2 * reach)
                begin = np.flatnonzero(new)
                until = np.append(begin[1:], len(at))
                own = owner[begin]
                lo = np.maximum(at[begin] - reach, edge[own])
                hi = np.minimum(at[until - 1] + reach + 16, edge[own] + n[own])
                size = hi - lo
                cuts = np.concatenate(([0], np.cumsum(size)))
                take = np.repeat(lo - cuts[:-1], size) + np.arange(cuts[-1])
                hits = np.append(begin, len(at)).astype(np.int32)
                which = np.repeat(np.arange(len(begin)), until - begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{tag}-{k}" for k in (first + own).tolist()], pa.string()),
                        b.column(0).slice(first, rows).take(pa.array(own)),
                        pa.array(lo - edge[own]),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(short(word[take]))),
                        pa.ListArray.from_arrays(pa.array(hits), pa.array(signed(h))),
                        pa.ListArray.from_arrays(pa.array(hits), pa.array((at - lo[which]).astype(np.int32))),
                    ],
                    names=["source", "doc_id", "first", "words", "seeds", "places"],
                )

    near = fit_columns(docs, "doc_id", "text").mapInArrow(windows, "source string, doc_id long, first long, words array<int>, seeds array<long>, places array<int>")
    near = cut(near.withColumn("window", F.expr("uuid()")), "windows")
    hits = near.select("window", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("window", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at"))
    met = hits.join(small(known), "seed").select("window", "item", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    both = met.join(near.select("window", "source", "doc_id", "first", "words"), "window").join(small(items.select("item", "item_id", F.transform("words", lambda x: F.shiftright(x, 32).cast("int")).alias("item_words"))), "item")

    def verify(batches):
        for b in batches:
            out, places = [], []
            diagonal = b.column("diagonal").to_pylist()
            texts, tests = b.column("words"), b.column("item_words")
            for k, d in enumerate(diagonal):
                text, test = texts[k].values.to_numpy(), tests[k].values.to_numpy()
                lo, hi = max(0, -d), min(len(test), len(text) - d)
                if hi <= lo:
                    continue
                same = text[lo + d : hi + d] == test[lo:hi]
                for start, end, equal in stretches(same, min(least, len(test))):
                    out.append((k, lo + d + start, lo + d + end, equal, len(test)))
                    places.append((lo + start + np.flatnonzero(same[start:end])).tolist())
            if out:
                at, start, end, equal, n = map(np.array, zip(*out))
                first = b.column("first").to_numpy()[at]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(pa.array(at)) for c in names[:4]), pa.array(first + start), pa.array(first + end), pa.array(equal), pa.array(n), pa.array(places, pa.list_(pa.int32()))],
                    names=[*names[:4], "start", "end", "n_equal", "n_item", "places"],
                )

    def decide(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                n = row["n_item"]
                of = sorted(row["stretches"], key=lambda x: (-x["n_equal"], x["start"], x["end"]))
                if of[0]["n_equal"] >= min(enough, n) or len({p for x in of for p in x["places"]}) >= cover * n:
                    starts, ends = [], []
                    for x in of:  # the best first, and of the others those that lie apart from them
                        k = bisect_right(ends, x["start"])
                        if k == len(ends) or x["end"] <= starts[k]:
                            starts.insert(k, x["start"])
                            ends.insert(k, x["end"])
                            out.append((row["doc_id"], row["item_id"], x["start"], x["end"], x["n_equal"], n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "start", "end", "n_equal", "n_item"])

    names = ["source", "doc_id", "item", "item_id", "first", "diagonal", "words", "item_words"]
    found = both.select(*names).mapInArrow(verify, "source string, doc_id long, item long, item_id long, start long, end long, n_equal long, n_item long, places array<int>")
    pairs = found.groupBy("source", "item").agg(*(F.first(c).alias(c) for c in ("doc_id", "item_id", "n_item")), F.collect_list(F.struct("start", "end", "n_equal", "places")).alias("stretches"))
    bad = pairs.mapInArrow(decide, "doc_id long, item_id long, start long, end long, n_equal long, n_item long")
    return bad.withColumn("coverage", F.round(F.col("n_equal") / F.col("n_item"), 6))


def decontaminated(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The documents without those in which an item leaks; rows with a null doc_id stay."""
    bad = cut(leaks(docs, bench, **how).select("doc_id").where("doc_id is not null").distinct(), "leaks")
    return docs.join(small(bad), "doc_id", "left_anti").select(docs.columns)


def op1_decontaminate(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    return leaks(docs, bench, **how)
