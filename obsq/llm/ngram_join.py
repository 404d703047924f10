"""N-gram Jaccard self-join by PartEnum signatures (operator 3).

A document's set holds the hashes of its distinct word n-grams. Sizes are cut into bands so that two sets that are
similar enough lie in one band or in neighbouring ones; each set takes part in the instance of its band and of the next.
In an instance, the hash domain is parted into first-level parts of two halves each. Sets at a Hamming distance of k
differ twice or more in at most k/2 parts, so in each of the other parts they agree on one half: enumerating the subsets
that leave one half out gives signatures (what a set has in a half) of which such sets share one. There are a few parts
more than that takes, so that some signatures can be left out: those with the fewest elements, in an order that depends
on the signature alone, so that both sets still keep a shared one. What is left says enough to tell unlike sets apart.

Sets with a signature in common are compared exactly, unless a sketch shows that they differ in too much: it counts a set's
elements in bins, and the counts of two sets never differ by more than the sets do. Each is compared first with the member
of its group that shares most with others, then, where a group isn't yet one component, with the rest, in blocks. Elements
are made again for the sets that come that far. Copies of a set are one node from the start.

Defined cases: null or blank text has an empty set and is linked with nothing; a text with fewer words than n has its
whole word sequence as one element; repeated rows are copies of each other; a null doc_id keeps its row, and is the
component only if no document in it has an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.llm.common import LOWER, U64, WHITE, Bloom, constants, cut, discard, fit_columns, mix, release, ship, signed, small, span_hashes, text_slices, words_of
from obsq.llm.components import components

_SALT = constants(16, 77)


def _order(keys: list[tuple[np.ndarray, int]], last: np.ndarray) -> np.ndarray:
    """The order by keys of so many bits each, then by the 64-bit values `last`: as np.lexsort gives it but for ties of all.

    One integer holds the keys and the first bits of `last`, as sorting one column is several times faster; the rest of
    `last` is looked at where it could matter.
    """
    used = sum(bits for _, bits in keys)
    if used > 40:
        return np.lexsort((last, *(key for key, _ in reversed(keys))))
    whole, at = last >> U64(used), 64
    for key, bits in keys:
        at -= bits
        if bits:
            whole |= key.astype(U64) << U64(at)
    order = np.argsort(whole)
    whole, ends = whole[order], last[order]
    if ((whole[1:] == whole[:-1]) & (ends[1:] != ends[:-1])).any():
        return np.lexsort((last, *(key for key, _ in reversed(keys))))
    return order


def shingle_sets(column: pa.Array, n: int):
    """For runs of rows: (first row, rows, row of each element, element), elements distinct and ascending in each row."""
    for first, data, offsets in text_slices(column):
        rows = len(offsets) - 1
        start, end, row = words_of(data, offsets, WHITE)
        word = span_hashes(LOWER[data], start, end)
        have = np.bincount(row, minlength=rows)
        whole = np.zeros(0, np.int64)
        if len(word) >= n:
            whole = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        h = np.zeros(len(whole), U64)
        for j in range(n):
            h += word[whole + j] * _SALT[j]
        at = row[whole]
        head = np.cumsum(have) - have
        for k in range(1, n):
            short = np.flatnonzero(have == k)
            g = np.full(len(short), _SALT[8 + k], U64)
            for j in range(k):
                g += word[head[short] + j] * _SALT[j]
            h, at = np.concatenate((h, g)), np.concatenate((at, short))
        h = mix(h)
        order = _order([(at, rows.bit_length())], h)
        h, at = h[order], at[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        yield first, rows, at[keep], h[keep]


class Scheme:
    """Signatures for Jaccard similarity of at least num/den."""

    def __init__(self, num: int, den: int, spare: float = 0.12) -> None:
        self.num, self.den, self.spare = num, den, spare
        low, lows, highs = 1, [], []
        while low < 1 << 40:
            high = low * den // num
            lows.append(low)
            highs.append(high)
            low = high + 1
        self.low, self.high = np.array(lows), np.array(highs)

    def _distance(self, a, b):
        """The most in which similar sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def signatures(self, rows: int, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, signature) for sets given as by shingle_sets()."""
        size = np.bincount(at, minlength=rows)
        band = np.searchsorted(self.low, np.maximum(size, 1), "right") - 1
        widest = size * self.den // self.num
        out_row, out_key = [], []
        spread, content_of = mix(h + _SALT[14]), mix(h ^ _SALT[15])
        for step in (0, 1):
            g = band + step
            most = self._distance(self.high[g], self.high[g])
            own = self._distance(size, np.minimum(widest, self.high[g]))
            use = (size > 0) & (own > 0) & (widest >= self.low[g])
            extra = np.ceil(self.spare * (most + 1)).astype(np.int64)
            parts = most // 2 + 1 + extra
            keep = 2 * parts - (parts - own // 2 - 1)
            cells = np.where(use, 2 * parts, 0)
            base = np.cumsum(cells) - cells
            total = int(cells.sum())
            if not total:
                continue
            taken = np.flatnonzero(use[at])
            row = at[taken]
            cell = base[row] + (spread[taken] % cells[row].astype(U64)).astype(np.int64)
            count = np.bincount(cell, minlength=total)
            content = np.zeros(total, U64)
            np.add.at(content, cell, content_of[taken])
            owner = np.repeat(np.arange(rows), cells)
            place = np.arange(total) - base[owner]
            sig = mix(mix(content + count.astype(U64) * _SALT[1]) + g[owner].astype(U64) * _SALT[2] + place.astype(U64) * _SALT[3])
            fullest = int(count.max())
            order = _order([(owner, rows.bit_length()), (fullest - count, fullest.bit_length())], sig)
            kept = order[place < keep[owner]]  # owners are in order, so places are ranks
            out_row.append(owner[kept])
            out_key.append(sig[kept])
        if not out_row:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        return np.concatenate(out_row), np.concatenate(out_key)


def _set_keys(rows: int, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(at, minlength=rows)
    total = np.zeros(rows, U64)
    np.add.at(total, at, mix(h ^ _SALT[4]))
    return size, signed(mix(total + size.astype(U64) * _SALT[5]))


def _lists(rows_kept: np.ndarray, at: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """Values of some rows as a list column; at is ascending."""
    n = np.bincount(at, minlength=rows)
    first = np.cumsum(n) - n
    n = n[rows_kept]
    edge = np.concatenate(([0], np.cumsum(n)))
    take = np.repeat(first[rows_kept] - edge[:-1], n) + np.arange(edge[-1])
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(signed(values[take])))


#: Bins of the smallest sketches; those of the largest.
LEAST_BINS, MOST_BINS = 64, 4096


def sketches(rows_kept: np.ndarray, at: np.ndarray, h: np.ndarray, rows: int) -> pa.Array:
    """For some rows, how many elements fall into each of about half as many bins, a byte each; null if a byte can't hold it."""
    size = np.bincount(at, minlength=rows)
    bins = np.zeros(rows, np.int64)
    bins[rows_kept] = 1 << np.clip(np.ceil(np.log2(np.maximum(size[rows_kept], 2) / 2)), np.log2(LEAST_BINS), np.log2(MOST_BINS)).astype(np.int64)
    base = np.cumsum(bins) - bins
    taken = np.flatnonzero(bins[at])
    row = at[taken]
    place = base[row] + (mix(h[taken] ^ _SALT[13]) & (bins[row] - 1).astype(U64)).astype(np.int64)
    count = np.bincount(place, minlength=int(bins.sum()))
    over = np.zeros(rows, bool)
    over[np.repeat(np.arange(rows), bins)[count > 255]] = True
    values = [None if over[r] else count[base[r] : base[r] + bins[r]].astype(np.uint8).tobytes() for r in rows_kept.tolist()]
    return pa.array(values, pa.binary())


def sketch_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, the differences of two tables of sketches, the wider one folded: at most the sets' symmetric difference."""
    least = min(x.shape[1], y.shape[1])
    if x.shape[1] != y.shape[1]:
        x, y = (z.reshape(len(z), -1, least).sum(1, dtype=np.uint16) for z in (x, y))
    return (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64)


def coarse(table: np.ndarray) -> np.ndarray:
    """Sketches folded into the fewest bins, which all have, held at 255: distances of these are at most those of the sketches."""
    return np.minimum(table.reshape(len(table), -1, LEAST_BINS).sum(1, dtype=np.uint16), 255).astype(np.uint8)


def near_by_sketches(sketch: pd.Series, n: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs of rows (x, y) sizes n and sketches don't show to differ in too much; pairs without sketches stay.

    Coarse sketches go first, as they tell most pairs apart.
    """
    width = np.array([len(s) if s is not None else 0 for s in sketch])
    place, tables, folded = np.zeros(len(sketch), np.int64), {}, np.zeros((len(sketch), LEAST_BINS), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        place[of] = np.arange(len(of))
        tables[w] = np.frombuffer(b"".join(sketch.iloc[of]), np.uint8).reshape(len(of), w)
        folded[of] = coarse(tables[w])
    keep = np.zeros(len(x), bool)
    for lo in range(0, len(x), 2048):
        i, j = x[lo : lo + 2048], y[lo : lo + 2048]
        keep[lo : lo + 2048] = sketch_distance(folded[i], folded[j]) <= (n[i] + n[j]) * (den - num) // (den + num)
    keep |= (width[x] == 0) | (width[y] == 0)
    left = np.flatnonzero(keep & (width[x] > 0) & (width[y] > 0) & (np.maximum(width[x], width[y]) > LEAST_BINS))
    for w, v in {*zip(width[x[left]].tolist(), width[y[left]].tolist())}:
        rows = left[(width[x[left]] == w) & (width[y[left]] == v)]
        for lo in range(0, len(rows), 1024):
            some = rows[lo : lo + 1024]
            i, j = x[some], y[some]
            keep[some] = sketch_distance(tables[w][place[i]], tables[v][place[j]]) <= (n[i] + n[j]) * (den - num) // (den + num)
    return keep


class JaccardJoin:
    """The steps of the join over a table of documents; link() runs them."""

    #: Groups of at most FEW members give pairs; of larger ones, blocks of up to BLOCK are compared by sketches first.
    FEW = 4
    BLOCK = 512

    def __init__(self, docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> None:
        self.spark = ship(docs.sparkSession)
        self.docs, self.n, self.num, self.den = fit_columns(docs, "doc_id", "text"), n, num, den
        self.scheme = Scheme(num, den)
        self.written: DataFrame | None = None

    def sizes(self) -> DataFrame:
        """doc_id, n_shingles, node (null for an empty set), sketch, and text_key (a hash of the text) of every row."""
        n = self.n

        def run(batches):
            for b in batches:
                for first, rows, at, h in shingle_sets(b.column(1), n):
                    size, key = _set_keys(rows, at, h)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(first, rows), pa.array(size), pa.array(key, mask=size == 0), sketches(np.arange(rows), at, h, rows), b.column(2).slice(first, rows)],
                        names=["doc_id", "n_shingles", "node", "sketch", "text_key"],
                    )

        rows = self.docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
        return rows.mapInArrow(run, "doc_id long, n_shingles long, node long, sketch binary, text_key long")

    def rows(self) -> DataFrame:
        """sizes(), written once."""
        if self.written is None:
            self.written = cut(self.sizes(), "sizes")
        return self.written

    def _signatures(self) -> DataFrame:
        n, scheme = self.n, self.scheme

        def run(batches):
            for b in batches:
                for _, rows, at, h in shingle_sets(b.column(1), n):
                    _, key = scheme.signatures(rows, at, h)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key))], names=["key"])

        return self.docs.mapInArrow(run, "key long")

    def _hits(self, known: Bloom) -> DataFrame:
        """key, node of signatures that may have company."""
        n, scheme = self.n, self.scheme
        shared = self.spark.sparkContext.broadcast(known.words)  # bounded by Bloom.MOST_BITS

        def run(batches):
            bloom = Bloom(shared.value)
            for b in batches:
                for _, rows, at, h in shingle_sets(b.column(1), n):
                    row, key = scheme.signatures(rows, at, h)
                    hit = np.flatnonzero(bloom.has(key))
                    node, key = _set_keys(rows, at, h)[1][row[hit]], signed(key[hit])
                    order = np.lexsort((node, key))
                    key, node = key[order], node[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(node[new])], names=["key", "node"])

        return self.docs.mapInArrow(run, "key long, node long").distinct()

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """node, elements of the nodes in `wanted`, and few others; texts that aren't needed are passed over by their hash."""
        n = self.n
        texts = cut(self.rows().where("node is not null").groupBy("node").agg(F.min("text_key").alias("text_key")).join(wanted.hint("merge"), "node", "left_semi").select("text_key"), "texts")
        shared = self.spark.sparkContext.broadcast(Bloom.of(texts, texts.count()).words)  # bounded by Bloom.MOST_BITS

        def run(batches):
            bloom = Bloom(shared.value)
            for b in batches:
                some = b.column(0).filter(pa.array(bloom.has(b.column(1).to_numpy())))
                for _, rows, at, h in shingle_sets(some, n):
                    size, node = _set_keys(rows, at, h)
                    kept = np.flatnonzero(size > 0)
                    kept = np.sort(kept[np.unique(node[kept], return_index=True)[1]])
                    yield pa.RecordBatch.from_arrays([pa.array(node[kept]), _lists(kept, at, h, rows)], names=["node", "elements"])

        rows = self.docs.where("text is not null").select("text", F.xxhash64("text").alias("text_key"))
        return cut(rows.mapInArrow(run, "node long, elements array<long>").dropDuplicates(["node"]), "sets")

    def _near(self, pairs: DataFrame, light: DataFrame) -> DataFrame:
        """Pairs (a, b) without those that sizes and sketches show to differ in too much; no similar pair is left out."""
        num, den = self.num, self.den
        left, right = (light.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        both = both.where((den * F.least("na", "nb") >= num * F.greatest("na", "nb"))).select("a", "b", "na", "nb", "sa", "sb")

        def table(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
            off = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][rows]
            return np.lib.stride_tricks.sliding_window_view(np.frombuffer(column.buffers()[2], np.uint8), width)[off]

        def run(batches):
            for b in batches:
                most = (b.column(2).to_numpy() + b.column(3).to_numpy()) * (den - num) // (den + num)
                x, y = b.column(4), b.column(5)
                wide, high = (pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in (x, y))
                keep = (wide == 0) | (high == 0)
                for w, v in {*zip(wide[~keep].tolist(), high[~keep].tolist())}:
                    rows = np.flatnonzero((wide == w) & (high == v))
                    for lo in range(0, len(rows), 1024):
                        some = rows[lo : lo + 1024]
                        keep[some] = sketch_distance(table(x, some, w), table(y, some, v)) <= most[some]
                yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

        return both.mapInArrow(run, "a long, b long")

    def _similar(self, pairs: DataFrame, light: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that are similar enough."""
        pairs = cut(self._near(pairs, light), "near")
        release(self.spark)
        sets = self._sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        release(self.spark)
        left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        common = F.size(F.array_intersect("x", "y"))
        out = cut(both.where(self.den * common >= self.num * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
        discard(pairs, sets)
        release(self.spark)
        return out

    def _within(self, members: DataFrame, light: DataFrame) -> DataFrame:
        """Pairs of members(key, node, component, size) of larger groups that sizes and sketches don't tell apart.

        Each pair of blocks of a group is compared in a task of its own, and only what is left of it comes out.
        """
        num, den = self.num, self.den
        blocks = F.ceil(F.col("size") / self.BLOCK).cast("int")
        rows = members.select("key", "node", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("node", "key"), blocks.cast("long")).cast("int").alias("own"))
        rows = rows.join(light.hint("merge"), "node").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n_shingles", "sketch")

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            i, j = pdf["i"].iat[0], pdf["j"].iat[0]
            own, node, top, n = (pdf[c].to_numpy() for c in ("own", "node", "component", "n_shingles"))
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            open_ = top[a][:, None] != top[b][None, :]
            if i == j:
                open_ &= node[a][:, None] < node[b][None, :]
            open_ &= den * np.minimum(n[a][:, None], n[b][None, :]) >= num * np.maximum(n[a][:, None], n[b][None, :])
            x, y = np.nonzero(open_)
            x, y = a[x], b[y]
            keep = near_by_sketches(pdf["sketch"], n, x, y, num, den)
            return pd.DataFrame({"a": np.minimum(node[x], node[y])[keep], "b": np.maximum(node[x], node[y])[keep]})

        return rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")

    def links(self) -> DataFrame:
        """Enough links (a, b) between nodes to span every component of the similarity graph, and no others."""
        counted = cut(self._signatures().groupBy("key").count().where("count > 1").select("key"), "signatures")
        release(self.spark)
        held = cut(self._hits(Bloom.of(counted, counted.count())), "hits")
        # Of groups with the same members one is enough; members are told apart by 128 bits of hash.
        same = (F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(7, node))").alias("y"))
        groups = held.groupBy("key").agg(F.count("*").alias("size"), *same).where("size > 1")
        groups = groups.groupBy("size", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("times")).drop("x", "y")
        members = cut(held.join(groups.hint("merge"), "key"), "members")
        discard(counted, held)
        nodes = cut(members.select("node").distinct(), "nodes")
        light = cut(self.rows().select("node", "n_shingles", "sketch").join(small(nodes), "node", "left_semi").dropDuplicates(["node"]), "light")
        release(self.spark)
        score = members.groupBy("node").agg(F.sum(F.col("size") * F.col("times")).alias("score"))
        centre = members.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("m")).select("key", F.col("m.node").alias("centre"))
        tried = cut(members.join(centre, "key").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "tried")
        found = self._similar(tried, light)
        component = components(found)
        placed = members.join(component, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
        open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        rest = cut(placed.join(open_, "key"), "rest")
        a, b = rest.where(F.col("size") <= self.FEW).alias("a"), rest.alias("b")
        few = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        many = self._within(rest.where(F.col("size") > self.FEW), light)
        apart = cut(few.union(many).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"), "apart")
        release(self.spark)
        out = cut(found.union(self._similar(apart, light)), "links")
        self.figures = {x.cut_path.rsplit("/", 1)[1].split("-")[1]: x for x in (members, tried, found, rest, apart)}
        release(self.spark)
        return out

    def link(self) -> DataFrame:
        """doc_id, n_shingles, component_id (null for a null doc_id alone), node of every row."""
        docs, part = self.rows().select("doc_id", "n_shingles", "node"), components(self.links())
        nodes = docs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        top = nodes.join(part, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
        lowest = top.groupBy("component").agg(F.min("least").alias("component_id"))
        named = top.join(lowest, "component").select("node", "component_id")
        return docs.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node")


def op3_ngram_join(docs: DataFrame) -> DataFrame:
    return JaccardJoin(docs).link().select("doc_id", "n_shingles", "component_id")


#: The same in SQL: all pairs that share a shingle, and reachability over links.
ORACLE = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS g FROM t
), n AS (
    SELECT doc_id, len(g) AS n FROM s
), e AS (
    SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(g) AS x FROM s)
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), edges AS (
    SELECT a, b FROM l UNION SELECT b, a FROM l
), r(a, b) AS (
    SELECT a, b FROM edges UNION SELECT r.a, edges.b FROM r JOIN edges ON r.b = edges.a
), c AS (
    SELECT a, min(b) AS m FROM r GROUP BY a
)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(c.m, n.doc_id)) AS component_id FROM n LEFT JOIN c ON c.a = n.doc_id
"""
