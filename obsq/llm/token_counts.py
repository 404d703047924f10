"""Token counts by a linear longest-match automaton (operator 8).

A word's pieces are those of greedy longest match: the longest vocabulary entry at its start, then, of the entries that
may go on within a word, the longest at each place that follows. A trie of both kinds of entries gets, for each node, a
failure link and the number of pieces that are popped when matching can't go on there, so one pass over a word's letters
counts its pieces; none is built. A word that can't be matched whole counts as one unknown token, and so does one of more
than `longest` letters where that is given; the query sets no such bound.

Words stand between white space. Equal words of a batch, compared byte by byte, are counted once, and a worker keeps the
counts of words that it has seen, by 128 bits of hash, up to a bound.

Defined cases: null and blank texts have no tokens; repeated rows are counted alike; an empty table gives no rows; very
long texts are counted whole; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from obsq.llm.common import U64, WHITE, distinct_spans, fit_columns, ship, span_hashes, text_slices, words_of


class LongestMatch:
    """count(word): the number of pieces, or 0 if the word can't be matched.

    first: entries that may begin a word; rest: those that may follow within one.
    """

    def __init__(self, first, rest) -> None:
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: a word's start, node 1: within a word
        self.ends = [False, False]
        for root, entries in ((0, first), (1, rest)):
            for entry in entries:
                if not entry:
                    continue
                at = root
                for c in entry:
                    if (to := self.next[at].get(c)) is None:
                        to = len(self.next)
                        self.next[at][c] = to
                        self.next.append({})
                        self.ends.append(False)
                    at = to
                self.ends[at] = True
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n  # -1: no way on
        queue = [0, 1]
        for at in queue:
            for c, to in self.next[at].items():
                queue.append(to)
                if self.ends[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:  # what is matched so far, less the pieces it begins with, must go on from a shorter match
                    z, popped = self.fail[at], self.popped[at]
                    while z >= 0 and c not in self.next[z]:
                        popped += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[to], self.popped[to] = self.next[z][c], popped
        # A link leads into the part for the inside of words only, whose links come from shallower nodes.

    def count(self, word: str) -> int:
        at, n = 0, 0
        for c in word:
            while (to := self.next[at].get(c)) is None:
                if self.fail[at] < 0:
                    return 0
                n += self.popped[at]
                at = self.fail[at]
            at = to
        while at != 1:
            if self.fail[at] < 0:
                return 0
            n += self.popped[at]
            at = self.fail[at]
        return n


@lru_cache(maxsize=4)
def sentence_pieces(path: str) -> LongestMatch:
    """The automaton of a sentencepiece file's ordinary pieces: those with the word mark begin a word, the others go on."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return LongestMatch([p[1:] for p in plain if p.startswith("▁")], [p for p in plain if not p.startswith("▁")])


class _Counts:
    """Counts of the words that this worker has seen, by their hash."""

    def __init__(self, path: str, longest: int | None, most: int = 500_000) -> None:
        self.machine, self.longest, self.most = sentence_pieces(path), longest, most
        self.keys, self.sure, self.values = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int32)
        self.new: dict[tuple[int, int], int] = {}

    def _count(self, word: str) -> int:
        return self.machine.count(word) if self.longest is None or len(word) <= self.longest else 0

    def _keep(self) -> None:
        """Words met since the last time join the sorted store, which is begun anew when it is full."""
        found = np.array(list(self.new), U64).reshape(-1, 2)
        keys, sure = np.concatenate((self.keys, found[:, 0])), np.concatenate((self.sure, found[:, 1]))
        values = np.concatenate((self.values, np.fromiter(self.new.values(), np.int32, len(self.new))))
        if len(keys) > self.most:
            keys, sure, values = (x[-min(len(self.new), self.most) :] for x in (keys, sure, values))
        order = np.argsort(keys)
        self.keys, self.sure, self.values, self.new = keys[order], sure[order], values[order], {}

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words, tokens, unknown words of each row."""
        rows = len(offsets) - 1
        start, end, row = words_of(data, offsets, WHITE)
        words = np.bincount(row, minlength=rows)
        if not len(start):
            return words, words, words
        distinct, at, which = distinct_spans(data, start, end)
        n = np.full(len(at), -1, np.int32)
        raw = data.tobytes()
        if distinct is None:
            n[:] = [self._count(raw[a:b].decode()) for a, b in zip(start.tolist(), end.tolist())]
        else:
            sure = span_hashes(data, start[at], end[at], 1)
            if len(self.keys):
                spot = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
                hit = (self.keys[spot] == distinct) & (self.sure[spot] == sure)
                n[hit] = self.values[spot[hit]]
            for k in np.flatnonzero(n < 0).tolist():
                key = int(distinct[k]), int(sure[k])
                if (v := self.new.get(key)) is None:
                    v = self.new[key] = self._count(raw[start[at[k]] : end[at[k]]].decode())
                n[k] = v
            if len(self.new) > max(50_000, len(self.keys) // 4):
                self._keep()
        each = n[which]
        return words, np.bincount(row, weights=np.maximum(each, 1), minlength=rows).astype(np.int64), np.bincount(row[each == 0], minlength=rows)


_OPEN: dict[tuple[str, int | None], _Counts] = {}


def token_counts(docs: DataFrame, vocabulary: str, longest: int | None = 200) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row. longest: letters of a word that is looked at; None: any number."""
    ship(docs.sparkSession)

    def run(batches):
        counts = _OPEN.get((vocabulary, longest)) or _OPEN.setdefault((vocabulary, longest), _Counts(vocabulary, longest))
        for b in batches:
            for first, data, offsets in text_slices(b.column(1)):
                words, tokens, unknown = counts.of(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(words)), pa.array(words), pa.array(tokens), pa.array(unknown)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return fit_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op8_token_counts(docs: DataFrame, vocabulary: str, longest: int | None = 200) -> DataFrame:
    return token_counts(docs, vocabulary, longest)
