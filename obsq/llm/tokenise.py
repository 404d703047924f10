"""Token ids of whole texts by a public tokenizer file, with each distinct piece of text encoded once per worker.

A byte-level BPE splits a text before its merges, and the ids of each part depend on that part alone. A part never
reaches over a single space or line feed that stands between other characters, nor from a letter to what is none, so
texts are cut there, equal cuts are found by hash within a batch and compared byte by byte, and only cuts that the worker
has not seen, by 128 bits of hash, go to the tokenizer: plain words straight to its merges, all else through its own split.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa

from obsq.llm.common import distinct_spans, span_hashes, text_slices

#: Bytes that are surely not white space: visible ASCII, and lead bytes of characters outside the blocks with white space.
_INK = np.zeros(256, bool)
_INK[0x21:0x7F] = True
_INK_LEAD = _INK.copy()
_INK_LEAD[[*range(0xC3, 0xE0), 0xE0, *range(0xE4, 0xF5)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ASCII_OTHER = ~_LETTER
_ASCII_OTHER[0x80:] = False
#: One part each, whatever stands beside it.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ſ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, others follow."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


_OPEN: dict[str, "Encoder"] = {}


class Encoder:
    """ids(): the ids of many texts as one array. The store of known cuts is bounded by `most` entries."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        self._empty()

    def _empty(self) -> None:
        self.size, self.pool, self.used = 0, np.zeros(1 << 16, "<u4"), 0
        # Sorted keys, their second hash, first id and count in the pool; each run under half of the one before.
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    @classmethod
    def open(cls, path: str) -> "Encoder":
        """One per worker process and file."""
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), "<u4", int(count.sum())), count

    def _encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(cuts)
        other = []
        for k, x in enumerate(cuts):
            if _WORD.fullmatch(x):
                out[k] = [t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(self.letters))]
            else:
                other.append(k)
        for k, e in zip(other, self.tokenizer.encode_batch_fast([cuts[k] for k in other], add_special_tokens=False)):
            out[k] = e.ids
        count = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((i for x in out for i in x), "<u4", int(count.sum())), count

    def _find(self, keys: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, count = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for known, check, at, n in self.runs:
            spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = (known[spot] == keys) & (check[spot] == sure)
            first[hit], count[hit] = at[spot[hit]], n[spot[hit]]
        return first, count

    def _add(self, keys: np.ndarray, sure: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(self.used + len(ids), "<u4")))
        self.pool[self.used : self.used + len(ids)] = ids
        run = (keys, sure, self.used + np.cumsum(count) - count, count)
        self.used += len(ids)
        self.size += len(keys)
        while self.runs and len(self.runs[-1][0]) < 2 * len(run[0]):
            both = tuple(map(np.concatenate, zip(self.runs.pop(), run)))
            order = np.argsort(both[0], kind="stable")
            run = tuple(x[order] for x in both)
        self.runs.append(run)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and how many each row has. data, offsets: as from text_slices()."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(rows, np.int64)
        raw = data.tobytes()
        if any(s in raw for s in self.special):  # these are taken out before the split
            return self._encode([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        before, here, after = data[:-2], data[1:-1], data[2:]
        cutting = np.zeros(len(data), bool)
        cutting[1:] = _LETTER[data[:-1]] & _ASCII_OTHER[data[1:]]
        line = (here == 0x0A) & _INK[before] & _INK[after]
        cutting[1:-1] |= ((here == 0x20) & (_INK_LEAD[after] | _INK[before])) | line
        cutting[2:] |= line
        cutting[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cutting)
        end = np.append(start[1:], len(data))
        distinct, at, which = distinct_spans(data, start, end)
        if distinct is None:
            return self._encode([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        if self.size + len(distinct) > self.most:
            self._empty()
        sure = span_hashes(data, start[at], end[at], 1)
        first, count = self._find(distinct, sure)
        if len(new := np.flatnonzero(first < 0)):
            ids, n = self._encode_cuts([raw[a:b].decode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())])
            first[new], count[new] = self.used + np.cumsum(n) - n, n
            self._add(distinct[new], sure[new], ids, n)
        first, count = first[which], count[which]
        total = np.cumsum(count)
        out = self.pool[np.repeat(first - (total - count), count) + np.arange(total[-1])]
        ends = np.concatenate(([0], total))[np.searchsorted(start, offsets)]
        return out, np.diff(ends)


def documents_ids(path: str, column: pa.Array, end_id: int = 0):
    """For runs of rows: (first row, ids with end_id after each row, how many each row has)."""
    encoder = Encoder.open(path)
    for row, data, offsets in text_slices(column):
        ids, count = encoder.ids(data, offsets)
        out = np.insert(ids, np.cumsum(count), end_id).astype("<u4", copy=False)
        yield row, out, count + 1


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
