"""Personal data in texts, with offset-preserving deobfuscation (operator 6).

Base spans are the leftmost matches of four patterns in the text as it is, and those that fail a kind's test are dropped.
Then a chain of transducers rewrites the text, and each output letter keeps the source range it was made of: letters
that only look like ASCII become it and invisible ones vanish; spelled digits become digits; disguised at and dot signs
become signs. What the patterns find there, and is well-formed, is mapped back to source characters, and becomes a span if it was
disguised (its source isn't what was found) and no base span of its kind holds it. Base spans always stay.

Only texts with a sign of disguise go through the chain. Spelled digits count in runs of at least four, or as the numbers
of an address with three points, and a bare `at` only where a bare or bracketed `dot` follows a word later, so that prose
is left alone. Searching takes time in proportion to the text, whatever is in it.

Defined cases: null counts as empty and has no spans; repeated rows give equal results; an empty table gives no rows;
texts of any length are searched whole; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.llm.common import fit_columns, ship

# The base patterns, in the order in which kinds are listed.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

KINDS = ("email", "ip", "card", "phone")
# The same matches in time that grows with the text alone: a match begins where its first run of letters or digits
# does, and no run is given back.
_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(PHONE)
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Matches of EMAIL: for each @ the run of letters before it, as far as no match has taken it, and what follows."""
    done = 0
    if "@" not in text:
        return
    for m in _LOCAL.finditer(text):
        start = max(m.start(), done)
        if start < m.end() - 1 and (domain := _DOMAIN.match(text, m.end())):
            done = domain.end()
            yield start, done


def octet(digits: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    short = digits.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans of a text, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Letters of other scripts that look like ASCII ones, one below the other.
_LOOKS = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеорсухіјѕһԁԛԝҮΑΒΕΖΗΙΚΜΝΟΡΤΥΧοΡυνιαρ‐‑‒–—−․‧。．＠",
    "ABESIJKMHOPCTYXaeopcyxijshdqwYABEZHIKMNOPTYXoPuviap------....@",
)
_HIDDEN = frozenset("­​‌‍⁠﻿‎‏᠎")
# The words for digits.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SPELLED = re.compile(r"(?<![A-Za-z])(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9])(?:[ ,.\-]{0,2}(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9])(?![a-z]))+(?![A-Za-z])", re.I)
_PART = re.compile(r"zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9]", re.I)
# Four numbers of up to three digits, spelled or not, with a dot or a word or sign for one between them.
_NUMBER = r"(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9])(?:[ \-]?(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9])){0,2})"
_POINT = r"(?: dot |[ ]{0,3}[\[({<][ ]{0,2}(?:dot|\.)[ ]{0,2}[\])}>][ ]{0,3}|_dot_|\.)"
_OCTETS = re.compile(rf"(?<![A-Za-z0-9.]){_NUMBER}(?:{_POINT}{_NUMBER}){{3}}(?![A-Za-z0-9]|\.[0-9])", re.I)
_OCTET_PART = re.compile(rf"({_POINT})|(zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9])", re.I)
_PLUS = re.compile(r"(?<![A-Za-z])plus[ ]{0,2}(?=[0-9])", re.I)
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_AT = re.compile(rf"[ ]{{0,3}}{_OPEN}[ ]{{0,2}}(?:at|@)[ ]{{0,2}}{_SHUT}[ ]{{0,3}}|[ ]{{1,3}}-at-[ ]{{1,3}}|_at_", re.I)
_DOT = re.compile(rf"[ ]{{0,3}}{_OPEN}[ ]{{0,2}}(?:dot|\.)[ ]{{0,2}}{_SHUT}[ ]{{0,3}}|(?<=[A-Za-z0-9])_dot_(?=[A-Za-z0-9])", re.I)
_BARE = re.compile(r"(?<![A-Za-z0-9._%+@-])([A-Za-z0-9._%+-]+)( ?@ ?| at )([A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+)", re.I)
#: Found in every text without look-alikes that a pattern above would change.
_SIGNS = re.compile(
    r"(?i)\bdot\b|_dot_|[\[({<] {0,2}(?:dot|at|@|\.) {0,2}[\])}>]|[ _-]at[ _-]|@ | @|plus {0,2}[0-9]"
    r"|zero|one|two|three|four|five|six|seven|eight|nine|oh[ ,.\-]{0,2}(?:[0-9]|oh)|[0-9][ ,.\-]{0,2}oh"
)


@lru_cache(maxsize=1 << 16)
def _ascii(c: str) -> str:
    """The ASCII letter that a letter looks like or folds to, nothing for an invisible one, or else the letter itself."""
    if c in _HIDDEN:
        return ""
    if c >= "\x80":
        c = c.translate(_LOOKS)
        folded = unicodedata.normalize("NFKC", c) if c >= "\x80" else c
        c = folded if len(folded) == 1 and folded.isascii() else c
    return c


class Mapped:
    """A text and, for each of its letters, the range of the source that it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def letters(self) -> None:
        """Look-alikes become ASCII, compatibility forms fold, invisible letters vanish into the one before."""
        if self.text.isascii():
            return
        out, start, end = [], [], []
        for c, s, e in zip(self.text, self.start, self.end):
            if c >= "\x80" and not (c := _ascii(c)):
                continue
            out.append(c)
            start.append(s)
            end.append(e)
        self.text, self.start, self.end = "".join(out), start, end

    def rewrite(self, pattern: re.Pattern, to) -> None:
        """Replace matches by strings; each new letter stands for the whole match, or to() says (letter, from, until)."""
        out, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            made = to(m)
            if made is None:
                continue
            out.append(self.text[at : m.start()])
            start += self.start[at : m.start()]
            end += self.end[at : m.start()]
            for c, lo, hi in made:
                out.append(c)
                start.append(self.start[lo])
                end.append(self.end[hi - 1])
            at = m.end()
        if at:
            self.text = "".join(out) + self.text[at:]
            self.start, self.end = start + self.start[at:], end + self.end[at:]


def _digits(m: re.Match):
    parts = [(p.group().lower(), m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])]
    if len(parts) < 4 or all(p[0].isdigit() for p in parts):
        return None
    return [(_DIGITS.get(p, p), lo, hi) for p, lo, hi in parts]


def _octets(m: re.Match):
    """Digits and dots, if each number is at most 255 and something was disguised."""
    out, number = [], ""
    for p in _OCTET_PART.finditer(m[0]):
        c = "." if p[1] else _DIGITS.get(p[2].lower(), p[2])
        if c == "." and not octet(number):
            return None
        number = "" if c == "." else number + c
        out.append((c, m.start() + p.start(), m.start() + p.end()))
    return out if octet(number) and "".join(c for c, _, _ in out) != m[0] else None


def _sign(c: str):
    return lambda m: [(c, m.start(), m.end())]


def _dotted(m: Mapped) -> None:
    """Bare signs are rewritten only where an address comes of it: word at word dot word, with a dot that was disguised."""
    def made(x: re.Match):
        if x[2].strip().lower() == "at" and " dot " not in x[3].lower():
            # A dot made of several letters was in brackets or between underscores.
            if not any(c == "." and m.end[k] - m.start[k] > 1 for k, c in enumerate(x[3], x.start(3))):
                return None
        out = [(c, x.start(1) + k, x.start(1) + k + 1) for k, c in enumerate(x[1])]
        out.append(("@", x.start(2), x.end(2)))
        at = x.start(3)
        for k, part in enumerate(re.split(r"( dot |\.)", x[3], flags=re.I)):
            if k % 2:
                out.append((".", at, at + len(part)))
            else:
                out += [(c, at + i, at + i + 1) for i, c in enumerate(part)]
            at += len(part)
        return out

    m.rewrite(_BARE, made)


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows."""
    odd = not text.isascii() and any(c >= "\x80" and _ascii(c) != c for c in set(text))
    return rewritten(text, base) if odd or _SIGNS.search(text) else []


def rewritten(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same for any text, by the whole chain."""
    m = Mapped(text)
    m.letters()
    m.rewrite(_OCTETS, _octets)
    m.rewrite(_SPELLED, _digits)
    m.rewrite(_PLUS, _sign("+"))
    m.rewrite(_AT, _sign("@"))
    m.rewrite(_DOT, _sign("."))
    _dotted(m)
    if m.text == text:
        return []
    out = []
    for kind, s, e in find(m.text):
        lo, hi = m.start[s], m.end[e - 1]
        k = bisect_right(base, (kind, lo, len(text)))  # base spans of a kind lie apart, so only this one can hold it
        held = k and base[k - 1][0] == kind and hi <= base[k - 1][2]
        if text[lo:hi] != m.text[s:e] and not held:
            out.append((kind, lo, hi))
    return out


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) for the base patterns, and for them and what was disguised."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        def rows(spans):
            return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(spans)]

        for b in batches:
            base, every = [], []
            for text in b.column(1):
                t = text.as_py() or ""
                found = find(t)
                base.append(rows(found))
                every.append(rows(found + disguised(t, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(every, kind)], names=["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return fit_columns(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def op6_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_disguised."""

    def text(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = spans_of(docs)
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_disguised"))


def digest(spans) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
