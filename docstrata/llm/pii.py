"""Personal data in text: plain spans, and disguised ones found on a
normalised copy whose every character knows its place in the source.

Plain spans follow a fixed grammar (leftmost, not overlapping per kind;
a match that fails its test is dropped and not tried again). Then a chain
of transducers rewrites disguises: homoglyphs and compatibility forms
become ASCII, invisible characters go, spelled digits become digits, and
at / dot disguises become ``@`` and ``.``. A transducer emits edits (source
start, source end, replacement); applying them gives the normalised text
and, for each of its characters, the source range it stands for. The same
grammar runs on the normalised text; a span that an edit touched is mapped
back to source offsets and added unless it overlaps a plain one of its kind.

All scans are linear in the text, so that very long texts cost what their
length costs. One row per row of the input, nothing is shuffled: rows that
repeat are judged alike, null or empty text has no spans, a null id stays
null, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# The grammar of plain spans.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def find_emails(text: str) -> list[Span]:
    """Local part: the run of its characters left of each @; linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def find_ips(text: str) -> list[Span]:
    """Every four parts of a chain of dotted numbers are a match; parts over 255 drop it."""
    out = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i: i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find_cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text)
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def find_phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


FINDERS = dict(zip(KINDS, (find_emails, find_ips, find_cards, find_phones)))


def base_spans(text: str) -> dict[str, list[Span]]:
    return {k: f(text) for k, f in FINDERS.items()}


# --------------------------------------------------------------------------
# Transducers: each yields edits (start, end, replacement)

#: Letters of other scripts drawn like ASCII ones (others follow from NFKC).
LOOKALIKES = str.maketrans(
    "АВЕЗКМНОРСТУХаеорсухіјѕԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρτυ٠۰",
    "ABE3KMHOPCTYXaeopcyxijsdqwhlABEZHIKMNOPTYXoavptu00")
#: Characters without width.
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
#: Digit words.
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_folds: dict[str, str | None] = {}


def fold(ch: str) -> str | None:
    """ASCII stand-in of a character, '' for one without width, None if it stays."""
    if ch not in _folds:
        if ch in INVISIBLE:
            _folds[ch] = ""
        else:
            alike = ch.translate(LOOKALIKES)
            alike = alike if alike != ch else unicodedata.normalize("NFKC", ch)
            if unicodedata.category(ch) == "Nd":
                alike = str(unicodedata.digit(ch))
            plain = len(alike) == 1 and alike.isascii() and (alike.isalnum() or alike in "@.+-()_%")
            _folds[ch] = alike if plain and alike != ch else None
    return _folds[ch]


def homoglyph_edits(text: str) -> Iterator[tuple[int, int, str]]:
    if text.isascii():
        return
    odd = {c: f for c in set(text) if not c.isascii() and (f := fold(c)) is not None}
    if odd:
        for m in re.finditer("[" + "".join(map(re.escape, odd)) + "]", text):
            yield m.start(), m.end(), odd[m.group()]


_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
_SPELLED = re.compile(rf"\b{_DIGIT}(?:[\x20\t\n,-]{{1,3}}{_DIGIT})*\b", re.I)
_DIGIT_WORD = re.compile(_DIGIT, re.I)
_VALUE = {w: str(i) for i, w in enumerate(DIGIT_WORDS)}
#: Letters that re.I takes for i or s.
_ALIKE = str.maketrans("\u0130\u0131\u017f", "iis")
_PLUS = re.compile(rf"\bplus[\x20-]{{1,3}}(?={_DIGIT}\b|[0-9])", re.I)


def digit_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs of digit words become digits without gaps; ``plus`` before one a +."""
    for m in _SPELLED.finditer(text):
        at = m.start()
        for d in _DIGIT_WORD.finditer(text, *m.span()):
            yield at, d.end(), _VALUE[d.group().translate(_ALIKE).lower()]  # the gap before a digit goes with it
            at = d.end()
    for m in _PLUS.finditer(text):
        yield m.start(), m.end(), "+"


_WRAPPED = re.compile(r"[\x20\t]{0,4}(?:\[\s{0,4}(at|dot|@|\.)\s{0,4}\]|\(\s{0,4}(at|dot|@|\.)\s{0,4}\)|\{\s{0,4}(at|dot|@|\.)\s{0,4}\}|<\s{0,4}(at|dot|@|\.)\s{0,4}>)[\x20\t]{0,4}", re.I)
_PLAIN_DOT = re.compile(r"(?<=[A-Za-z0-9])[\x20\t]{1,4}dot[\x20\t]{1,4}(?=[A-Za-z0-9])", re.I)
#: A bare "at" counts only before a name followed by a disguised dot: "look at example.com" stays as it is.
_PLAIN_AT = re.compile(r"(?<=[A-Za-z0-9_])[\x20\t]{1,4}at[\x20\t]{1,4}(?=[A-Za-z0-9-]{1,63}[\x20\t]{0,4}(?:[\x20\t]dot[\x20\t]|[\[({<]\s{0,4}(?:dot|\.)\s{0,4}[\])}>]))", re.I)


def sign_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _WRAPPED.finditer(text):
        word = next(g for g in m.groups() if g).lower()
        yield m.start(), m.end(), "@" if word in ("at", "@") else "."
    for m in _PLAIN_DOT.finditer(text):
        yield m.start(), m.end(), "."
    for m in _PLAIN_AT.finditer(text):
        yield m.start(), m.end(), "@"


class Mapped:
    """A text whose characters stand for source ranges; edits compose. Without an edit there are no arrays."""

    def __init__(self, text: str):
        self.text = text
        self.starts: np.ndarray | None = None  # of the source range; ends, touched (by an edit) likewise

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        if self.starts is None:
            n = len(self.text)
            self.starts, self.ends, self.touched = np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)
        out, old, new, at = [], [], [], 0  # text; places in the text before: first and last of each character's range
        for a, b, word in sorted(edits):
            if a < at:
                continue
            out += (self.text[at:a], word)
            same = np.arange(at, a)
            old += (same, np.full(len(word), a))
            new += (same, np.full(len(word), b - 1))
            at = b
        out.append(self.text[at:])
        first, last = (np.concatenate((*x, np.arange(at, len(self.text)))) for x in (old, new))
        edited = np.concatenate([np.full(len(x), i % 2 == 1) for i, x in enumerate(out)])
        self.text = "".join(out)
        self.starts, self.ends, self.touched = self.starts[first], self.ends[last], self.touched[first] | edited


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of the normalised text, at their source offsets, that the plain grammar doesn't give."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    m = Mapped(text)
    for transducer in (homoglyph_edits, digit_edits, sign_edits):
        if edits := list(transducer(m.text)):
            m.apply(edits)
    if m.starts is None:
        return out
    for kind, find in FINDERS.items():
        plain = sorted(base[kind])  # they don't overlap: the last that begins before an end decides
        begins = [x for x, _ in plain]
        for a, b in find(m.text):
            s, e = int(m.starts[a]), int(m.ends[b - 1])
            if m.touched[a:b].any() or e - s != b - a:  # or a character without width went
                k = bisect_left(begins, e)
                if not (k and plain[k - 1][1] > s):
                    out[kind].append((s, e))
    return out


def render(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(7)]
        for text in b.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            more = added_spans(text, base)
            row = [len(base[k]) for k in KINDS]
            row += [hashlib.sha256(render(base).encode()).hexdigest(), render({k: base[k] + more[k] for k in KINDS}),
                    sum(map(len, more.values()))]
            for c, v in zip(cols, row):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                         names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain spans), base_sha256, spans (all), n_added (disguised ones)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                  "base_sha256 string, spans string, n_added long")
