"""Substring deduplication on words with a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. Each partition
sketches its windows' anchors (see ``repeats``) in a count-min sketch; the
merged sketch overestimates how often a window occurs, and only windows
estimated to repeat are shuffled and grouped exactly, so none is lost. A
word goes when a repeated window that starts earlier elsewhere has the same
words as a window over it; windows are judged on the input.

Edge rows: null text has no words; documents shorter than a window keep all;
a null id sorts last; rows that repeat are one document given twice and come
back twice; an empty table gives an empty result; very long texts are
processed in overlapping blocks; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm import repeats
from docstrata.llm.common import binary_array, keyed, prefix_sums, range_hash, string_bytes, text_pieces, with_breaks, word_spans

WINDOW = 20
RULE = repeats.Rule(length=WINDOW, gram=8, bits=27, depth=2)


def plain_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words with one blank after each: bytes, starts, ends, row and place of each word."""
    data, offs = with_breaks(data, offs)
    starts, ends = word_spans(data)
    keep = np.zeros(len(data) + 1, np.int32)
    keep[starts] += 1
    keep[ends + 1] -= 1  # a word and what follows it
    keep = np.cumsum(keep[:-1]) > 0
    place = np.cumsum(keep) - 1
    data = data.copy()
    data[ends] = 32
    row = np.searchsorted(offs, starts, side="right") - 1
    first = np.searchsorted(starts, offs[:-1])
    return data[keep], place[starts], place[starts] + (ends - starts), row, np.arange(len(starts)) - first[row]


def _reader(rule: repeats.Rule):
    def read(batch: pa.RecordBatch) -> Iterator[repeats.Block]:
        lo = 0
        for piece in text_pieces(batch):
            data, starts, ends, row, place = plain_words(*string_bytes(piece.column("text")))
            yield from repeats.blocks(data, starts, ends, row + lo, place, rule.length)
            lo += piece.num_rows

    return read


def _windows(rule: repeats.Rule):
    def windows(data: np.ndarray, offs: np.ndarray, n: np.ndarray):
        """Windows of segments whose words have one blank between them."""
        blank = data == 32
        begin = np.zeros(len(data) + 1, bool)
        begin[1:] = blank
        begin[offs[:-1]] = True
        starts = np.flatnonzero(begin[: len(data)])
        stop = np.zeros(len(data) + 1, bool)
        stop[:-1] = blank
        stop[offs[1:]] = True
        ends = np.flatnonzero(stop[1:]) + 1
        base = np.searchsorted(starts, offs[:-1])  # first word of each segment
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        word = base[row] + k
        return starts[word], ends[word + rule.length - 1], row, k

    return windows


def _digits(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [range_hash(prefix_sums(data), starts, ends)]


def repeated_words(docs: DataFrame, rule: repeats.Rule = RULE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans: the word ranges (start, end) of each document that go."""
    rows = keyed(docs, id_col, text_col)
    return repeats.spans_of(rows, repeats.repeats(rows, rule, _reader(rule), binary_array, _windows(rule), _digits))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_pieces(batch):
            data, starts, ends, row, _ = plain_words(*string_bytes(piece.column("text")))
            cut = np.searchsorted(row, np.arange(piece.num_rows + 1))
            spans = piece.column("spans")
            words, removed, kept = [], [], []
            for i in range(piece.num_rows):
                a, b = int(cut[i]), int(cut[i + 1])
                gone = repeats.covered(b - a, spans[i].values if spans[i].is_valid else None)
                words.append(b - a)
                removed.append(int(gone.sum()))
                if not removed[-1]:
                    kept.append(data[starts[a]: ends[b - 1]].tobytes().decode() if b > a else "")
                else:
                    s, e = starts[a:b][~gone], ends[a:b][~gone]
                    mask = np.zeros(int(ends[b - 1]) + 2 - int(starts[a]), np.int32)
                    mask[s - starts[a]] += 1
                    mask[e + 1 - starts[a]] -= 1
                    part = data[starts[a]: ends[b - 1] + 1][np.cumsum(mask[:-1]) > 0]
                    kept.append(part.tobytes().decode().rstrip(" "))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame, rule: repeats.Rule = RULE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one blank)."""
    return repeated_words(docs, rule, id_col, text_col).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
