"""Packing token sequences: cost-balanced, without padding.

A document is its token ids and an end id. Full lengths of ``limit`` ids
are sequences of their own; what is left of the documents goes, longest
first, to the sequence of lowest cost that has room, and is cut where the
room ends. A piece of n ids costs ``linear * n + quadratic * n * n``: the
feed-forward and the attention work, attention staying inside a piece.
Sequences are opened with room for exactly the tokens at hand: as many of
``limit`` as fit, the rest in powers of two, which need no padding.

Scale. A task packs its own rows in groups of about ``GROUP`` tokens:
nothing is shuffled, memory is one group, a lost executor's rows are packed
again to the same result. A group leaves fewer than log2(limit) sequences
below the full length. Order the rows before (as the mix does) to decide
which documents may share a sequence; packing keeps them near.

Edge rows: null or empty text is the end id alone; a null id stays null;
rows that repeat are packed each on its own; very long texts become many
full sequences; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import text_pieces
from docstrata.llm.tokens import Encoder

LIMIT = 1024
END_ID = 0
GROUP = 1 << 20
TOKENIZER = "byte_bpe_50k.json"
#: Cost of a token, and of a pair of tokens of one piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 512

_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder of a public tokenizer file (a name there, or a path)."""
    if name not in _encoders:
        _encoders[name] = Encoder(name if "/" in name else public_tokenizers.path(name))
    return _encoders[name]


def capacities(total: int, limit: int) -> list[int]:
    """Rooms that add up to total: the limit, then falling powers of two."""
    rest = total % limit
    return [limit] * (total // limit) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def assign(lengths: list[int], limit: int = LIMIT, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences count from 0."""
    out = []
    seq = 0
    rests = []
    for d, n in enumerate(lengths):
        for k in range(n // limit):
            out.append((d, k * limit, limit, seq, 0))
            seq += 1
        if n % limit:
            rests.append((-(n % limit), d, n - n % limit))
    rooms = capacities(-sum(r[0] for r in rests), limit)
    used = [0] * len(rooms)
    # among equal costs the largest room first
    heap = [(0.0, -room, i) for i, room in enumerate(rooms)]
    heapq.heapify(heap)
    for n, d, start in sorted(rests):
        n = -n
        while n:
            cost, _, i = heapq.heappop(heap)
            take = min(n, rooms[i] - used[i])
            out.append((d, start, take, seq + i, used[i]))
            used[i] += take
            start += take
            n -= take
            if used[i] < rooms[i]:
                heapq.heappush(heap, (cost + linear * take + quadratic * take * take, used[i] - rooms[i], i))
    return out


def _packer(name: str, limit: int, group: int, linear: float, quadratic: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        base = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            pieces = assign([len(t) for t in tokens], limit, linear, quadratic)
            cols = list(zip(*pieces))
            data = [tokens[d][s: s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces]
            out = pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array([len(tokens[d]) for d in cols[0]], pa.int64()), pa.array([base + s for s in cols[3]], pa.int64()),
                 pa.array(cols[4], pa.int64()), pa.array(data, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            base += max(cols[3]) + 1
            ids.clear()
            tokens.clear()
            held = 0
            return out

        for batch in batches:
            for b in text_pieces(batch):
                for i, t in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                    ids.append(i)
                    tokens.append(np.append(t, np.uint32(END_ID)))
                    held += len(t) + 1
                if held >= group:
                    yield flush()
        if tokens:
            yield flush()

    return run


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, group: int = GROUP,
           linear: float = LINEAR, quadratic: float = QUADRATIC, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset,
    ids (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_packer(tokenizer, limit, group, linear, quadratic),
                           "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
