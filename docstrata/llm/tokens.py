"""Token ids of whole texts by a public byte-level BPE.

The tokenizer's file has a rank file beside it, the same vocabulary for a much
faster encoder. Merges of a byte-level BPE are made in the order of the ids that
they give, so both give the same ids (tested on random strings of tokens and
letters). They could differ only in how a text is split before the merges, where
Unicode versions class a letter differently: texts with characters beyond U+024F,
and texts with a special token's string, go to the tokenizer itself, and so do
all where a vocabulary has no rank file or other ids there.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cached_property

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Characters of a text that may be remembered.
MEMO_CHARS = 512
#: Characters that the splitting pattern's classes may not agree on.
_RARE = re.compile("[ɐ-\U0010FFFF]")


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it can be seen, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _ranked(path: str, vocabulary: dict[str, int]) -> tiktoken.Encoding | None:
    """The encoder of the rank file beside a tokenizer's file, if there is one of the same ids."""
    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks_path):
        return None
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    letters = _byte_letters()
    if len(ranks) != len(vocabulary) or any(ranks.get(bytes(letters[c] for c in t)) != i for t, i in vocabulary.items()):
        return None
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """encode(texts): the ids of each text, without special tokens. ``memo``: texts that
    the slower tokenizer has cut and that are remembered (short ones repeat)."""

    def __init__(self, path: str, memo: int = 1 << 12):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = tuple(t["content"] for t in file["added_tokens"])
        self.ranked = _ranked(path, {t: i for t, i in file["model"]["vocab"].items() if t not in self.special})
        self.memo = memo
        self._known: dict[str, np.ndarray] = {}

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The tokenizer itself, read when the first text needs it."""
        return Tokenizer.from_file(self.path)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is not None and not _RARE.search(text) and not any(s in text for s in self.special):
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        if len(text) > MEMO_CHARS:
            return self._whole(text)
        if text not in self._known:
            if len(self._known) >= self.memo:
                self._known.clear()
            self._known[text] = self._whole(text)
        return self._known[text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(t) for t in texts]
