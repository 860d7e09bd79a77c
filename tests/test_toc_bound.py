"""The common-subsequence bound of the ratio."""

import difflib
import random

from docstrata.operators import toc as TOC


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
    return row[-1]


def _places(a):
    out = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def test_common_subsequence_and_no_match_lost():
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 90)))
        b = "".join(c for c in a if rng.random() > 0.1) if rng.random() < 0.6 else "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 90)))
        pairs.append((a, b or "a"))
        assert TOC.common_subsequence(_places(a), len(a), pairs[-1][1]) == _lcs(a, pairs[-1][1])
    got = TOC.ratios([a for a, _ in pairs], [b for _, b in pairs], 0.85)
    for (a, b), r in zip(pairs, got):
        want = difflib.SequenceMatcher(None, a, b).ratio() if a != b else 1.0
        assert r == want if want >= 0.85 else r < 0.85
    assert 0 < sum(r == 0.0 for r in got) < len(got)


def test_ratio_is_not_computed_where_the_bound_fails(monkeypatch):
    calls = []
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or 1.0)
    assert TOC.ratios(["abcdefgh"] * 2, ["hgfedcba", "abcdefgx"], 0.85) == [0.0, 1.0] and len(calls) == 1
