"""Defined results of every operator and stage on odd rows and on empty tables."""

import hashlib
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
from docstrata.llm import exact, langid, minhash, mixing, packing, pii, substrings, suffixes, urls, vectors  # noqa: E402
from llm_cases import ROWS, edge_docs  # noqa: E402

OPERATORS = {
    "op1": lambda d: minhash.near_documents(d), "op2": lambda d: pii.personal_data(d), "op3": lambda d: mixing.mixture(d),
    "op4": lambda d: packing.packed(d), "op5": lambda d: exact.exact_groups(d), "op6": lambda d: substrings.without_repeats(d),
    "op9": lambda d: langid.languages(d), "op10": lambda d: suffixes.without_repeats(d),
}


@pytest.fixture(scope="module")
def docs(spark):
    return edge_docs(spark)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op9", "op10"])
def test_one_row_per_row(docs, name):
    got = Counter(r.doc_id for r in OPERATORS[name](docs).collect())
    assert got == Counter(r[0] for r in ROWS)


def test_near_documents(docs):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_documents(docs).collect()]
    assert got.count((1, 11, 1, True)) == 2  # a row given twice
    assert (2, 11, 1, False) in got  # case and white space don't count
    assert (4, 0, 4, True) in got and (5, 0, 5, True) in got and (6, 0, 6, True) in got
    assert (12, 1, 12, True) in got and (None, 0, None, True) in got
    assert {r[2] for r in got if r[0] in (8, 9)} == {8}


def test_exact_groups(docs):
    rows = exact.exact_groups(docs).collect()
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.doc_id for r in empty} == {4, 5, 6, None} and {(r.keep_id, r.group_size) for r in empty} == {(6, 4)}
    twice = [r for r in rows if r.doc_id == 1]
    assert sorted(r.kept for r in twice) == [False, True] and {r.group_size for r in twice} == {2}
    assert exact.without_copies(docs).columns == docs.columns
    assert exact.without_copies(docs).count() == sum(r.kept for r in rows)


def test_languages(docs):
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in langid.languages(docs).collect()}
    assert {(i, p) for i, p, _ in got if p == "und"} == {(4, "und"), (5, "und"), (6, "und"), (7, "und"), (None, "und")}
    assert all(h for i, _, h in got if i is None)
    assert langid.accepted(docs).columns == docs.columns


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.encode().split())
    want = {r.source: r.target for r in mixing.source_targets(
        docs.select("source", mixing.word_count(docs["text"]).alias("size"))).collect()}
    assert words == {s: round(t) for s, t in want.items() if t}


def test_pieces_cover_every_row(docs):
    rows = packing.packed(docs, limit=64, group=5000).collect()
    seqs = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64 and at & (at - 1) == 0  # a full sequence or a power of two: no padding
    assert sum(r.length for r in rows if r.doc_id in (4, 5)) == 2  # the end id alone


def test_substrings_of_odd_rows(docs):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.without_repeats(docs).collect()}
    assert {(9, 60_001, 60_000), (4, 0, 0), (1, 12, 0), (None, 5, 0)} <= got
    assert (10, 4000, 3999) in got  # one word over and over: the window at its second word repeats the first
    rows = suffixes.without_repeats(docs).collect()
    sizes = {(r.doc_id, r.n_bytes, r.n_removed) for r in rows}
    # the blank after the long text is in a string that the text has earlier
    assert {(9, len(ROWS[10][1]), len(ROWS[9][1]) + 1), (10, 8000, 7998), (None, 23, 0), (4, 0, 0)} <= sizes
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_takes_odd_and_empty_input(spark, docs, tmp_path, name, stage):
    for i, d in enumerate((docs, docs.limit(0))):
        d.write.parquet(str(tmp_path / str(i)))
        read = spark.read.parquet(str(tmp_path / str(i)))
        out = stage(spark, read, str(tmp_path))
        assert name == "pack" or out.columns == docs.columns
        assert (out.count() == 0) == bool(i)


def test_urls_and_vectors(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?y#z"), (None, "x://b.net"), (3, "x://b.net/?q")],
                                  "page_id long, url string").selectExpr("*", "'clash' AS rule", "'clash' AS host")
    got = {tuple(r) for r in urls.url_filter(pages).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"),
                   (None, "b.net", "", None, "allow"), (3, "b.net", "/", "net/", "block")}
    assert urls.url_filter(pages.limit(0)).count() == 0 and urls.url_filter(pages, rules=()).count() == 5
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [0.0, 0.0], 0), (5, [1.0, nan], 0),
            (6, None, 0), (7, [], 0), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 0), (10, [1.0, 0.0], 1), (None, [1.0, 0.1], 0), (11, [1.0, None], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' AS node", "'clash' AS emb")
    got = Counter(tuple(r) for r in vectors.near_vectors(v).collect())
    alone = [4, 5, 6, 7, 8, 9, 10, 11]
    want = Counter({(i, 0, i, True): 1 for i in alone})
    want.update({(1, 3, 1, True): 1, (2, 3, 1, False): 1, (3, 3, 1, False): 2, (None, 3, 1, False): 1})
    assert got == want
    assert vectors.near_vectors(v.limit(0)).count() == 0
