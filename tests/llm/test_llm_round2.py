"""Findings on the second round."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
from docstrata.llm import langid, mixing, pii  # noqa: E402


def test_language_model_keeps_every_gram(spark):
    """Over 600,000 gram types: all are in the model, whatever their counts."""
    rng = random.Random(11)
    letters = {"aa": "abcdefghijklmnopqrstuvwxyz", "bb": "αβγδεζηθικλμνξοπρστυφχψω", "cc": "абвгдежзийклмнопрстуфхцчшщыьэюя"}
    rows, grams = [], set()
    for i in range(300):
        lang = sorted(letters)[i % 3]
        words = ["".join(rng.choices(letters[lang], k=9)) for _ in range(300)]
        rows.append((i, " ".join(words), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learnt = {r.doc_id for r in langid.learning_rows(docs).select("doc_id").collect()}
    for i, text, _ in rows:
        if i in learnt:
            for w in text.split():
                w = f"^{w}$"
                grams.update(w[max(0, b - k): b] for b in range(2, len(w) + 1) for k in range(1, 6))
    model = langid.train(docs)
    assert len(grams) > 600_000 and len(model.grams) == len(grams)
    got = {r.doc_id: r.lang_pred for r in langid.languages(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


@pytest.mark.parametrize("text,kind,part", [
    ("call plus 44 20 7946 0958", "phone", "plus 44 20 7946 0958"),
    ("plus four four 20 7946 0958", "phone", "plus four four 20 7946 0958"),
    ("+1 555 one two three 4567", "phone", "+1 555 one two three 4567"),
    ("+one 555 123 4567", "phone", "+one 555 123 4567"),
    ("192.168.zero.one", "ip", "192.168.zero.one"),
    ("card 4111 1111 1111 111one", "card", None),  # no word of its own
    ("card 4111 1111 1111 111-one", "card", "4111 1111 1111 111-one"),
    ("café (one two three four five six seven eight nine zero one two eight)", "card", "one two three four five six seven eight nine zero one two eight"),
    ("+fıve 555 123 4567", "phone", "+fıve 555 123 4567"),
])
@pytest.mark.parametrize("after", ["", " 日本語 é"])
def test_spelled_and_plain_numbers(text, kind, part, after):
    """One digit word, or a plus before digits, is a disguise, whatever else the text holds."""
    text += after
    base = pii.base_spans(text)
    added = pii.added_spans(text, base)
    assert [text[a:b] for a, b in added[kind]] == [part] * (part is not None) and not base[kind]


def test_mix_stage_passes_whole_texts(spark):
    """Texts keep every character; a source's words are within half a document of its target."""
    rng = random.Random(4)
    rows = [(i, "\n\t".join(f"{s}{i}  w{j}" for j in range(rng.randrange(1, 90))), s) for s in "abcdef" for i in range(40)]
    rows += [(1000, "one\n  line " * 4000, "g"), (None, "no\n  number", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "length(text) AS n_chars")
    texts = {(i, s): t for i, t, s in rows}
    out = corpus_pipeline.mix(spark, docs, "").collect()
    assert all(r.text == texts[r.doc_id, r.source] and r.n_chars == len(r.text) for r in out)
    targets = mixing.source_targets(docs.select("source", mixing.word_count(docs["text"]).alias("size"))).collect()
    for t in targets:
        longest = max(len(x.split()) for _, x, s in rows if s == t.source)
        words = sum(len(r.text.split()) for r in out if r.source == t.source)
        assert abs(words - t.target) <= longest / 2 + 1
