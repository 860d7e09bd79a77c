"""Tokeniser fertility, filter audit and spelling variants: brute force, odd rows, empty tables."""

import hashlib
import itertools
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

sys.path.insert(0, os.path.dirname(__file__))

from pyspark.sql import functions as F  # noqa: E402

from docstrata.llm import audit, bits, fertility, langid, minhash, mixing, packing, pii, substrings, suffixes, tokens, variants  # noqa: E402
from docstrata.llm.common import documents  # noqa: E402
from llm_cases import LONG, ROWS, edge_docs  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return edge_docs(spark)


# --------------------------------------------------------------------------
# Fertility


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a ", "b ", "cd ", "a\n", "\n\n", "\t#", "é ", "\xa0", "\x1c", "$%", "日本 "]) for _ in range(rng.randrange(120))), "x")
            for i in range(300)]
    rows += [(r[0], r[1], r[2]) for r in ROWS]
    got = fertility.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = Counter()
    for i, text, _ in rows:
        c = base_counts(text)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_windows_of_many_words():
    """Windows are told apart exactly, also where three numbers don't fit in one."""
    rng = random.Random(8)
    number = np.array([rng.randrange(4) * 3_000_000 for _ in range(4000)])
    row = np.sort(np.array([rng.randrange(50) for _ in range(4000)]))
    want = np.zeros(50, int)
    for r in range(50):
        want[r] = base_counts(" ".join(map(str, number[row == r])))[4]
    assert (fertility.repeated_words(number, row, 50) == want).all()
    assert (fertility.repeated_words(number // 3_000_000, row, 50) == want).all()


def test_token_measures_equal_the_vocabulary(spark):
    rows = documents(spark, SF).limit(40).collect()
    got = {r.doc_id: r for r in fertility.quality(documents(spark, SF)).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows:
        words = WORD.findall(r.text)
        ids = [i for w in words for i in sp.encode(w)]
        g = got[r.doc_id]
        assert math.isclose(g.chars_per_token_1, sum(map(len, words)) / len(ids))
        assert math.isclose(g.byte_share_1, sum(map(sp.is_byte, ids)) / len(ids))
        h = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
        assert math.isclose(g.evenness_1, h / math.log2(len(ids)) if len(ids) > 1 else 0.0, abs_tol=1e-9)


def test_bands_reject_what_a_language_does_not_write(spark):
    rng = random.Random(2)
    base = [r.text for r in documents(spark, SF).where("lang = 'en'").limit(150).collect()]
    words = [w for t in base for w in t.split()]
    rows = [(i, " ".join(rng.choices(words, k=120)), "en" if i % 2 else None) for i in range(400)]
    rows += [(1000, " ".join("".join(rng.choices("0123456789abcdef", k=9)) for _ in range(120)), "en"),
             (1001, " ".join("".join(rng.choices("☂♞⚗⛏", k=6)) for _ in range(120)), "en"),
             (1002, " ".join(f"{a} {b}" for a, b in zip(["the"] * 60, words[:60])), "en")]
    got = {r.doc_id: r for r in fertility.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(400))
    assert not got[1000].kept and "chars_per_token_1" in got[1000].outside
    assert not got[1001].kept and "byte_share_1" in got[1001].outside
    assert {got[i].grp for i in (0, 1)} == {"script Latin", "lang en"}


def test_memo_and_long_texts(spark, monkeypatch):
    """A memo of one word, blocks of a few bytes and words beyond the slice give the same measures."""
    words = fertility.Words([fertility.vocabulary(n) for n in fertility.VOCABULARIES])
    text = (" ".join(ROWS[9][1].split()[:900]) + "  \n").encode()
    whole = fertility.word_numbers(text, words)
    assert (fertility.word_numbers(text, words, block=16) == whole).all() and len(whole) == 900
    words.learn()
    n = len(words)
    assert all(len(e.view()) == n for e in words.ends)
    monkeypatch.setattr(fertility, "LONG_WORD", 8)
    cut = fertility.Words(words.vocabularies)
    cut[b"abcdefghijklmnopqrstuvwxyz"], cut[b"abc"]
    cut.learn()
    assert cut.chars.view().tolist() == [26, 3]
    assert cut.ends[0].view()[0] == sum(len(words.vocabularies[0].encode([x])[0]) for x in ("abcdefgh", "ijklmnop", "qrstuvwx", "yz"))


def test_scripts():
    assert [fertility.script(t) for t in ("abc", "", "été", "Ελληνικά abc", "русский текст", "日本の漢字漢字", "— ☃")] == [
        "Latin", "Latin", "Latin", "Greek", "Cyrillic", "Han", "Other"]


# --------------------------------------------------------------------------
# Audit


def brute_audit(rows, labels):
    least = {}
    big = 1 << 63
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", big), big if i is None else i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)), "E": least[t] < (big if i is None else i)}
        fails.append((part or "", {k for k in f if f[k]}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for k in range(5):
                before, letter = set(order[:k]), order[k]
                removed = [x for x in own if letter in x[1] and not x[1] & before]
                shapley[letter] += len(removed)
                out[part, "".join(order), k + 1] = [
                    sum(not x[1] & (before | {letter}) for x in own), len(removed), sum(letter in x[1] and bool(x[1] & before) for x in own),
                    sum(x[1] == {letter} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed), letter]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {(*k, *v) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(6)
    texts = ["", None, "one two", "ONE # two", " ".join(f"w{i}" for i in range(210)), "same " * 250, "A" * 9 + " b" * 300, " ".join(f"X{i}" for i in range(260)) + " |"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'clash' AS part", "'clash' AS mask", "'clash' AS n").repartition(3)
    out = audit.interactions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' AS good"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 3 * 600 and set(got) == brute_audit(rows, labels)
    assert dict(out.dtypes)["step"] == "int" and {t for c, t in out.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}


def test_audit_of_odd_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in audit.interactions(docs, labels).collect()}
    assert got == brute_audit([r[:3] for r in ROWS], [])
    assert audit.interactions(docs.limit(0), labels).count() == 0


def test_audit_of_many_parts(spark):
    """Over a million recursion rows would be made by 3,100 parts; 400 show that no part is lost."""
    d = spark.range(400).selectExpr("id AS doc_id", "'a # B' AS text", "concat('l', id) AS lang")
    out = audit.interactions(d, spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int"))
    assert out.count() == 400 * 600 and out.where("good_lost = 1").select("part").distinct().collect()[0][0] == "l3"
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


# --------------------------------------------------------------------------
# Variants


def brute_words(rows, every=31, letters=7, least=2):
    up = str.maketrans(variants.UPPER, variants.LOWER)
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(up)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= letters and n >= least}


def brute_forms(count, ratio=10):
    letters = sorted({c for w in count for c in w})
    form, near = {}, {}
    for w, n in count.items():
        s = {w[:i] + w[i + 1:] for i in range(len(w))}
        for c in letters:
            s |= {w[:i] + c + w[i:] for i in range(len(w) + 1)} | {w[:i] + c + w[i + 1:] for i in range(len(w))}
        s = [x for x in s if x in count and x != w]
        best = min(s, key=lambda x: (-count[x], x)) if s else None
        near[w], form[w] = len(s), best if best and count[best] >= ratio * n else None
    out = set()
    for w, n in count.items():
        r = w
        while form[r]:
            r = form[r]
        out.add((w, form[w], r, n, near[w], count[form[w]] if form[w] else None))
    return out


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_forms_equal_brute_force_over_ranges(spark, many_ranges):
    """Words that share long beginnings and ends, so that ranges begin inside a path; chains and ties."""
    rng = random.Random(1)
    count = {}
    for _ in range(900):
        w = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))
        count["aaaaaa" + w + rng.choice(["", "bbbbb", "ÿÿ"])] = rng.choice([2, 2, 2, 25, 300, 4000])
    count |= {"x" * 40_000: 2, "x" * 40_001: 30, "x" * 39_999 + "y": 2, "alone" * 3: 5}
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    got = [tuple(r) for r in variants.grouped(words).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    short = {w: n for w, n in count.items() if len(w) < 100}
    assert {r for r in got if len(r[0]) < 100} == brute_forms(short) and len(got) == len(count)
    assert any(r[1] and r[1] != r[2] for r in got)  # a chain
    long = {r[0]: r for r in got if len(r[0]) > 100}
    assert long["x" * 40_000] == ("x" * 40_000, "x" * 40_001, "x" * 40_001, 2, 2, 30)
    assert long["x" * 39_999 + "y"][4] == 1


def test_variants_equal_brute_force(spark, docs):
    table = documents(spark, SF)
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    rows += [(None, "Straßenbahn STRASSENBAHN straßenbahn \xd7multiply"), (None, None), (1, ""), (2, "shortly " * 4000 + "shortlly Shorttly")]
    got = variants.variants(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS word", "'clash' AS n", "'clash' AS at"))
    cols = ("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in got.select(*cols).collect()} == brute_forms(brute_words(rows))
    odd = {tuple(r) for r in variants.variants(docs).select(*cols).collect()}
    assert odd == brute_forms(brute_words([r[:2] for r in ROWS]))


def test_variants_of_empty_tables(spark, docs):
    assert variants.variants(docs.limit(0)).count() == 0
    assert variants.variants(docs.where("doc_id = 4")).count() == 0
    assert fertility.quality(docs.limit(0)).count() == 0


def test_long_text_of_one_word(spark):
    rows = [(1, LONG * 3, "en")]
    r = fertility.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).first()
    assert r.n_words == len(WORD.findall(LONG * 3)) and r.base_failed


# --------------------------------------------------------------------------
# Token ids, copies without an id, scored rows


def test_rank_file_gives_the_ids_of_the_tokenizer():
    """On strings of random tokens, whose merges compete, and of random letters."""
    enc = tokens.Encoder(public_tokenizers.path(packing.TOKENIZER))
    assert enc.ranked is not None
    rng = random.Random(12)
    parts = [t for t in (enc.tokenizer.decode([i]) for i in range(50_000)) if t and "\ufffd" not in t]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(30_000)]
    texts += ["".join(rng.choices("etaoinshrdlu \n'", k=rng.randrange(1, 40))) for _ in range(30_000)]
    want = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(enc.ids(t).tolist() == e.ids for t, e in zip(texts, want))
    other = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.ranked is None and other.ids("Some words").tolist() == other.tokenizer.encode("Some words", add_special_tokens=False).ids


def test_near_copies_without_an_id(spark):
    """Of a group one document stays, also where ids are null or shared by other texts."""
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(None, f"{text} end{i}") for i in range(6)] + [(5, f"{text} x"), (5, f"{text} y"), (7, "something else " * 10), (None, "also other " * 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS dk", "'clash' AS h")
    out = minhash.without_near_copies(d, words=5).collect()
    assert sorted(str(r.doc_id) for r in out) == ["5", "7", "None"] and all(r.dk == "clash" for r in out)
    nulls = d.where("doc_id IS NULL")
    assert sorted(r.text[:4] for r in minhash.without_near_copies(nulls, words=5).collect()) == ["also", "word"]


def test_pairs_at_the_threshold_link(spark):
    """Sets that share exactly four fifths, over and over: none is lost, and none below links."""
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(120):
        base = [f"g{g}w{i}" for i in range(91)]  # 90 shingles of two words
        at = rng.randrange(20, 60)
        # k words changed at the end: 90 - k shingles stay, of 90 + k in all
        for j, k in enumerate((0, 10, 11)):
            rows.append((g * 3 + j, " ".join(base[: 91 - k] + [f"n{g}.{j}.{i}.{at}" for i in range(k)])))
        want[g] = [g * 3, g * 3, g * 3 + 2]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_documents(d).collect()}
    assert all([got[g * 3 + j] for j in range(3)] == want[g] for g in want)


def test_bits_miss_no_key(spark):
    keys = spark.range(100_000).selectExpr("id", "cast(id % 7 as string) AS part")
    gone = keys.where("id % 3 = 0")
    left = bits.without(keys, ["id", "part"], gone)
    assert left.count() == 66_666 and left.where("id % 3 = 0").isEmpty()
    assert bits.without(keys, ["id", "part"], gone.limit(0)).count() == 100_000
    few = bits.bits_of(gone.selectExpr("xxhash64(id) AS h"))
    h = np.array([r.h for r in gone.selectExpr("xxhash64(id) AS h").collect()], np.int64)
    assert few.may_hold(h).all() and few.may_hold(np.arange(10 ** 6)).mean() < 0.05


def test_language_sample_and_verdicts(spark):
    """The learning rows are bounded by language; the pipeline's verdict is the query's."""
    d = documents(spark, SF)
    some = langid.learning_rows(d, rows=20).groupBy("lang").count().collect()
    assert len(some) == 4 and all(5 <= r["count"] <= 45 for r in some)
    rows = [(10_000, "zq xj qqq zzxx jjq vvk " * 30, "en", "a"), (10_001, None, None, None), (10_002, "12 34", "de", "b")]
    table = d.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    model, judge = langid.fitted(d)
    scored = langid.scored(table, model).select("doc_id", *[c.alias(k) for k, c in judge.columns(F.col("s")).items()])
    stay = {r.doc_id for r in scored.where("NOT rejected").collect()}
    loss, n = langid.losses_of(model, table.select("text").toArrow().column("text").combine_chunks())
    assert {i for i, gone in zip([r.doc_id for r in table.select("doc_id").collect()], judge.rejected(loss, n)) if not gone} == stay
    assert stay and not stay & {10_000, 10_001, 10_002}
    assert {r.doc_id for r in langid.accepted(table).collect()} == {r.doc_id for r in langid.languages(table).where("NOT rejected").collect()}


def test_one_long_document_does_not_decide_a_source(spark):
    """A document that does not fit is passed over, wherever it lies on the line."""
    rows = [(i, "w " * 100, "a") for i in range(199)] + [(500, "long " * 40_000, "a")] + [(1000 + i, "v " * 50, "b") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(d, whole=True)
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    for t in mixing.source_targets(d.select("source", mixing.word_count(F.col("text")).alias("size"))).collect():
        assert abs(words.get(t.source, 0) - t.target) <= 100
    assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 3


# --------------------------------------------------------------------------
# Production rules and plain formulas


def test_windows_of_twenty_words_equal_brute_force(spark):
    """The query's rule on its whole table."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, docs = {}, sorted((r.doc_id, WORD.findall(r.text or "")) for r in table.select("doc_id", "text").collect())
    want = {}
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k: k + 20]), (i, k)) != (i, k):
                gone[k: k + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(substrings.without_repeats(table)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 10_000


def test_strings_of_a_hundred_bytes_equal_brute_force(spark):
    table = documents(spark, SF)
    first, want = {}, {}
    for i, t in sorted((r.doc_id, (r.text or "").encode()) for r in table.select("doc_id", "text").collect()):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            if first.setdefault(t[k: k + 100], (i, k)) != (i, k):
                gone[k: k + 100] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(int)) == 1))
        want[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(suffixes.without_repeats(table)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_language_model_equals_the_formula(spark):
    """Interpolated Kneser-Ney by its recursion, over dictionaries."""
    rng = random.Random(21)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "abgzz"}
    rows = [(i, " ".join("".join(rng.choices(alphabets[x], k=rng.randrange(1, 7))) for _ in range(30)), x) for i, x in enumerate(sorted(alphabets) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs)
    learnt = {r.doc_id for r in langid.learning_rows(docs).select("doc_id").collect()}
    order, tables = langid.ORDER, {}
    for lang in alphabets:
        raw = Counter()
        for i, text, x in rows:
            if i in learnt and x == lang:
                for w in text.split():
                    w = f"^{w}$"
                    raw.update(w[max(0, e - order): e] for e in range(2, len(w) + 1))
        n = {order: Counter({g: c for g, c in raw.items() if len(g) == order})}
        for k in range(order - 1, 0, -1):  # distinct characters before, but counts where there can be none
            n[k] = Counter(g[1:] for g in n[k + 1]) + Counter({g: c for g, c in raw.items() if len(g) == k})
        tables[lang] = n
    symbols = len({g for n in tables.values() for g in n[1]})

    def p(lang, gram):
        if not gram:
            return 1 / (symbols + 1)
        n = tables[lang][len(gram)]
        ones, twos = (sum(c == x for c in n.values()) for x in (1, 2))
        d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
        own = [c for g, c in n.items() if g[:-1] == gram[:-1]]
        lower = p(lang, gram[1:])
        return max(n[gram] - d, 0) / sum(own) + d * len(own) / sum(own) * lower if own else lower

    texts = ["abc", "gfe cde", "zzz xyz", "a", "abcdeabcde", "qq"]
    loss, _ = langid.losses_of(model, pa.array(texts))
    for t, row in zip(texts, loss):
        for lang, got in zip(model.langs, row):
            want = -sum(math.log(p(lang, w[max(0, e - order): e])) for w in (f"^{x}$" for x in t.split()) for e in range(2, len(w) + 1))
            assert math.isclose(got, want, rel_tol=1e-4), (t, lang)


def test_added_spans_keep_off_plain_ones():
    """Against the plain test of every pair, on texts of many plain and disguised spans."""
    rng = random.Random(17)
    parts = ["a@b.example.com", "j0e at mail dot example dot com", "192.168.0.1", "one nine two dot one six eight dot zero dot one",
             "+44 20 7946 0958", "plus four four 20 7946 0958", "4111 1111 1111 1111", "userа@b.com", "words", "1１.2.3.4"]
    for _ in range(200):
        text = rng.choice([" ", ", ", "; "]).join(rng.choices(parts, k=rng.randrange(1, 25)))
        base = pii.base_spans(text)
        free = pii.added_spans(text, {k: [] for k in base})
        got = pii.added_spans(text, base)
        for k in base:
            assert got[k] == [(s, e) for s, e in free[k] if not any(s < y and x < e for x, y in base[k])]
