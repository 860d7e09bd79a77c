"""Operators against brute force, exact round trips and held-out accuracy."""

import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__ as entry  # noqa: E402
from docstrata.llm import common, exact, langid, minhash, packing, pii, repeats, substrings, suffixes, tokens, urls, vectors  # noqa: E402
from docstrata.llm.components import components  # noqa: E402
from llm_cases import copies_fixture  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute_repeats(rows, cut, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        t = cut(text)
        gone = [False] * len(t)
        for j in range(len(t) - length + 1):
            w = tuple(t[j: j + length])
            if w in seen:
                gone[j: j + length] = [True] * length
            seen.add(w)
        out[i] = [x for x, g in zip(t, gone) if not g]
    return out


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeated_words(spark, hot):
    """hot=3 deals anchors out over salts, which the last step has to join again."""
    rows, df = copies_fixture(spark)
    rule = repeats.Rule(length=9, gram=4, bits=16, depth=2, hot=hot)
    got = {r.doc_id: r.kept_text for r in substrings.without_repeats(df, rule).collect()}
    assert got == {i: " ".join(w) for i, w in brute_repeats(rows, str.split, 9).items()}


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeated_bytes(spark, hot):
    rows, df = copies_fixture(spark)
    rule = repeats.Rule(length=25, gram=12, bits=16, depth=1, hot=hot)
    got = {r.doc_id: (r.kept, r.n_removed, sum(x.end - x.start for x in r.removed)) for r in suffixes.without_repeats(df, rule).collect()}
    want = brute_repeats(rows, lambda t: t.encode(), 25)
    sizes = {i: len(t.encode()) for i, t in rows}
    assert got == {i: (bytes(k), sizes[i] - len(k), sizes[i] - len(k)) for i, k in want.items()}


def test_firsts_settles_equal_digits():
    """Ranges with equal digits and other bytes are told apart."""
    data = np.frombuffer(b"abcabdabcab", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11])
    same = np.zeros(4, np.uint64)
    assert repeats.firsts(data, starts, ends, [same]).tolist() == [0, 1, 0, 3]


def test_blocks_hold_every_window(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 7)
    at = np.arange(30)
    seen = [int(b.place[i]) for b in repeats.blocks(np.zeros(30, np.uint8), at, at + 1, at * 0, at, 5) for i in range(len(b.starts) - 4)]
    assert seen == list(range(26))


def brute_near(rows, words, percent):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets[i] = {tuple(w)} if 0 < len(w) < words else {tuple(w[k: k + words]) for k in range(len(w) - words + 1)}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("block", [4096, 4])
def test_near_documents(spark, block):
    """block=4 deals buckets out over blocks and pairs of blocks."""
    rng = random.Random(2)
    base = [[f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(4)]
    rows = []
    for i in range(140):
        w = list(base[i % 4])
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"W{rng.randrange(500)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_documents(df, block=block).collect()}
    assert got == brute_near(rows, 2, 80)


def test_near_documents_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in entry.queries()["op1_minhash_dedup"](spark, SF).collect()}
    assert got == brute_near(rows, 2, 80)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((3, 1 / 3), (40, 0.5), (2000, 0.8)):
        both = int(2 * n * share / (1 + share) + 0.5)
        hits = []
        for _ in range(30):
            x = rng.integers(1, 1 << 62, 2 * n).astype(np.uint64)
            sk = minhash.sketches(np.concatenate((np.sort(x[:n]), np.sort(np.concatenate((x[:both], x[n: 2 * n - both]))))), np.array([0, n, 2 * n]), 128)
            hits.append((sk[0] == sk[1]).mean())
            assert (sk != np.uint64(0xFFFFFFFFFFFFFFFF)).all()  # every coordinate fills
        assert abs(np.mean(hits) - both / (2 * n - both)) < 0.05


@pytest.mark.parametrize("options", [{}, {"digest_bytes": 1, "salt_rows": 2, "files_per_batch": 1}])
def test_exact_groups(spark, options):
    """A one-byte key makes most texts share a digest: full bytes decide."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(exact.EXACT_SQL)
    names = list(want.columns)
    got = {tuple(r[c] for c in names) for r in exact.exact_groups(docs, **options).collect()}
    assert got == set(want.fetchall())


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    comp = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == comp


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) \
                    or kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out[kind].append(m.span())
    return out


def test_plain_spans():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@+- (2.5@5") for _ in range(rng.randrange(30)))
        assert pii.base_spans(t) == plain_spans(t), t
    for text in (r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()):
        assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text,kind,part", [
    ("mail john [at] example [dot] com!", "email", "john [at] example [dot] com"),
    ("mail j\u043ehn@ex\u0430mple.com", "email", "j\u043ehn@ex\u0430mple.com"),
    ("mail a@exa\u200bmple.com", "email", "a@exa\u200bmple.com"),
    ("sue at mail dot example dot org", "email", "sue at mail dot example dot org"),
    ("dial plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
    ("host one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("card \uff14111 1111 1111 1111", "card", "\uff14111 1111 1111 1111"),
])
def test_disguised_spans(text, kind, part):
    base = pii.base_spans(text)
    added = pii.added_spans(text, base)
    assert [text[a:b] for a, b in added[kind]] == [part] and not base[kind]
    assert sum(map(len, added.values())) == 1


@pytest.mark.parametrize("text", ["look at example.com and wait", "the dot at the end. One, two, three.", "we met at noon dot", "5 [at] 6", "caf\u00e9 \u00e0 la carte"])
def test_clean_text_stays_clean(text):
    assert not any(pii.added_spans(text, pii.base_spans(text)).values())


def test_token_ids_are_the_tokenizers():
    enc = packing.encoder(packing.TOKENIZER)
    rng = random.Random(3)
    odd = ["a", "s", "t", "re", " ", "  ", "\n", "'", "'s", "'re", "'ll", "1", "\u00e9", "!", "\t", "\u00a0", "\x1c", "\x85", "\u00b2", "\u00df", "'v", "'d", "\u4e2d", "<|endoftext|>"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(14))) for _ in range(5000)]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    want = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    for got, e in zip(tokens.Encoder(common_path(), memo=2000).encode(texts), want):
        assert got.tolist() == e.ids


def common_path():
    import public_tokenizers

    return public_tokenizers.path(packing.TOKENIZER)


def test_pieces_join_to_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tok = packing.encoder(packing.TOKENIZER).tokenizer
    parts = defaultdict(list)
    total = Counter()
    for r in packing.packed(docs).collect():
        parts[r.doc_id].append((r.start, bytes(r.ids)))
        total[r.sequence_id] += r.length
    assert set(total.values()) <= {1 << i for i in range(11)}
    for i, text in [tuple(r) for r in docs.select("doc_id", "text").collect()]:
        ids = np.frombuffer(b"".join(b for _, b in sorted(parts[i])), "<u4").tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids + [0]


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 900) for _ in range(4000)]
    cost = Counter()
    for _, _, n, seq, _ in packing.assign(lengths):
        cost[seq] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [c for s, c in cost.items()]
    blind, room = Counter(), 0
    for n in lengths:  # the same documents one after the other
        while n:
            take = min(n, 1024 - room % 1024)
            blind[room // 1024] += packing.LINEAR * take + packing.QUADRATIC * take * take
            room += take
            n -= take
    assert np.std(full[:-10]) < 0.8 * np.std(list(blind.values()))


def test_digest_array_confirms_strings(tmp_path):
    """With one key for all strings only the stored strings tell them apart."""
    one = lambda s: 7
    urls.DigestArray.write(str(tmp_path / "x"), ["a", "bb", "c"], one)
    found = urls.DigestArray(str(tmp_path / "x"), one)
    assert (found.probe(["a", "bb", "c", "d", ""]) >= 0).tolist() == [True, True, True, False, False]
    assert sorted(found.probe(["a", "bb", "c"]).tolist()) == [0, 1, 2]


@pytest.mark.parametrize("key", ["op3_mix_sources", "op5_exact_dedup", "op7_url_filter"])
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[key](spark, SF)
    res = con.sql(entry.oracle_sql()[key])
    names = sorted(df.columns)
    assert sorted(res.columns) == names
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    at = [list(res.columns).index(c) for c in names]
    assert Counter(tuple(norm(r[c]) for c in names) for r in df.collect()) == Counter(tuple(norm(r[i]) for i in at) for r in res.fetchall())


@pytest.mark.parametrize("block", [2048, 8])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(3)
    hubs = rng.standard_normal((12, 32))
    rows = []
    for i in range(260):
        v = hubs[i % 12] + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.25, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, block=block).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    comp = np.arange(len(rows))
    for _ in range(len(rows)):
        comp = np.array([comp[m].min() for m in link])
    want = {i: (int(link[i].sum()) - 1, int(comp[i]), bool(comp[i] == i)) for i in range(len(rows))}
    found = sum(v[0] for v in got.values()) / sum(v[0] for v in want.values())
    assert found >= 0.99 and all(got[i][0] <= want[i][0] for i in want)
    if found == 1:
        assert got == want


def test_rotated_codes_are_unbiased():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signs, factors = vectors.encode(x, 256)
    est, error = vectors.estimates(signs, factors, x)
    off = ~np.eye(len(x), dtype=bool)
    gap = (est - x @ x.T)[off]
    assert abs(gap.mean()) < 0.005
    assert (np.abs(gap) <= 5 * np.broadcast_to(error[:, None], est.shape)[off]).all()


def test_language_models(spark):
    """Probabilities after a context sum to one; held-out documents are found."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    letters = sorted({c for r in docs.select("text").collect() for c in r.text.lower() if c.isalpha()} | {langid.END})
    known = [c for c in letters if langid.gram_key(c) in set(model.grams.tolist())]
    for context in ("^", "^th", "qu", "xzx"):
        context = context if context[0] == "^" else "^" + context
        total = np.zeros(len(model.langs))
        for c in known + ["\u1234"]:
            s = np.array([ord(x) for x in context + c])
            total += np.exp(model.log_probs(s, np.arange(len(s)))[-1])
        assert np.allclose(total, 1, atol=1e-3)
    rows = langid.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and not r.rejected for r in rows)


def test_foreign_text_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    foreign = "Съешь же ещё этих мягких французских булок да выпей чаю " * 20
    more = spark.createDataFrame([(10**9, foreign, None)], docs.schema)
    got = {r.doc_id: r.rejected for r in langid.languages(docs.unionByName(more)).collect()}
    assert got.pop(10**9) and not any(got.values())


def test_common_hashes():
    data = np.frombuffer(b"xxabcyyabczz", np.uint8)
    c = common.prefix_sums(data)
    h = common.range_hash(c, np.array([2, 7, 2]), np.array([5, 10, 4]))
    assert h[0] == h[1] != h[2]
    v = np.random.default_rng(1).integers(0, 99, 50)
    assert common.sliding_min(v, 7).tolist() == [v[i: i + 7].min() for i in range(44)]
