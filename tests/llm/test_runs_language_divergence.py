"""Periodic runs, language by compression and divergence of sources, against plain versions and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from tidemark.llm import divergence, language_id, periodic_runs
from tidemark.llm.queries import queries
from tests.llm.test_operators import AWKWARD, LONG, docs, words

SMALL = "/root/testdata/sf0.001"


def brute_runs(w):
    """(start, length, period) by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repeated(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.choice([0, 1, 2, 3]) if n else 0):
        a = rng.randrange(n)
        p, b = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
        for i in range(a + p, b):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("kinds", [1, 2, 3, 12])
def test_runs_against_brute_force(kinds):
    rng = random.Random(kinds)
    for _ in range(250):
        texts = [repeated(rng, rng.randint(0, 120), kinds) for _ in range(rng.choice([1, 3]))]
        starts = np.cumsum([0, *map(len, texts)])
        got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(np.array(sum(texts, []), np.int64), starts)), strict=True))
        assert got == [(s + o, s + o + n, q) for t, o in zip(texts, starts.tolist(), strict=False) for s, n, q in brute_runs(t)]


def test_runs_of_nested_periods():
    """A block inside a long stretch of one word, whose run of greater period shifts that stretch."""
    for block, times in itertools.product(("a b", "a a a a b", "a a a a a a a b", "a b a b a b c", "a a b a a b a a b c " * 5 + "d"), (4, 5, 9)):
        t = (block.split() * times) + ["x"] + ["a"] * 7
        ids = {w: i for i, w in enumerate(dict.fromkeys(t))}
        got = periodic_runs.find_runs(np.array([ids[w] for w in t], np.int64), np.array([0, len(t)]))
        assert [(s, e - s, q) for s, e, q in zip(*(x.tolist() for x in got), strict=True)] == brute_runs(t)


def test_successor_tree():
    rng = np.random.default_rng(5)
    v = rng.integers(0, 90, 300)
    tree = periodic_runs.SuccessorTree(v)
    left = rng.integers(0, 290, 80)
    right = left + rng.integers(1, 10, 80)
    bound = rng.integers(0, 140, 80)
    below = tree.below(left, right, bound)
    assert below.tolist() == [int((v[a:b] < x).sum()) for a, b, x in zip(left, right, bound, strict=True)]
    some = below < right - left
    got = tree.nth(left[some], right[some], below[some])
    assert got.tolist() == [int(min(x for x in v[a:b] if x >= c)) for a, b, c in zip(left[some], right[some], bound[some], strict=True)]


def test_collapse_awkward(spark):
    rows = [*AWKWARD, (7, "x " * 50 + "a b c " * 4 + "y", "en", "a", 1), (7, "x " * 50 + "a b c " * 4 + "y", "en", "a", 1)]
    got = periodic_runs.collapse_runs(docs(spark, rows).selectExpr("*", "doc_id AS RUNS")).collect()
    assert len(got) == len(rows) and {"fingerprint", "row", "one"} <= set(got[0].asDict()) and "RUNS" not in got[0].asDict()
    for r in got:
        w = words(r.text)
        runs = [tuple(x) for x in r.runs]
        assert r.n_words == len(w)
        if r.text != LONG:
            assert runs == brute_runs(w) and r.collapsed == brute_collapsed(w, runs)
    assert [(tuple(x.runs[0]), x.collapsed) for x in got if x.text == LONG] == [((0, 60_000, 1), "word")]
    assert [x.collapsed for x in got if x.text and x.text.startswith("x ")] == ["x a b c y"] * 2
    assert periodic_runs.collapse_runs(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1, 500])
def test_runs_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", block)
    texts = [[str(x).encode() for x in repeated(random.Random(i), 60, 3)] for i in range(40)]
    got = list(periodic_runs._work(texts))
    assert [g[0] for g in got] == [brute_runs(t) for t in texts]


def test_run_query(spark):
    got = {r.doc_id: r for r in queries()["op11_periodic_runs"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        w, h = words(r.text), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, x = brute_runs(w), got[r.doc_id]
        best = min(runs, key=lambda t: (-t[1] * 10**9 // t[2], t[0], t[2]), default=(None,) * 3)
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()


def test_language_is_the_shortest_code(spark):
    """Bits by plain calls, one text at a time; dictionaries from all pieces sorted by hash."""
    import xxhash

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fit(table)
    pieces, texts = defaultdict(set), Counter()
    rows = table.collect()
    for r in rows:
        data = language_id.plain_bytes(r.text)
        if data and r.lang is not None:
            texts[r.lang] += 1
            pieces[r.lang] |= {data[i : i + 1024] for i in range(0, len(data), 1024)}
    assert model == {k: (texts[k], b"".join(sorted(v, key=lambda p: xxhash.xxh64_intdigest(p) >> 1)[:32])) for k, v in pieces.items()}
    coders = {k: language_id.compressor(v) for k, (_, v) in model.items()}
    for r in language_id.predict_language(table, model).collect():
        data = language_id.plain_bytes(r.text)
        bits = {k: -np.log2(model[k][0] / sum(texts.values())) + 8 * sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for k, c in coders.items()}
        first, second = sorted((v, k) for k, v in bits.items())[:2]
        assert r.lang_pred == first[1] and abs(r.margin_bits - (second[0] - first[0])) < 1e-6
        assert abs(r.score - 1 / sum(2 ** ((first[0] - v) / 32) for v in bits.values())) < 1e-9 and r.rejected == (r.margin_bits < 24)


def test_language_frames_can_be_read_back(spark):
    model = language_id.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    content = model["en"][1]
    data = language_id.plain_bytes("The and of whatever stands there")
    frame = language_id.compressor(content).compress(data)
    back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    assert back.decompress(frame, max_output_size=1000) == data


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries()["op12_language_id"](spark, d).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98
    sure = [r for r in held if not r.rejected]
    assert len(sure) > 0.95 * len(held) and np.mean([r.lang_pred == truth[r.doc_id] for r in sure]) >= 0.99


def test_language_fit_does_not_depend_on_order(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert language_id.fit(table) == language_id.fit(table.repartition(7).sortWithinPartitions("n_chars").union(table.limit(0)))


def test_language_awkward(spark):
    table = docs(spark, [*AWKWARD, (8, "12 345 -- ²½", "en", "a", 1), (9, "日本語テキスト", None, "a", 1)])
    got = language_id.predict_language(table.selectExpr("*", "doc_id AS REJECTED"), language_id.fit(table)).collect()
    assert len(got) == len(AWKWARD) + 2 and "REJECTED" not in got[0].asDict() and "gone" in got[0].asDict()
    for r in got:
        letter = bool(r.text) and any(map(str.isalpha, r.text))
        assert r.lang_pred in ({"en", "fr"} if letter else {"und"}) and 0 <= r.score <= 1 and (letter or r.rejected)
    none = language_id.fit(docs(spark, []))
    assert none == {} and {r.lang_pred for r in language_id.predict_language(table, none).collect()} == {"und"}
    assert language_id.predict_language(docs(spark, []), none).count() == 0
    one = language_id.fit(docs(spark, [(1, "only one", "en", "a", 1)]))
    assert [(r.lang_pred, r.score, r.margin_bits, r.rejected) for r in language_id.predict_language(docs(spark, [(1, "what", "x", "a", 1)]), one).collect()] == [("en", 1.0, None, False)]


def brute_divergence(rows, min_docs=10, top=10):
    """The contract, in whole numbers of Python."""
    seen, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        n[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, c in seen[lang].items() if c >= min_docs]
        wide = Counter()
        for g in groups:
            if g[0] == lang:
                wide.update(n[g])

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        cost = lambda a, b: (a - b) ** 2 // (a + b)
        p, q = share(n[lang, source]), share(wide)
        pairs = []
        for other in groups:
            if other[0] == lang and other[1] != source:
                r = share(n[other])
                pairs.append((other[1], sum(cost(p[t], r[t]) for t in kept)))
        terms = [(t, cost(p[t], q[t])) for t in kept if n[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (item, v) in enumerate(items[:most])]
    return sorted(out)


def divergence_rows(seed, n=260):
    rng = random.Random(seed)
    sign = ["the", "The", "étè", "naïve", "日本", "a1b", "x_y", "co-op", "", "İx"] + [f"w{i}" for i in range(3)] + [c * 3 for c in "abcdefghijklmnop"]
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice([None, "", *[f"s{k}" for k in range(19)]])
        yield (None if i % 41 == 0 else " ".join(rng.choices(sign, k=rng.randint(0, 25))), rng.choice(["en", "en", "fr", None]), source)
    yield from [("rare words alone here", "de", "one"), (None, "de", "two"), ("", "it", "alone")]


@pytest.mark.parametrize(("rows_in_bucket", "side", "held"), [(1 << 18, 8, 300_000), (40, 2, 5)])
def test_divergence_against_plain_version(spark, monkeypatch, rows_in_bucket, side, held):
    monkeypatch.setattr(divergence, "BUCKET_ROWS", rows_in_bucket)
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = list(divergence_rows(1))
    table = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS value", "2 AS rank", "3 AS term", "4 AS block", "5 AS n").repartition(3)
    assert sorted(map(tuple, divergence.audit_sources(table).collect())) == brute_divergence(rows)


def test_divergence_awkward(spark):
    table = docs(spark)
    got = divergence.audit_sources(table, min_docs=1)
    assert sorted(map(tuple, got.collect())) == brute_divergence([(r[1], r[2], r[3]) for r in AWKWARD], min_docs=1)
    assert {(r.part, r.value) for r in divergence.audit_sources(table).collect()} == {("pair", 0)}
    assert divergence.audit_sources(docs(spark, [])).count() == 0


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(500):
        total, kinds = rng.randrange(10 ** rng.randint(0, 15)), rng.randrange(1, 10 ** rng.randint(1, 9))
        n = rng.randint(0, total)
        assert divergence.share(n, total, kinds) == 1 + 10**9 * (n + 2) // (total + 2 * kinds)
