"""Each operator against a brute-force version, and on the cases that its docstring defines."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import embedding_dedup, line_dedup, lm_scoring, mixing, quality, secret_scan, sentencepieces, simhash, token_files, topk_search
from tidemark.llm.lattice import Lattices, Vocabulary, top_k_paths
from tidemark.llm.lattice import mix as mix_bits
from tidemark.llm.queries import oracle_sql, queries
from tidemark.llm.wavelet import WaveletMatrix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 60_000
AWKWARD = [
    (1, "The same long line of text here\nother\n" * 3, "en", "a", 1),
    (2, "  the SAME long line of text here\t\nunique to the second", "en", "a", 1),
    (3, "The same long line of text here", None, None, None),
    (3, "The same long line of text here", None, None, None),
    (4, None, "en", "b", None),
    (5, "", "en", "b", 0),
    (None, "The same long line of text here\nno id", "en", "a", 3),
    (6, LONG, "en", "b", 3),
    (7, "Çà et là \x1cİx é <|endoftext|> don't 'S 日本語テキスト   x²", "fr", "c", 1),
]


def docs(spark, rows=AWKWARD):
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Extra columns with the names of what operators add.
    return plain.selectExpr("*", "'x' AS row", "1 AS size", "2 AS fingerprint", "3 AS SCORE", "4 AS secrets", "5 AS n_lines", "6 AS gone", "7 AS src", "8 AS _one", "9 AS __seed", "10 AS one")


def words(text):
    return WORDS.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_line_dedup_awkward(spark):
    got = line_dedup.dedup_lines(docs(spark)).toPandas()
    assert len(got) == len(AWKWARD) and "fingerprint" in got
    by = {(r.doc_id, r.text): r for r in got.itertuples()}
    assert by[(3, "The same long line of text here")].n_dropped == 0  # the largest doc_id keeps it
    first = got[got.doc_id == 1].iloc[0]
    assert first.text == "other\nother\nother\n" and first.n_dropped == 3 and first.n_lines == 7 and first.n_chars == len(first.text)
    assert got[got.doc_id == 2].iloc[0].text == "unique to the second"
    assert got[got.doc_id == 4].iloc[0].n_lines == 1 and got[got.doc_id == 4].iloc[0].text == ""
    assert got[got.doc_id.isna()].iloc[0].text.startswith("The same")
    assert got[got.doc_id == 6].iloc[0].text == LONG
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_counts_documents_not_rows(spark):
    rows = [(1, "a line of twenty chars..\n" * 5, "en", "a", 1), (2, "a line of twenty chars..", "en", "a", 1), (2, "a line of twenty chars..", "en", "a", 1)]
    assert line_dedup.dedup_lines(docs(spark, rows)).agg({"n_dropped": "sum"}).first()[0] == 0


def brute_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append(("assign", *m.span()))
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def der(*parts):
    body = b"".join(bytes([t, len(v)]) + v for t, v in parts)
    return bytes([0x30, len(body)]) + body


def test_secrets_base_and_structure(spark):
    import base64
    import json

    key = der((0x02, b"\0"), (0x30, bytes([0x06, 3, 42, 1, 2])), (0x04, b"k" * 40))
    field = lambda *parts: b"".join(len(x).to_bytes(4, "big") + x for x in parts)
    public = field(b"ssh-ed25519", b"p" * 32)
    ssh = b"openssh-key-v1\0" + field(b"none", b"none", b"") + (1).to_bytes(4, "big") + field(public, b"r" * 64)
    b64 = lambda x: base64.b64encode(x).decode()
    jwt = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), json.dumps({"sub": 1}).encode(), b"s" * 32))
    text = f"é Token: 'abc' secret: token:abcdefgh API_KEY=abcdef AKIA{'Z' * 16} {'ab' * 12} {'ab' * 11}\n{b64(key)} {b64(ssh)} {jwt} {key.hex()}\n-----BEGIN PRIVATE KEY-----\n{b64(key)}\n-----END PRIVATE KEY-----\n{b64(key[:-1] + b'xx')} {b64(bytes(range(60)))}"
    got = secret_scan.find_secrets(text)
    assert [x for x in got if x[0] in ("assign", "access", "hex")] == brute_secrets(text)
    more = [k for k, _, _ in got if k not in ("assign", "access", "hex")]
    assert sorted(more) == sorted(["der", "ssh", "jwt", "der", "pem", "der"])  # the body of a PEM block is DER as well
    # What is no secret: a signature, a public key of either kind, a certificate's shape, a container that stops short.
    signature = der((0x02, b"r" * 32), (0x02, b"s" * 32))
    spki = der((0x30, bytes([0x06, 3, 42, 1, 2])), (0x03, b"\0" + b"p" * 40))
    cert = der((0x30, b"\x02\x01\x01"), (0x30, bytes([0x06, 3, 42, 1, 2])), (0x03, b"\0" + b"s" * 40))
    for data in (signature, spki, cert, public, ssh[:-4], der((0x02, b"n" * 60), (0x02, b"\1\0\1"))):
        for t in (b64(data), data.hex(), f"-----BEGIN PUBLIC KEY-----\n{b64(data)}\n-----END PUBLIC KEY-----", f"-----BEGIN PRIVATE KEY-----\n{b64(data)}\n-----END PRIVATE KEY-----"):
            assert not [x for x in secret_scan.find_secrets(t) if x[0] not in ("assign", "access", "hex")], t
    rsa = der(*[(0x02, b"\0" if i == 0 else b"k" * 4) for i in range(9)])
    sec1 = der((0x02, b"\1"), (0x04, b"k" * 32), (0xA0, bytes([0x06, 3, 42, 1, 2])))
    locked = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{b64(b'x' * 64)}\n-----END RSA PRIVATE KEY-----"
    assert [secret_scan.find_secrets(t)[-1][0] for t in (b64(rsa), b64(sec1), locked)] == ["der", "der", "pem"]
    import time

    begun = time.process_time()
    secret_scan.find_secrets("eyJ" * 400_000 + " " + "a." * 400_000)
    assert time.process_time() - begun < 5
    rows = secret_scan.scan_secrets(docs(spark)).toPandas()
    assert len(rows) == len(AWKWARD) and rows.secrets.map(len).sum() == 0
    assert secret_scan.scan_secrets(docs(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["AKIAAKIA" + "B" * 10 + "AKIA" + "C" * 5, "token=password=abcdef token = x", "passwd\"  =  \"a_b-c.d/e+f=", "ſecret: abcdefgh toKen:abcdefg", "0" * 23 + "g" + "f" * 24])
def test_secrets_base_edges(text):
    assert [x for x in secret_scan.find_secrets(text) if x[0] in ("assign", "access", "hex")] == brute_secrets(text)


def test_mixing_awkward_and_targets(spark):
    got = mixing.mix_sources(docs(spark)).toPandas()
    assert len(got) == len(AWKWARD)
    assert list(got[got.doc_id == 4]["size"]) == [0] and (got.taken <= 3 * got["size"]).all()
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", ["a", "b", "c", None][i % 4] if i % 3 else "a", 1) for i in range(3000)]
    one = mixing.mix_sources(docs(spark, rows)).toPandas()
    total = one["size"].sum()
    names = ["a", "b", "c", None]
    size = {n: one[one.source.isna() if n is None else one.source == n]["size"].sum() for n in names}
    weight = dict(zip(names, (1, 2, 3, 1)))
    capped = set()
    while True:  # reshare until none is above
        left = total - sum(3 * size[n] for n in capped)
        level = left / sum(weight[n] for n in names if n not in capped)
        over = {n for n in names if n not in capped and weight[n] * level > 3 * size[n]}
        if not over:
            break
        capped |= over
    for n in names:
        part = one[one.source.isna() if n is None else one.source == n]
        goal = 3 * size[n] if n in capped else weight[n] * level
        assert math.isclose(part.target.iloc[0], goal, rel_tol=1e-9) and part.source_size.iloc[0] == size[n]
        assert abs(part.taken.sum() - goal) <= part["size"].max()
    assert abs(one.taken.sum() - total) < 300
    again = mixing.mix_sources(docs(spark, rows).repartition(7)).toPandas()
    assert one.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    taken = mixing.take_mix(docs(spark, rows)).groupBy("doc_id").count().toPandas()
    copies = one[one.copies > 0].set_index("doc_id").copies
    assert dict(zip(taken.doc_id, taken["count"])) == copies.to_dict()
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_mixing_prefers_quality(spark):
    rows = [(i, ("good words here " if i % 2 else "b@d w#rds h$re ") * 5, "en", "a" if i < 2000 else "b", 1) for i in range(2400)]
    one = mixing.mix_sources(docs(spark, rows)).toPandas()
    part = one[(one.source == "a")]
    assert part[part.doc_id % 2 == 1].taken.sum() > 1.5 * part[part.doc_id % 2 == 0].taken.sum()


def test_mixing_buckets_stay_small(spark):
    from pyspark.sql import functions as F

    frame = spark.range(200_000).select(((F.rand(3) * (2**52 - 1)).cast("long") + 0.5).alias("n"), F.explode(F.array(F.lit(0.1), F.lit(1.0))).alias("w"))
    got = frame.select("w", mixing.key_bucket(F.col("n") / float(2**52), F.col("w")).alias("b")).groupBy("w", "b").count().toPandas()
    assert got["count"].max() < 0.01 * 200_000 and got.b.between(0, mixing.BUCKETS - 1).all()


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries()["op6_quality_classifier"](spark, d).toPandas().set_index("doc_id")
    labels = pd.read_parquet(f"{d}/labels.parquet").set_index("doc_id").quality
    held = [i for i in labels.index if got.held_out[i]]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == got.held_out[i] for i in labels.index)
    right = np.mean([got.predicted[i] == labels[i] for i in held])
    kept = np.mean([got.predicted[i] for i in held if labels[i] == 1])
    assert right > 0.97 and kept > 0.995
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_prior_needs_no_negatives():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        good = lambda n: rng.normal(1.5, 1, (n, 6))
        n = int(4000 * share)
        mixed = np.concatenate([good(n), rng.normal(-1.5, 1, (4000 - n, 6))])
        assert abs(quality.estimate_prior(good(3000), mixed) - share) < 0.06


def test_nnpu_minimises_the_plain_risk():
    rng = np.random.default_rng(2)
    p, u, prior = rng.normal(0.7, 1, (300, 4)), np.concatenate([rng.normal(0.7, 1, (200, 4)), rng.normal(-0.7, 1, (200, 4))]), 0.5
    fitted = quality.fit_nnpu(p, u, prior)

    def risk(w, b):
        loss = lambda x, sign: sum(math.log1p(math.exp(-sign * (sum((c - m) / s * k for c, m, s, k in zip(row, fitted["mean"], fitted["spread"], w)) + b))) for row in x) / len(x)
        return prior * loss(p, 1) + max(0.0, loss(u, -1) - prior * loss(p, -1))

    best = risk(fitted["w"], fitted["b"])
    for _ in range(40):
        step = rng.normal(0, 0.5, 5)
        assert risk(fitted["w"] + step[:4], fitted["b"] + step[4]) > best - 1e-3


def test_quality_features_against_plain_counts():
    text = "One two two.\nThree! four 55\n\nOne"
    got = quality.features(text.encode())
    kinds = lambda c: next((i for i, g in enumerate(quality._GROUPS) if c.encode() in g), None)
    pairs = collections.Counter((kinds(a), kinds(b)) for a, b in zip(text, text[1:]))
    for (a, b), n in pairs.items():
        assert math.isclose(got[a * quality._N + b], math.sqrt(n / len(text)), rel_tol=1e-5)
    shape = got[quality._N**2 :]
    words = text.split()
    assert math.isclose(shape[2], len(set(words)) / len(words), rel_tol=1e-6) and math.isclose(shape[8], 0.0, abs_tol=1e-6)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    for model in (None, quality.fit(docs(spark), labels)):
        assert quality.score_quality(docs(spark), model).where("score BETWEEN 0 AND 1").count() == len(AWKWARD)
    assert quality.fit(docs(spark, []), labels) is None and quality.fit(docs(spark), labels.limit(0)) is None
    assert quality.keep_quality(docs(spark), labels.limit(0)).columns == docs(spark).columns


def brute_fingerprint(text):
    w = WORDS.findall(fold(text))
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    if not parts:
        return 0
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_simhash_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = queries()["op7_simhash_near_dedup"](spark, d).toPandas()
    raw = pd.read_parquet(f"{d}/documents.parquet").set_index("doc_id").text
    fp = {i: brute_fingerprint(t) for i, t in raw.items()}
    assert all(int(r.fingerprint, 16) == fp[r.doc_id] and len(r.fingerprint) == 16 for r in got.itertuples())
    linked = [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4]
    assert dict(zip(got.doc_id, got.component_id)) == brute_components(fp, linked)


@pytest.mark.parametrize("hot", [1024, 3])
def test_simhash_links_planted(spark, monkeypatch, hot):
    """Chains at every distance, by pairs and by midpoints alike."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(40):
        x = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(6):
            fps.add(x)
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
    fps |= {0, 1 << 63, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from tidemark.llm.common import components

    comps = components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).toPandas()
    got = dict(zip(comps.node, comps.root))
    linked = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    want = brute_components(signed, linked)
    assert {s: got.get(s, s) for s in signed} == want


def test_simhash_awkward(spark):
    got = simhash.near_duplicates(docs(spark)).toPandas()
    assert len(got) == len(AWKWARD) and got[got.doc_id.isin([4, 5])].component_id.tolist() == [4, 4]
    kept = simhash.drop_near_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(3) == 1 and 5 not in ids and {1, 2, 3, 4, 6, 7} <= set(ids)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    # A doc_id with unrelated texts: each of its groups keeps a document.
    apart = [(5, "one two three four five six seven", "en", "a", 1), (5, "red green blue black white grey pink", "en", "a", 1), (7, "red green blue black white grey pink", "en", "b", 1)]
    assert sorted(r.text[:3] for r in simhash.drop_near_duplicates(docs(spark, apart)).collect()) == ["one", "red"]
    same = [(5, "one two three four five six seven", lang, "a", 1) for lang in ("fr", "de", "en")]
    assert [r.lang for r in simhash.drop_near_duplicates(docs(spark, same)).collect()] == ["de"]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    folder = token_files.new_folder(spark)
    token_files.write_token_files(docs(spark), path, folder, shard_ids=1000)
    got = token_files.read_token_files(spark, folder).orderBy("start").toPandas()
    want = [tok.encode(t or "", add_special_tokens=False).ids + [1] for _, t in sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in AWKWARD)]
    assert got.n_tokens.tolist() == [len(x) for x in want]
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    assert got.start.tolist() == np.cumsum([0, *map(len, want)])[:-1].tolist()
    flat = [i for x in want for i in x]
    token = want[0][0]
    assert token_files.count_token(spark, folder, token).agg({"occurrences": "sum"}).first()[0] == flat.count(token)
    assert token_files.locate_token(spark, folder, token).count() == flat.count(token)
    empty = token_files.new_folder(spark)
    token_files.write_token_files(docs(spark, []), path, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("text", ["it's I'LL 'tis x'", "a<|startoftext|>b<|ENDOFTEXT|>", "é é İ! ǅ ǅ ß ẞ Σς", "１２ ٣ ½²", "\x85x\xa0y​z \x1f", "...,,--a1b22", "नमस्ते 日本 한글", "🙂🙂a🙂"])
def test_word_encoder_is_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = token_files.encoder(path)
    ids, n = enc.encode([text.encode(), b"", (text + " " + text).encode()])
    tok = Tokenizer.from_file(path)
    want = [tok.encode(t, add_special_tokens=False).ids + [1] for t in (text, "", text + " " + text)]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == list(map(len, want))


def test_wavelet_rank_select():
    rng = np.random.default_rng(0)
    for n, k in ((0, 1), (1, 1), (7, 1), (1000, 2), (5000, 700), (4097, 50_000)):
        ids = rng.integers(0, k, n).astype(np.uint32)
        w = WaveletMatrix.loads(WaveletMatrix.build(ids).dumps())
        assert (w.decode() == ids).all()
        for i in rng.integers(0, n, 20).tolist() if n else []:
            t = int(ids[i])
            assert w.access(i) == t and w.count(t) == (ids == t).sum() and w.count(t, 0, i) == (ids[:i] == t).sum()
            assert w.select(t, int((ids[:i] == t).sum())) == i
        assert w.count(k + 5) == 0


def test_segmentations_follow_the_lattice():
    v = Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    text, n = "in the", 6000
    found = top_k_paths(Lattices(v), [text.encode()] * n, mix_bits(np.arange(n).astype(np.uint64)), 3)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not sp.is_byte(i)}

    def every(t):
        if not t:
            yield ()
        for k in range(1, len(t) + 1):
            if t[:k] in known:
                for rest in every(t[k:]):
                    yield (known[t[:k]], *rest)

    paths = list(every("▁in▁the"))
    w = np.array([sum(v.weight[i] for i in p) for p in paths])
    p = np.exp(w - np.logaddexp.reduce(w))
    lat = Lattices(v)
    first, second = collections.Counter(), collections.Counter()
    lat = Lattices(v)
    found = top_k_paths(lat, [text.encode()] * n, mix_bits(np.arange(n).astype(np.uint64)), 3)
    for row in found:
        ids = [tuple(lat.ids(x[3]).tolist()) for x in row]
        assert len(set(ids)) == 3 and row[0][0] >= row[1][0] >= row[2][0]
        first[ids[0]] += 1
        second[ids[1]] += 1
    after = [sum(p[i] * p[j] / (1 - p[i]) for i in range(len(p)) if i != j) for j in range(len(p))]
    for k, q in enumerate(paths):
        assert abs(first[q] / n - p[k]) < 0.025 and abs(second[q] / n - after[k]) < 0.025
    total = np.mean([sum(math.exp(x[1] - x[2]) for x in row) for row in found])
    assert abs(total - 1) < 0.02  # inclusion scores make the draws an unbiased sample


def test_segmentations_awkward(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepieces.sample_pieces(docs(spark), path, samples=3).toPandas()
    assert len(got) == len(AWKWARD)
    for r in got.itertuples():
        seen = {tuple(s["ids"]) for s in r.segmentations}
        assert len(seen) == len(r.segmentations) >= 1
        for s in r.segmentations:
            assert s["round_trip"] and s["n_pieces"] == len(s["ids"]) and s["log_inclusion"] <= 0
            assert sp.decode([int(i) for i in s["ids"]]) == (r.text or "")
    again = sentencepieces.sample_pieces(docs(spark).repartition(3), path, samples=3).toPandas()
    key = lambda d: sorted((str(r.doc_id), r.text or "", [tuple(s["ids"]) for s in r.segmentations]) for r in d.itertuples())
    assert key(got) == key(again)
    assert sentencepieces.sample_pieces(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("head", [150_000, 300, 0])
def test_lm_base_and_held_out(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", head)
    d = "/root/testdata/sf0.001"
    got = queries()["op3_lm_scoring"](spark, d).toPandas().set_index("doc_id")
    raw = pd.read_parquet(f"{d}/documents.parquet").set_index("doc_id").text
    tokens = {i: WORDS.findall(fold(t)) + [None] for i, t in raw.items()}
    c = collections.Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        r = got.loc[i]
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_tokens == len(t) and r.n_known == sum(c[x] > 0 for x in t)
        assert r.train_tokens == n and r.score < 0 and r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_lm_model_is_a_distribution_and_learns():
    from tidemark.llm import attention as A

    rng = np.random.default_rng(0)
    ids = np.tile(np.array([5, 6, 7, 8, 4], np.int64), 4000)
    counts = np.full(400, 50)
    model = A.start_model(np.bincount(ids, minlength=9))
    w, y, _ = A.to_blocks(ids, counts)
    before = A.log10_probabilities(model, A.distributions(model), w, y).sum()
    model = A.train(model, w, y, 0.02, 1, 3, batch=128)
    dist = A.distributions(model)
    assert A.log10_probabilities(model, dist, w, y).sum() > 0.5 * before
    every = [A.forward(model, dist, w[:4], np.full((4, A.STEP), t, np.int32))[0] for t in range(A.END, 9)]
    assert np.allclose(sum(every), 1, atol=1e-4)
    fast = A.log10_probabilities(model, dist, w[:9], y[:9])
    assert np.allclose(fast, np.log10(A.forward(model, dist, w[:9], y[:9])[0]).reshape(9, -1).sum(1), atol=1e-3)
    # What comes later changes no score: change the second half of a text.
    other = ids.copy()
    other[25:50] = rng.integers(4, 9, 25)
    w2, y2, _ = A.to_blocks(other, counts)
    a, b = (A.forward(model, dist, x, z)[0][:25] for x, z in ((w, y), (w2, y2)))
    assert np.allclose(a, b)


def test_lm_gradient_matches_differences():
    from tidemark.llm import attention as A

    ids = np.random.default_rng(2).integers(4, 12, 60)
    model = {k: v.astype(np.float64) for k, v in A.start_model(np.bincount(ids, minlength=12)).items()}
    w, y, _ = A.to_blocks(ids, np.array([25, 35]))
    dist = A.distributions(model).astype(np.float64)
    loss = lambda m: -np.log(A.forward(m, dist, w, y)[0]).sum() / 60
    _, c = A.forward(model, dist, w, y)
    g, _ = A.gradient(model, w, c)
    for name in ("query", "key", "value", "own", "bias", "share", "share0"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({k: v.copy() for k, v in model.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert math.isclose((loss(up) - loss(down)) / 2e-4, g[name][at], rel_tol=2e-2, abs_tol=1e-6), name


def test_lm_counts_and_learns_every_word(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(3)
    texts = {i: " ".join(f"w{x}" for x in rng.integers(0, 5000, 20_000)) for i in range(60)} | {60: "", 61: None}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", lm_scoring.held_out().alias("held_out"), "text")
    monkeypatch.setattr(lm_scoring, "KEPT_WORDS", 2000)  # the encoder starts anew many times
    encoded = lm_scoring.encoded_texts(frame, path).toPandas()
    mine = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10}
    ids, sizes = token_files.WordEncoder(path).encode([(t or "").encode() for t in mine.values()])
    got = collections.Counter()
    for r in encoded[encoded.held_out.isna()].itertuples():
        got.update(dict(zip(r.words, r.counts)))
    assert got == collections.Counter(w for t in mine.values() for w in (t or "").split())
    rows = encoded[encoded.held_out.notna()]
    assert len(rows) == len(texts)
    train = spark.createDataFrame(rows[rows.held_out == False][["ids"]], "ids binary")  # noqa: E712
    counts = lm_scoring.id_counts(train)
    assert np.array_equal(counts, np.bincount(ids))
    to, _, kinds = lm_scoring.model_ids(counts, 50_000)
    pairs = lm_scoring.pair_counts(train, to, len(kinds))
    assert pairs.sum() == len(ids) and np.array_equal(pairs.sum(0), kinds)
    fitted = lm_scoring.fit(train, 50_000)["model"]
    assert np.array_equal(fitted["pair"], pairs) and (fitted["mass"][kinds > 0].sum(1) > 0).all()
    # What the last component explains is no mass of the others.
    assert 0 < fitted["mass"].sum() < len(ids)


def test_lm_meets_each_word_once_a_batch():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [r[1] for r in AWKWARD] + ["a\x0bB\x0cc\r\n", " \t", "x\x1cy\x85z\u2003w A a", "the " * 5000]
    distinct, numbers, size = lm_scoring.cut_words(pa.array(texts, pa.string()))
    plain = [(t or "").encode().lower().split() for t in texts]
    assert [distinct[i] for i in numbers.tolist()] == [w for t in plain for w in (*t, b"\n")]
    assert size.tolist() == [len(t) + 1 for t in plain] and len(set(distinct)) == len(distinct)
    a, b = token_files.WordEncoder(path), token_files.WordEncoder(path)
    for got, want in zip(a.encode_numbered(distinct, numbers, size), b.encode_words(plain)):
        assert np.array_equal(got, want)
    assert list(a) == list(b)


def test_plain_pieces_have_the_tokenizers_ids(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, enc = Tokenizer.from_file(path), token_files.WordEncoder(path)
    monkeypatch.setattr(token_files, "KEPT_PIECES", 50)  # pieces are forgotten many times
    rng = np.random.default_rng(8)
    letters = np.array([c for c in map(chr, range(33, 0x260)) if not c.isspace()])
    for _ in range(40):
        words = ["".join(rng.choice(letters, rng.integers(1, 9))).lower() for _ in range(20)] + ["été", "ªº", "ǆx", "σς", "日本"]
        words = [w for w in words if w.isalpha()]
        ids, size = enc.encode([w.encode() for w in words], end=None)
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [whole.encode(w, add_special_tokens=False).ids for w in words]
    assert token_files._plain("été") and not token_files._plain("É") and not token_files._plain("日本")


@pytest.mark.parametrize("width", [1, 16, 31, 32])
def test_lm_add_rows(width):
    from tidemark.llm import attention as A

    rng = np.random.default_rng(6)
    index, rows = rng.integers(0, 9, (300, 2))[:, 0], rng.normal(size=(300, width)).astype(np.float32)
    want = np.stack([rows[index == i].sum(0) for i in range(12)])
    assert np.allclose(A.add_rows(index, rows, 12), want, atol=1e-4)


def test_lm_learner_takes_every_window(monkeypatch):
    from tidemark.llm import attention as A

    monkeypatch.setattr(A.Learner, "BLOCK", 7)
    ids = np.random.default_rng(4).integers(4, 40, 3000)
    w, y, _ = A.to_blocks(ids, np.array([1000, 1, 1999]))
    model = A.start_model(np.bincount(ids, minlength=40))
    whole, again = A.Learner(model, 0.0), A.Learner(model, 0.0)
    whole.learn(w, y)
    for lo in range(0, len(w), 50):
        again.learn(w[lo : lo + 50], y[lo : lo + 50])
    assert whole.windows == again.windows == len(w) and np.allclose(whole.mass, again.mass, rtol=1e-3)
    _, c = A.forward(model, A.distributions(model), w, y, 1.0)
    _, resp = A.gradient(model, w, c)
    assert np.allclose(whole.mass.sum(), resp[:, : A.MIX].sum(), rtol=1e-3)


def test_lm_learner_moves_by_every_window(monkeypatch):
    """Each block's step has the gradient of all of its windows, whatever pieces it goes through in; ids of any block move."""
    from tidemark.llm import attention as A

    monkeypatch.setattr(A.Learner, "BLOCK", 40)
    monkeypatch.setattr(A.Learner, "PIECE", 9, raising=False)
    ids = np.concatenate([np.arange(4, 304), np.random.default_rng(4).integers(4, 304, 2000)])
    w, y, _ = A.to_blocks(ids, np.array([300, 1, 1000, 999]))
    model = A.start_model(np.bincount(ids, minlength=304))
    learner = A.Learner(model, 0.0)
    got = learner.gradient(w[50:90], y[50:90])  # begins and ends within texts
    _, c = A.forward(model, learner.dist, w[50:90], y[50:90], 1.0)
    want, _ = A.gradient(model, w[50:90], c)
    at = {"key": slice(0, A.KEY), "value": slice(A.KEY, A.HEARD - 1), "query": slice(A.HEARD, A.HEARD + A.KEY), "own": slice(A.HEARD + A.KEY, -1)}
    got |= {k: got["rows"][:, s] for k, s in at.items()} | {"share": got["share"][:-1], "share0": got["share"][-1]}
    for k in A.LEARNT:
        assert np.allclose(got[k], want[k], rtol=1e-3, atol=1e-7), k
    monkeypatch.setattr(A.Learner, "BLOCK", 2)
    learner = A.Learner(model, 0.01)
    learner.learn(w[:37], y[:37])  # ids 4 to 299, once each
    moved = (learner.model["own"] != model["own"]).any(1)
    assert moved[4:299].all() and learner.windows == 37


def test_lm_awkward(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = lm_scoring.score_texts(docs(spark), path).toPandas()
    assert len(got) == len(AWKWARD) and (got.score < 0).all()
    assert got[got.doc_id == 4].n_tokens.tolist() == [1] and got[got.doc_id == 6].n_tokens.tolist() == [60_001]
    assert lm_scoring.score_texts(docs(spark, []), path).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links string")


def test_embedding_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        if i % 3 and rows and rows[-1][1]:
            x = np.array(rows[-1][1]) + rng.normal(0, 0.02, 32)
        else:
            x = rng.normal(0, 1, 32)
            x /= np.linalg.norm(x)
        rows.append((i, x.tolist(), int(i) // 500 % 2, "z"))
    rows += [(2000 + i, rows[7][1], 0, "z") for i in range(5)]
    got = embedding_dedup.near_duplicate_vectors(vectors(spark, rows)).toPandas().set_index("vec_id")
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label, ids = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    close = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(close, False)
    n = close.sum(1)
    links = got.n_links[ids].to_numpy()
    assert (links <= n).all() and links.sum() >= 0.97 * n.sum() > 1000
    want = brute_components(ids.tolist(), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close))])
    assert np.mean([got.component_id[i] == want[i] for i in ids]) > 0.97
    assert (got.kept == (got.component_id == got.index)).all()


def test_embedding_forest_recall_in_depth():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (20_000, 64))
    x[10_000:] = x[:10_000] / np.linalg.norm(x[:10_000], axis=1, keepdims=True) + rng.normal(0, 0.02, (10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x[:10_000] * x[10_000:]).sum(1) >= 0.98
    forest = embedding_dedup.fit_forest(x[:: 2], 20_000 * 400 // 20)  # depth 10, as at 0.4 million rows
    assert len(forest[0]["way"]) == 10 and near.sum() > 1000
    shared, copies = np.zeros(10_000, bool), 0
    for tree in forest:
        row, leaf = embedding_dedup.leaves(tree, x)
        copies += len(row)
        key = set((row * (1 << 20) + leaf).tolist())
        first = row < 10_000
        shared[[r for r, f in zip(row[first].tolist(), leaf[first].tolist()) if (r + 10_000) * (1 << 20) + f in key]] = True
    assert shared[near].mean() > 0.99 and copies / len(x) / len(forest) < 5


def test_embedding_dedup_large_leaf_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, 16)
    rows = [(i, (base + rng.normal(0, 0.01, 16)).tolist(), 1, "z") for i in range(150)]
    got = embedding_dedup.near_duplicate_vectors(vectors(spark, rows)).toPandas()
    assert (got.n_links == 149).all() and (got.component_id == 0).all()


BAD = [(1, [1.0, 0.0], 1, "a"), (2, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (3, None, 1, "a"), (4, [0.0, 0.0], 1, "a"), (5, [float("nan"), 1.0], 1, "a"), (6, [float("inf"), 1.0], 1, "a"), (7, [None, 1.0], 1, "a"), (8, [1.0, 0.0], None, "a"), (9, [1.0, 0.0, 0.0], 1, "a"), (20, [1.0, 0.01], 1, "a"), (40, [-1.0, 0.0], 2, "a"), (None, [1.0, 0.0], 1, "a")]


def test_embedding_dedup_awkward(spark):
    got = embedding_dedup.near_duplicate_vectors(vectors(spark, BAD)).toPandas()
    assert len(got) == len(BAD)
    by = got.dropna(subset=["vec_id"]).groupby("vec_id").n_links.max().to_dict()
    assert by[1] == 4 and by[20] == 4 and all(by[i] == 0 for i in (3, 4, 5, 6, 7, 8, 9, 40))
    assert embedding_dedup.near_duplicate_vectors(vectors(spark, [])).count() == 0
    assert embedding_dedup.near_duplicate_vectors(vectors(spark, BAD[3:8])).count() == 5


@pytest.mark.parametrize("part_rows, query_rows", [(16384, 8192), (100, 7)])
def test_top_k_against_brute_force(spark, monkeypatch, part_rows, query_rows):
    monkeypatch.setattr(topk_search, "PART_ROWS", part_rows)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", query_rows)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.2, (700, 12)).round(2)
    x[100:140] = x[0]  # ties
    rows = [(i, v.tolist(), 1, "z") for i, v in enumerate(x)]
    got = topk_search.exact_top_k(vectors(spark, rows)).toPandas()
    ints = np.floor(64 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    score = ints @ ints.T
    want = []
    for q in range(0, 700, 20):
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-score[q, i], i))[:20]
        want += [(q, r + 1, i, score[q, i]) for r, i in enumerate(order)]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].values.tolist())) == sorted(want)


def test_top_k_bounds_prune():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1, (2000, 6)) for c in (0, 30, 60)]).round()
    part = topk_search.PivotPart(np.arange(len(x)), x, x[::50])
    ids, scores, done = part.search(5999, x[5999], 20)
    order = np.lexsort((np.arange(len(x)), -(x @ x[5999])))
    assert ids.tolist() == [i for i in order.tolist() if i != 5999][:20] and done < len(x)


def test_top_k_bounds_hold_and_prune_near_copies():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 8, (200, 64))
    x = np.floor(np.repeat(centres, 25, 0) + rng.normal(0, 1, (5000, 64)))
    part = topk_search.PivotPart(np.arange(len(x)), x, x[rng.permutation(5000)[:256]])
    shares = []
    for q in range(0, 5000, 250):
        score = x @ x[q]
        assert (part.bounds(x[q], float(x[q] @ x[q])) >= score).all()
        ids, scores, done = part.search(q, x[q], 20)
        order = [i for i in np.lexsort((np.arange(len(x)), -score)).tolist() if i != q][:20]
        assert ids.tolist() == order and scores.tolist() == score[order].astype(int).tolist()
        shares.append(done / len(x))
    assert np.mean(shares) < 0.5


def test_top_k_large_components(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.2, (50, 4)), rng.normal(0, 1, (6, 4)) * 2e6, rng.normal(0, 1, (4, 4)) * 3e8, [[1e300, 1, 0, 0], [-1e300, 0, 1, 0]]])
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = topk_search.exact_top_k(frame, k=60).toPandas()
    most = 2**63 - 1
    ints = [[math.floor(c * 64) for c in v.tolist()] for v in x]
    for q in range(0, len(x), 20):
        score = {i: max(-most, min(most, sum(a * b for a, b in zip(ints[q], v)))) for i, v in enumerate(ints) if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:60]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == want and mine.score.tolist() == [score[i] for i in want]


def test_top_k_awkward(spark):
    got = topk_search.exact_top_k(vectors(spark, BAD)).toPandas()
    assert set(got.query_id) == {20, 40} and got[got.query_id == 20].vec_id.tolist() == [2, 1, 2, 8, 4, 40]
    assert topk_search.exact_top_k(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    d = "/root/testdata/sf0.01"
    got = queries()[name](spark, d).toPandas()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = con.execute(oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_secret_query_digest(spark):
    d = "/root/testdata/sf0.01"
    got = queries()["op2_secret_scans"](spark, d).toPandas().set_index("doc_id")
    raw = pd.read_parquet(f"{d}/documents.parquet").set_index("doc_id").text
    for i, t in raw.items():
        base = brute_secrets(t)
        assert got.base_sha256[i] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert got.n_hex[i] == sum(k == "hex" for k, _, _ in base)


def test_simhash_never_broadcasts_fingerprints(spark, monkeypatch):
    from tidemark.llm import common

    plans = []

    def recorded(df, tag):
        df.collect()
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df, tag)

    cut = common.cut
    monkeypatch.setattr(common, "cut", recorded)
    monkeypatch.setattr(simhash, "cut", recorded)
    texts = [f"one two three four five six seven eight nine ten {i // 3} " * 4 + "x" * (i % 3) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    recorded(simhash.drop_near_duplicates(docs), "kept")
    recorded(simhash.near_duplicates(docs), "classes")
    assert {"simhash-links", "kept", "classes"} <= {t for t, _ in plans}
    assert not [t for t, p in plans if "BroadcastExchange" in p]
