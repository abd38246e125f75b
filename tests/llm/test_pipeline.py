"""The pipeline's stages: columns, decisions that take effect, and a plain version of what each must do."""

import collections
import re

import corpus_pipeline
import pytest

from tidemark.llm.common import cut


@pytest.fixture(scope="module")
def steps(spark):
    d = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, d), "test-stage")
        out.append(docs)
    return spark.read.parquet(f"{d}/documents.parquet"), out


def test_columns_and_effects(steps):
    first, out = steps
    assert len(out) == 5 and all(x.columns == first.columns for x in out[:-1])
    n = [first.count(), *[x.count() for x in out]]
    assert n[0] > n[1] and n[1] == n[2] and n[2] > n[3] and n[4] == n[5]


def test_lines_are_gone(steps):
    _, out = steps
    holders = collections.defaultdict(set)
    for r in out[1].select("doc_id", "text").collect():
        for line in r.text.split("\n"):
            key = re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
            if len(key) >= 20:
                holders[key].add(r.doc_id)
    assert max(map(len, holders.values())) <= 2


def test_groups_keep_their_smallest(steps):
    from tests.llm.test_operators import brute_components, brute_fingerprint

    _, out = steps
    fp = {r.doc_id: brute_fingerprint(r.text) for r in out[1].select("doc_id", "text").collect()}
    ids = sorted(fp)
    low = brute_components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 4])
    assert sorted(r.doc_id for r in out[2].select("doc_id").collect()) == sorted(set(low.values()))


def test_mix_and_segmentations(spark, steps):
    from tidemark.llm.mixing import mix_sources

    _, out = steps
    copies = {r.doc_id: r.copies for r in mix_sources(out[2]).collect()}
    got = collections.Counter(r.doc_id for r in out[3].select("doc_id").collect())
    assert got == collections.Counter({k: v for k, v in copies.items() if v})
    assert all(s.round_trip for r in out[4].select("segmentations").collect() for s in r.segmentations)


def test_run(spark, steps):
    _, out = steps
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert whole.count() == out[-1].count() and corpus_pipeline.ORACLE_SQL is None
