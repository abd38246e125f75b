"""Operators on small literal frames, against plain Python folds."""

import io
import itertools
import json
import math
import time
import zipfile
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrow
from tidemark.operators import cluster, merge, metrics, search, state, timeseries
from tidemark.sources import files
from tidemark.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# Merges ------------------------------------------------------------------------------------------


def test_upsert_keeps_latest_and_ties_go_to_the_new(spark):
    a = spark.createDataFrame([(1, 5, "a"), (2, 9, "b"), (3, 1, "c")], "k int, at int, v string")
    b = spark.createDataFrame([(1, 5, "A"), (2, 8, "B"), (4, 1, "D")], "k int, at int, v string")
    assert rows(merge.upsert(a, b, ["k"], "at").select("k", "v")) == [(1, "A"), (2, "b"), (3, "c"), (4, "D")]
    assert rows(merge.insert_new(a, b, ["k"]).select("k")) == [(4,)]
    assert rows(merge.replace_children(a, b.where("k = 2"), "k").select("k", "v")) == [(1, "a"), (2, "B"), (3, "c")]


def test_versions(spark):
    stored = spark.createDataFrame([("p", "h1", 1, False), ("p", "h2", 2, True), ("q", "h3", 1, True), ("r", "h4", 1, True)], "source_pk string, content_hash string, version int, is_current boolean")
    new = spark.createDataFrame([("p", "h1"), ("q", "h9"), ("r", "h4"), ("s", "h5")], "source_pk string, content_hash string")
    got = {(r.source_pk, r.content_hash): (r.version, r.is_current, r.action) for r in merge.version_documents(stored, new).collect()}
    assert got == {("p", "h1"): (1, True, "reactivated"), ("p", "h2"): (2, False, "deactivated"), ("q", "h3"): (1, False, "deactivated"), ("q", "h9"): (2, True, "indexed"), ("r", "h4"): (1, True, "skipped"), ("s", "h5"): (1, True, "indexed")}


def test_publish_switches(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    for n in (1, 2):
        merge.publish(spark.range(n), at)
        assert merge.current(spark, at).count() == n


def test_claims(spark):
    claims = spark.createDataFrame([(1, "completed", "2024-01-01 00:00:00"), (2, "processing", "2024-01-01 00:50:00"), (3, "processing", "2024-01-01 00:10:00")], "k int, status string, claimed_at string").withColumn("claimed_at", F.col("claimed_at").cast("timestamp"))
    got = merge.claim(claims, spark.range(1, 5).select(F.col("id").cast("int").alias("k")), ["k"], F.lit("2024-01-01 01:00:00").cast("timestamp"))
    assert dict(rows(got)) == {1: False, 2: False, 3: True, 4: True}


# Search ------------------------------------------------------------------------------------------


def test_semantic_rank_is_brute_force(spark):
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(7, 8)).round(3), rng.normal(size=(300, 8)).round(3)
    qs = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(q)], "query_id int, embedding array<double>, g int")
    cs = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(c)], "chunk_id int, embedding array<double>, g int")
    for by in (None, ["g"]):
        got = rows(search.semantic_rank(qs, cs, 5, by).select("query_id", "rank", "chunk_id"))
        want = []
        for i in range(7):
            pool = [j for j in range(300) if not by or j % 2 == i % 2]
            want += [(i, n + 1, j) for n, j in enumerate(sorted(pool, key=lambda j: (-float(q[i] @ c[j]), j))[:5])]
        assert got == sorted(want)


def test_fusion(spark):
    f = lambda ids: spark.createDataFrame([(1, x, n + 1) for n, x in enumerate(ids)], "query_id int, chunk_id string, rank int")
    got = search.fuse(f(["A", "B"]), f(["B", "C"]), k=10).select("chunk_id", "rrf_score").collect()
    assert dict(map(tuple, got)) == pytest.approx({"A": 1 / 11, "B": 1 / 12 + 1 / 11, "C": 1 / 12})
    assert search.fuse(f(["A"]), f([]), k=10).count() == 1


def test_limits_count_accepted_hits_only(spark):
    hits = [("a", "d1", "e1", "h1"), ("b", "d1", "e1", "h1"), ("c", "d1", "e1", "h2"), ("d", "d1", "e2", "h3"), ("e", "d2", "e1", "h4"), ("f", "d3", "e2", "h5"), ("g", "d3", None, None), ("h", "d3", None, None)]
    df = spark.createDataFrame([(1, *h, n) for n, h in enumerate(hits)], "query_id int, chunk_id string, document_id string, source_pk string, content_hash string, rank int")
    kept = search.limit_per_source(df)
    assert [r[0] for r in rows(kept.select("chunk_id"))] == ["a", "c", "f", "g"]
    first = search.current_first(kept, F.lit("e2"), 2)
    assert [r.chunk_id for r in first.orderBy("place").collect()] == ["f", "a"]


def test_context_within_budget(spark):
    chunks = spark.createDataFrame([("d", i, c * 10) for i, c in enumerate("abcde")], "document_id string, chunk_order int, content string")
    hits = spark.createDataFrame([(1, "x", "d", 2, "c" * 10, 1), (1, "y", "d", 0, "a" * 10, 2)], "query_id int, chunk_id string, document_id string, chunk_order int, content string, rank int")
    got = {r.chunk_id: r.context for r in search.expand_context(hits, chunks, 45).collect()}
    assert got == {"x": "b" * 10 + "\n\n" + "d" * 10, "y": None}


def test_lexical_rank(spark):
    chunks = spark.createDataFrame([(1, "the quarterly revenue of acme rose"), (2, "acme revenues quarterly"), (3, "nothing here at all")], "chunk_id int, search_text string")
    q = spark.createDataFrame([(1, "quarterly revenue"), (2, "")], "query_id int, query_text string")
    got = search.lexical_rank(q, chunks, threshold=0.4).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id, r.exact) for r in got] == [(1, 1, True), (1, 2, False)]
    assert got[1].lexical == pytest.approx(arrow.similarity_within(set(arrow.trigrams("quarterly revenue")), arrow.trigrams("acme revenues quarterly")))


def test_lexical_rank_is_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["anbleer", "thlynd", "hethes", "st", "of", "he", "for", "ly", "semiconductors", "삼성전자는", "금리가", "ab", "Revenue"]
    texts = [" ".join(rng.choice(words, 8)) for _ in range(60)] + ["anblear thlind hetes st of he for ly", "삼성전자는 금리가 ab", "", None]
    asked = ["anbleer thlynd hethes st of he for ly", "semiconductor", "삼성전자", "금리", "ab", "of he", "REVENUE st", "emicon", "!", "st of", "zzz qqq", "", None]
    got = search.lexical_rank(spark.createDataFrame(list(enumerate(asked)), "query_id int, query_text string"), spark.createDataFrame(list(enumerate(texts)), "chunk_id int, search_text string"), k=1000, threshold=0.5).collect()
    want = {}
    for i, q in enumerate(asked):
        for j, t in enumerate(texts):
            if q and t is not None:
                grams, body = set(arrow.trigrams(q)), arrow.trigrams(t)
                score = max((len(grams & set(body[a:b])) / len(grams | set(body[a:b])) for a in range(len(body)) for b in range(a + 1, len(body) + 1)), default=0.0) if grams else 0.0
                if q.lower() in t.lower() or score >= 0.5:
                    want[i, j] = (q.lower() in t.lower(), pytest.approx(score))
    assert {(r.query_id, r.chunk_id): (r.exact, r.lexical) for r in got} == want
    assert {i for i, _ in want} >= {0, 1, 2, 3, 4, 5, 6, 7}


def test_terms(spark):
    terms = spark.createDataFrame([(1, "Base Rate", ["policy rate"]), (2, "Rate", []), (3, "Swap", ["IRS"])], "term_id int, term string, aliases array<string>")
    c = spark.createDataFrame([(1, "base rate", 0), (1, "rate", 1), (2, "irs", 0), (3, "base", 0), (4, "zzz", 0)], "query_id int, candidate string, nth int")
    assert rows(search.lookup_terms(c, terms)) == [(1, 1, 1), (2, 3, 2), (3, 1, 3)]


def test_terms_that_repeat_make_no_pairs(spark):
    n = 4000  # each stage would pair n / 4 questions with n terms or more
    kind = F.element_at(F.array(F.lit("Same Name"), F.lit("nick"), F.lit("e nam"), F.lit("none")), (F.col("id") % 4 + 1).cast("int"))
    c = spark.range(n).select(F.col("id").alias("query_id"), F.posexplode(F.array(kind, F.lit("zzz"))).alias("nth", "candidate"))
    terms = spark.range(n).select((F.col("id") + 5).alias("term_id"), F.lit("same name").alias("term"), F.array(F.lit("Nick"), F.lit("same name")).alias("aliases"))
    found = search.lookup_terms(c, terms)
    assert rows(found) == sorted((i, 5, i % 4 + 1) for i in range(n) if i % 4 < 3)

    counted = found.agg(F.count("*"))
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan()
    inner = lambda x: x.executedPlan() if x.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else x.plan() if x.getClass().getSimpleName().endswith("QueryStageExec") else None

    def walk(x):
        own = [x.metrics().apply("numOutputRows").value()] if x.metrics().contains("numOutputRows") else []
        below = [inner(x)] if inner(x) is not None else [x.children().apply(i) for i in range(x.children().size())]
        return max([*own, *[walk(b) for b in below]], default=0)

    assert 0 < walk(plan) <= 20 * n


# Clusters -----------------------------------------------------------------------------------------


def plain_clusters(articles, threshold, window):
    out, open_ = {}, []
    for a, t, v in sorted(articles, key=lambda x: (x[1], x[0])):
        best, s = None, threshold
        for c in open_:
            if t - c["last"] <= window and float(v @ c["c"]) >= s:
                best, s = c, float(v @ c["c"])
        if best is None:
            open_.append({"id": a, "c": v.copy(), "n": 1, "last": t})
            out[a] = a
        else:
            best["c"] = (best["c"] * best["n"] + v) / (best["n"] + 1)
            best["c"] /= np.linalg.norm(best["c"])
            best["n"] += 1
            best["last"] = max(best["last"], t)
            out[a] = best["id"]
    return out


def articles(spark, n=120, stocks=2, gap=None, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 8))
    data, t = [], 0.0
    for i in range(n):
        t += float(rng.exponential(2.0)) + (60.0 if gap and i % gap == 0 else 0)
        v = base[rng.integers(6)] + rng.normal(0, 0.25, 8)
        data.append((f"s{i % stocks}", i, t, (v / np.linalg.norm(v)).tolist()))
    return data, spark.createDataFrame(data, "stock_code string, article_id long, t_hours double, vec array<double>")


@pytest.mark.parametrize("gap", [None, 15])
def test_online_clusters_are_the_fold(spark, gap):
    data, df = articles(spark, gap=gap)
    got = {r.article_id: r.cluster_id for r in cluster.online_clusters(df.union(df.limit(5)), cluster.Rules(threshold=0.74)).collect()}
    want = {}
    for s in ("s0", "s1"):
        want |= plain_clusters([(a, t, np.array(v)) for k, a, t, v in data if k == s], 0.74, 24.0)
    assert got == want and 1 < len(set(got.values())) < len(got)


def test_judge_auto_merge_and_kinds(spark):
    e = lambda x: [float(np.cos(x)), float(np.sin(x))]
    data = [("s", 1, 0.0, e(0.0), "company", ""), ("s", 2, 1.0, e(0.1), "company", ""), ("s", 3, 2.0, e(0.7), "company", ""), ("s", 4, 3.0, e(0.9), "company", ""), ("s", 5, 40.0, e(0.0), "company", ""), ("s", 6, 41.0, e(0.0), "market", "d1"), ("s", 7, 42.0, e(0.0), "market", "d2")]
    df = spark.createDataFrame(data, "stock_code string, article_id long, t_hours double, vec array<double>, kind string, day string")
    asked = cluster.online_clusters(df, cluster.Rules(auto_merge=0.95, candidate=0.5), lambda a, c: c[0]["cluster_id"] if a["article_id"] == 3 else None)
    got = {r.article_id: (r.cluster_id, r.how) for r in asked.collect()}
    assert got[2] == (1, "auto") and got[3] == (1, "judge") and got[4] == (1, "auto") and got[5] == (5, "none")
    kinds = {r.article_id: r.cluster_id for r in cluster.online_clusters(df, cluster.Rules(threshold=0.9, by_kind=True)).collect()}
    assert kinds[6] == 6 and kinds[7] == 7 and kinds[5] == 5
    guard = cluster.Rules(threshold=0.5, recent=1, recent_least=0.99)
    assert {r.article_id: r.cluster_id for r in cluster.online_clusters(df, guard).collect()}[3] == 3


def test_knn_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5)).round(3)
    x[1] = x[0]
    got = {(r.a, r.b) for r in cluster.knn_edges(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>"), 3, 0.5).collect()}
    want = set()
    for i in range(40):
        near = sorted((j for j in range(40) if j != i), key=lambda j: (-float(x[i] @ x[j]), j))[:3]
        want |= {(min(i, j), max(i, j)) for j in near if float(x[i] @ x[j]) >= 0.5}
    assert got == want


# Metrics -----------------------------------------------------------------------------------------


def test_clustering_scores_against_pairs(spark):
    rng = np.random.default_rng(3)
    pred, gold = rng.integers(0, 5, 60), rng.integers(0, 4, 60)
    got = metrics.clustering_scores(spark.createDataFrame(list(zip(pred.tolist(), gold.tolist())), "pred int, gold int")).first().asDict()
    pairs = list(itertools.combinations(range(60), 2))
    sp, sg = (np.array([x[a] == x[b] for a, b in pairs]) for x in (pred, gold))
    assert got["pairwise_precision"] == pytest.approx((sp & sg).sum() / sp.sum()) and got["pairwise_recall"] == pytest.approx((sp & sg).sum() / sg.sum())
    assert got["over_merge_rate"] == pytest.approx((sp & ~sg).sum() / (~sg).sum()) and got["under_merge_rate"] == pytest.approx((~sp & sg).sum() / sg.sum())
    assert got["bcubed_precision"] == pytest.approx(np.mean([((pred == pred[i]) & (gold == gold[i])).sum() / (pred == pred[i]).sum() for i in range(60)]))
    same = metrics.clustering_scores(spark.createDataFrame([(i % 3, i % 3) for i in range(9)], "pred int, gold int")).first()
    assert same.ari == pytest.approx(1) and same.nmi == pytest.approx(1) and same.bcubed_f1 == pytest.approx(1)


def test_missing_prediction_fails(spark):
    pred = spark.createDataFrame([(1, 1)], "item int, pred int")
    gold = spark.createDataFrame([(1, "s", 1), (2, "s", 1)], "item int, stock string, gold int")
    with pytest.raises(Exception, match="no prediction"):
        metrics.scores_by_stock(pred, gold)[0].collect()


def test_nearest_rank_and_recall(spark):
    x = [5.0, 1.0, 4.0, 4.0, 2.0, 9.0]
    got = metrics.nearest_rank(spark.createDataFrame([(v,) for v in x], "v double"), "v", [], [0, 50, 95, 100]).first()
    s = sorted(x)
    assert list(got) == [s[round(p / 100 * 5)] for p in (0, 50, 95, 100)]
    r = metrics.recall_mrr(spark.createDataFrame([(1,), (4,), (None,)], "rank int"), 3).first()
    assert (r.n, r.recall, r.mrr) == (3, 0.333, 0.417)


def test_splits_and_deltas(spark):
    u = spark.createDataFrame([(f"s{i % 2}", f"u{i}", 1 + i % 4) for i in range(400)], "stock string, unit string, rows int")
    got = metrics.split_units(u, {"a": 0.6, "b": 0.2, "c": 0.2}).groupBy("split").agg(F.sum("rows").alias("n")).collect()
    n = {r.split: r.n / 1000 for r in got}
    assert n["a"] == pytest.approx(0.6, abs=0.03) and n["c"] == pytest.approx(0.2, abs=0.03)
    before, after = (metrics.snapshot({"t": spark.range(k)}) for k in (3, 5))
    assert metrics.delta(before, after).first().delta == 2
    assert rows(metrics.duplicates(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"])) == [(1, 2)]


def test_splits_fill_the_largest_deficit(spark):
    import hashlib

    shares = {"a": 0.6, "b": 0.2, "c": 0.2}
    data = [(s, f"u{i}", 1 + (i * 7) % 5) for i in range(120) for s in (["hot"] if i % 3 else ["s1", None])]
    df = spark.createDataFrame(data, "stock string, unit string, rows int").repartition(5)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "9")  # a stock goes by in several batches
    try:
        got = {(r.stock, r.unit): r.split for r in metrics.split_units(df, shares).collect()}
    finally:
        spark.conf.set(key, before)
    want = {}
    for stock in ("hot", "s1", None):
        units = sorted(((u, n) for s, u, n in data if s == stock), key=lambda x: (-x[1], hashlib.md5(f"42:{x[0]}".encode()).hexdigest(), x[0]))
        has, total = dict.fromkeys(shares, 0), sum(n for _, n in units)
        for u, n in units:
            want[stock, u] = best = max(shares, key=lambda s: total * shares[s] - has[s])
            has[best] += n
    assert got == want


def test_seeds_take_the_least_used_stock(spark):
    import hashlib
    import random

    from tidemark.operators import news

    rng = random.Random(9)
    data = [(i, rng.choice("aaaaaaabbcd") + str(rng.randrange(2)), rng.choice([1, 1, 3, 7, 30, 60]), rng.random() < 0.3) for i in range(300)] + [(900, "z", 40, None)]
    got = {}
    for r in news.seeds(spark.createDataFrame(data, "cluster_id long, stock_code string, article_count int, recent boolean"), 8, largest=50).orderBy("pick").collect():
        got.setdefault(r.bucket, []).append(r.cluster_id)
    want = {}
    for name, low, high in (("1", 1, 1), ("2-4", 2, 4), ("5-19", 5, 19), ("20+", 20, 50)):
        pool = sorted((c for c in data if low <= c[2] <= high), key=lambda c: (hashlib.md5(f"42:{c[0]}".encode()).hexdigest(), c[0]))
        recent, older, used, picked = [c for c in pool if c[3]], [c for c in pool if not c[3]], {}, []
        while len(picked) < 8 and (recent or older):
            src = recent if (len(picked) % 2 == 0 and recent) or not older else older
            src.sort(key=lambda c: used.get(c[1], 0))
            c = src.pop(0)
            picked.append(c[0])
            used[c[1]] = used.get(c[1], 0) + 1
        if picked:
            want[name] = picked
    assert got == want


# Time and state ------------------------------------------------------------------------------------


def test_asof_is_strictly_before(spark):
    l = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 9, "z")], "k string, at int, id string")
    r = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 30.0)], "k string, at int, v double")
    assert rows(timeseries.asof_before(l, r, ["k"], "at", "v").select("id", "before").na.fill(-1.0)) == [("x", 20.0), ("y", -1.0), ("z", -1.0)]


def test_corrections_need_one_match(spark):
    f = spark.createDataFrame([("o1", "t", "d1", False, None), ("o2", "u", "d1", False, None), ("o3", "u", "d1", False, None), ("c1", "t", "d2", True, "d1"), ("c2", "u", "d2", True, "d1"), ("c3", "t", "d2", True, None)], "rcept_no string, norm_title string, day string, is_correction boolean, first_day string")
    assert rows(timeseries.link_corrections(f)) == [("c1", "o1")]


def test_gate(spark):
    outcomes = [True] * 5 + [False] * 2 + [True] * 60 + [False] * 20
    df = spark.createDataFrame([("r", i, ok) for i, ok in enumerate(outcomes)], "run string, n int, ok boolean")
    got = state.adaptive_gate(df, ["run"], ["n"], workers=8).orderBy("n").collect()
    assert got[6].limit == 6 and got[56].limit == 7 and not got[70].halted and got[-1].halted


def test_budget_and_retries(spark):
    c = spark.createDataFrame([("r", i, 0.4) for i in range(5)], "run string, n int, cost double")
    assert [r.allowed for r in state.running_budget(c, ["run"], ["n"], F.col("cost"), 10, 1.0).orderBy("n").collect()] == [True, True, False, False, False]
    a = spark.createDataFrame([("x", 1, False), ("x", 2, True), ("y", 1, True), ("y", 2, False), ("z", 1, False), ("z", 2, False), ("z", 3, False)], "k string, s int, ok boolean").withColumn("at", F.timestamp_seconds("s"))
    got = {r.k: (r.state, r.failures) for r in state.retry_states(a, ["k"], "at", F.col("ok")).collect()}
    assert got == {"x": ("completed", 0), "y": ("pending_retry", 1), "z": ("failed", 3)}
    gate = state.activation_gate({"a": spark.range(0), "b": spark.range(2)}).collect()
    assert [(r.check, r.ok) for r in gate] == [("a", True), ("b", False)]


# Streams -------------------------------------------------------------------------------------------


def test_cluster_stream_is_the_batch(spark, tmp_path):
    data, df = articles(spark, n=60)
    for i in range(3):
        spark.createDataFrame(data[i * 20 : (i + 1) * 20], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    jobs.run_once(jobs.cluster_stream(s, cluster.Rules(threshold=0.74)), f"{tmp_path}/c", name="cluster_rows")
    want = {r.article_id: r.cluster_id for r in cluster.online_clusters(df, cluster.Rules(threshold=0.74)).collect()}
    assert {r.article_id: r.cluster_id for r in spark.table("cluster_rows").collect()} == want


class FakeMap(dict):
    """A map state that counts the messages about single keys."""

    calls = 0

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, k, v):
        self.calls += 1
        self[k] = v

    def removeKey(self, k):
        self.calls += 1
        del self[k]

    def containsKey(self, k):
        self.calls += 1
        return k in self


def test_state_keeps_only_articles_of_the_window():
    """Of many articles in a batch only those of the window are written; a repeated one is known in the batch and in the next."""
    states = {"clusters": FakeMap(), "seen": FakeMap()}
    handle = SimpleNamespace(getMapState=lambda name, *_: states[name], listTimers=lambda: [], registerTimer=lambda at: None)
    fold = jobs.Assigner(cluster.Rules(threshold=0.25), None, "long", "long")
    fold.init(handle)
    batch = pd.DataFrame({"article_id": [*range(1000), 999], "t_hours": [*(i / 2.0 for i in range(1000)), 499.5], "vec": [[1.0, 0.0]] * 1001})
    out = pd.concat(fold.handleInputRows((1,), iter([batch]), None))
    assert len(out) == 1000 and not out.error.notna().any()
    assert states["seen"] == {(i,): (i / 2.0,) for i in range(951, 1000)} and states["seen"].calls == 49
    again = pd.DataFrame({"article_id": [999, 1000], "t_hours": [499.5, 500.0], "vec": [[1.0, 0.0]] * 2})
    assert pd.concat(fold.handleInputRows((1,), iter([again]), None)).article_id.tolist() == [1000]
    assert states["seen"] == {(i,): (i / 2.0,) for i in range(952, 1001)}


def test_one_pass_gives_clusters_and_those_still_open(spark):
    rules = cluster.Rules(threshold=0.25)
    data = [(i % 2, (1 << 60) + i, i * 0.7, [math.cos(i), math.sin(i)]) for i in range(90)]
    a = spark.createDataFrame(data, "stock_code long, article_id long, t_hours double, vec array<double>")
    done, held = cluster.clusters_and_open(a, rules)
    of = lambda df: sorted(map(tuple, df.collect()))
    assert of(done) == of(cluster.online_clusters(a, rules)) and of(held) == of(cluster.open_clusters(a, rules)) and held.count()


def test_state_has_partitions_by_cores(spark, tmp_path):
    data = [(i % 3, i, i * 0.7, [1.0, 0.0]) for i in range(6)]
    kind = "stock_code long, article_id long, t_hours double, vec array<double>"
    spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        jobs.run_once(jobs.cluster_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), cluster.Rules()), f"{tmp_path}/c", name="few_rows")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [x for x in (tmp_path / "c" / "state" / "0").iterdir() if x.name.isdigit()]
    assert len(parts) <= 2 * spark.sparkContext.defaultParallelism and spark.table("few_rows").count() == 6


def test_cluster_stream_goes_on_from_open_clusters(spark, tmp_path):
    """Stopped after any article and hydrated from the clusters left open, it is as if it had never stopped; in judge mode too."""
    data, df = articles(spark, n=40)
    judge = lambda a, c: c[0]["cluster_id"] if a["article_id"] % 2 else None
    for nth, rules in enumerate((cluster.Rules(threshold=0.74), cluster.Rules(auto_merge=0.95, candidate=0.5))):
        first, later = df.where("article_id < 23"), df.where("article_id >= 23")
        later.coalesce(1).write.parquet(f"{tmp_path}/in{nth}")
        s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in{nth}")
        held = cluster.open_clusters(first, rules, judge)
        spark.createDataFrame(held.collect(), held.schema).write.parquet(f"{tmp_path}/held{nth}")
        jobs.run_once(jobs.cluster_stream(s, rules, judge, initial=spark.read.parquet(f"{tmp_path}/held{nth}")), f"{tmp_path}/c{nth}", name="resumed_rows")
        whole = {r.article_id: (r.cluster_id, r.how) for r in cluster.online_clusters(df, rules, judge).collect()}
        assert {r.article_id: (r.cluster_id, r.how) for r in spark.table("resumed_rows").collect()} == {a: x for a, x in whole.items() if a >= 23}


def test_a_stock_that_fails_is_a_row(spark, tmp_path):
    data, df = articles(spark, n=20)

    def judge(article, found):
        if article["stock_code"] == "s0":
            raise ValueError("no answer")
        return None

    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    jobs.run_once(jobs.cluster_stream(s, cluster.Rules(auto_merge=1.1, candidate=-1.0), judge), f"{tmp_path}/c", name="failed_rows")
    got = spark.table("failed_rows").collect()
    assert [(r.stock_code, r.article_id) for r in got if r.error] == [("s0", None)] and "no answer" in next(r.error for r in got if r.error)
    assert {r.article_id for r in got if not r.error} == {a for s, a, *_ in data if s == "s1"}


def test_silent_stocks_leave_the_state(spark, tmp_path):
    rows = [("a", 1, 10.0), ("b", 2, 11.0), ("b", 3, 300.0), ("b", 4, 301.0)]
    for i, part in enumerate((rows[:2], rows[2:3], rows[3:])):
        spark.createDataFrame([(s, a, t, [1.0, 0.0]) for s, a, t in part], "stock_code string, article_id long, t_hours double, vec array<double>").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema("stock_code string, article_id long, t_hours double, vec array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = jobs.run_once(jobs.cluster_stream(s, cluster.Rules()), f"{tmp_path}/c", name="silent_rows")
    assert {r.article_id: r.cluster_id for r in spark.table("silent_rows").collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    custom = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert custom[-1] < max(custom) or custom[-1] <= 8


def test_a_hot_stock_goes_by_in_batches(spark):
    """One stock with all articles: the fold sees batches of bounded size and gives what one frame gives."""
    data, df = articles(spark, n=60)
    one = df.withColumn("stock_code", F.lit("s0"))
    want = {r.article_id: r.cluster_id for r in cluster.online_clusters(one, cluster.Rules(threshold=0.74)).collect()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert {r.article_id: r.cluster_id for r in cluster.online_clusters(one, cluster.Rules(threshold=0.74)).collect()} == want
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_run_once_leaves_rows_in_files(spark, tmp_path, mode):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    s = s if mode == "append" else s.groupBy((F.col("id") % 2).alias("id")).count()
    jobs.run_once(s, f"{tmp_path}/c", name="in_files", mode=mode)
    assert rows(spark.table("in_files")) == ([(i,) for i in range(30)] if mode == "append" else [(0, 15), (1, 15)])
    assert len(spark.table("in_files").inputFiles()) > 0


def test_retry_stream(spark, tmp_path):
    spark.createDataFrame([("a", False), ("b", True), ("a", False)], "key string, ok boolean").write.parquet(f"{tmp_path}/in/0")
    s = spark.readStream.schema("key string, ok boolean").parquet(f"{tmp_path}/in/*")
    # A stream with timers always has another batch, so it is stopped by hand.
    q = jobs.retry_stream(s).writeStream.option("checkpointLocation", f"{tmp_path}/c").outputMode("update").format("memory").queryName("retry_rows").start()
    try:
        for _ in range(120):
            if spark.table("retry_rows").count() >= 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    got = [(r.key, r.state, r.failures) for r in spark.table("retry_rows").collect()]
    assert ("a", "pending_retry", 2) in got and ("b", "completed", 0) in got


def test_index_batches(spark, tmp_path):
    for i, docs in enumerate(([("p", "1"), ("q", "1")], [("p", "2"), ("q", "1")])):
        spark.createDataFrame(docs, "source_pk string, content_hash string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        s = spark.readStream.schema("source_pk string, content_hash string").parquet(f"{tmp_path}/in/*")
        jobs.run_once(s, f"{tmp_path}/c", batch=jobs.index_batches(f"file://{tmp_path}/t"))
    got = rows(merge.current(spark, f"file://{tmp_path}/t").where("is_current").select("source_pk", "content_hash", "version"))
    assert got == [("p", "2", 2), ("q", "1", 1)]


# Sources -------------------------------------------------------------------------------------------


def test_archives_and_codes(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x_b.xml", "둘째".encode("euc-kr"))
        z.writestr("20240101.xml", "첫째")
    (tmp_path / "20240101.zip").write_bytes(data.getvalue())
    (tmp_path / "err.zip").write_bytes(b"{}")
    got = files.read_archives(spark, f"{tmp_path}/*.zip")
    assert sorted(str(r.member) for r in got.collect()) == ["20240101.xml", "None", "x_b.xml"]
    assert files.document_text(got).first().text == "첫째\n둘째"
    (tmp_path / "codes.xml").write_text("<r><list><corp_code>1</corp_code><corp_name>A</corp_name><stock_code>005930</stock_code></list><list><corp_code>2</corp_code><corp_name>B</corp_name><stock_code> </stock_code></list></r>")
    assert rows(files.corp_codes(spark, f"{tmp_path}/codes.xml")) == [("005930", "1", "A")]


def test_search_rows_and_status(spark):
    item = lambda u, t="a <b>b</b>", d="Mon, 05 Feb 2024 09:00:00 +0900": {"originallink": u, "link": "", "title": t, "description": "", "pubDate": d}
    pages = [(1, json.dumps({"items": [item("http://x.com/a?utm_source=1"), item("ftp://x"), item("http://x.com/b", d="bad")]})), (2, json.dumps({"items": [item("http://www.x.com/a/", "again")]}))]
    got = files.search_rows(spark.createDataFrame(pages, "page int, body string")).collect()
    assert [(r.canonical_url, r.title) for r in got] == [("http://x.com/a", "a b")]
    body = spark.createDataFrame([('{"status":"000","list":[{"a":"1"}]}',), ('{"status":"013"}',), ('{"status":"020"}',)], "b string")
    s = body.select(files.api_status(F.col("b"), "struct<a:string>").alias("s")).collect()
    assert [r.s.kind for r in s] == ["ok", "no_data", "rate_limited"] and s[0].s.rows[0].a == "1"


def test_robots_and_inventory(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "h", "/a/b"), ("u2", "h", "/a/ok"), ("u3", "g", "/")], "url string, host string, path string")
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/ok", True)], "host string, prefix string, allow boolean")
    assert {r.url: r.allowed for r in files.robots_allowed(pages, rules).collect()} == {"u1": False, "u2": True, "u3": True}
    for n in ("20240101_005930_Broker_Title.pdf", "copy.pdf"):
        (tmp_path / n).write_bytes(b"same")
    got = {r.name: (r.broker, r.duplicate_of is not None) for r in files.inventory(spark, f"{tmp_path}/*.pdf").collect()}
    assert got == {"20240101_005930_Broker_Title.pdf": ("Broker", False), "copy.pdf": (None, True)}
    csv = tmp_path / "t.csv"
    csv.write_text("﻿a,b\n1,\"x, y\"\n", encoding="utf-8")
    assert rows(files.read_csv(spark, str(csv), "a int, b string")) == [(1, "x, y")]




def test_nearest_by_few_queries_at_once(spark, monkeypatch):
    """A block of queries goes through a part of the chunks AT_ONCE rows at a time; ties and all ranks stay as by one product."""
    monkeypatch.setattr(search, "AT_ONCE", 3)
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (40, 4)).astype(float)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")
    got = search.semantic_rank(chunks.withColumnRenamed("chunk_id", "query_id"), chunks, 5).collect()
    near = x @ x.T
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == [(i, n, int(j)) for i in range(40) for n, j in enumerate(np.lexsort((range(40), -near[i]))[:5], 1)]
