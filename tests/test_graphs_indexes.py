"""Communities, average linkage and the two indexes, against plain versions."""

import collections
import pathlib
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import shared
from tidemark.functions import arrow
from tidemark.operators import blocks, communities, search, trigram_index, vector_index
from tidemark.plans import registry
from tidemark.plans.retrieval import corpus

UNITS = communities.UNITS


def nearest_edges(sf, k=5, least=0.2):
    """(a, b, w) of each vector's nearest others, by a plain product."""
    t = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    ids, v = t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(float)
    s = v @ v.T
    edges = {}
    for i in range(len(ids)):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
        for j in order:
            if s[i, j] >= least:
                edges[min(ids[i], ids[j]), max(ids[i], ids[j])] = round(s[i, j] * UNITS)
    return np.array([(a, b, w) for (a, b), w in sorted(edges.items())], np.int64)


def plain_quality(edges, of):
    inside, degree = 0, collections.Counter()
    for a, b, w in edges.tolist():
        inside += 2 * w * (of[a] == of[b])
        degree[of[a]] += w
        degree[of[b]] += w
    return inside - sum(k * k for k in degree.values()) / (2 * edges[:, 2].sum())


def one_by_one(edges):
    """Moves of single vertices in order of ids while one gains, then contraction, and again."""
    names, of_all = None, None
    graph = collections.Counter({(a, b): w for a, b, w in edges.tolist()})
    of_all = {x: x for e in edges[:, :2].tolist() for x in e}
    total = 2 * sum(graph.values())
    while True:
        near, k = collections.defaultdict(collections.Counter), collections.Counter()
        for (a, b), w in graph.items():
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        names = {x: x for x in k}
        size, moved = collections.Counter(k), False
        for _ in range(50):
            again = False
            for x in sorted(names):
                to = collections.Counter()
                for y, w in near[x].items():
                    to[names[y]] += w
                own = names[x]
                size[own] -= k[x]
                best = max([own, *sorted(to)], key=lambda c: 2 * to[c] - 2 * k[x] * size[c] / total)
                gain = (2 * to[best] - 2 * k[x] * size[best] / total) - (2 * to[own] - 2 * k[x] * size[own] / total)
                if gain > 1e-3:
                    names[x], again, moved = best, True, True
                size[names[x]] += k[x]
            if not again:
                break
        if not moved:
            return of_all
        of_all = {x: names[c] for x, c in of_all.items()}
        after = collections.Counter()
        for (a, b), w in graph.items():
            after[min(names[a], names[b]), max(names[a], names[b])] += w
        graph = after


def test_quality_is_no_worse_than_moves_one_by_one():
    for sf in ("sf0.001", "sf0.01"):
        edges = nearest_edges(f"/root/testdata/{sf}")
        small = communities.SmallGraph(*edges.T, 1.0)
        at = small.solve()
        got = plain_quality(edges, dict(zip(small.ids.tolist(), small._parts(at).tolist(), strict=True)))
        assert got >= 0.99 * plain_quality(edges, one_by_one(edges))


def test_community_query(spark, sf):
    edges = nearest_edges(sf)
    small = communities.SmallGraph(*edges.T, 1.0)
    part = small.ids[small._parts(small.solve())]
    want = dict(zip(small.ids.tolist(), part.tolist(), strict=True))
    got = {r.vec_id: r.community for r in registry.queries()["graph_communities"](spark, sf).collect()}
    assert {x: want.get(x, x) for x in got} == got and len(got) == 500
    # Every community is connected and named by its smallest member.
    members = collections.defaultdict(set)
    for x, c in got.items():
        members[c].add(x)
    inner = collections.defaultdict(set)
    for a, b, _ in edges.tolist():
        if got[a] == got[b]:
            inner[a].add(b)
            inner[b].add(a)
    for c, m in members.items():
        seen, todo = {c}, [c]
        while todo:
            todo += (new := inner[todo.pop()] - seen)
            seen |= new
        assert seen == m and c == min(m)


def planted(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), 1.0) for g in range(4) for a in range(g * 6, g * 6 + 6) for b in range(a + 1, g * 6 + 6)] + [(int(rng.integers(0, 12)), int(rng.integers(12, 24)), 0.2) for _ in range(6)]
    rows += [(None, 3, 1.0), (3, None, 1.0), (40, 41, 0.0), (41, 40, -1.0), (5, 0, 0.5), (0, 5, 0.25), (50, 50, 2.0), (7, 8, None)]
    return spark.createDataFrame([(i,) for i in [*range(24), 40, 41, 50, 60, 60, None]], "id long"), spark.createDataFrame(rows, "a long, b long, w double")


def test_rounds_are_the_small_graph(spark, monkeypatch):
    vertices, edges = planted(spark)
    got = {r.id: r.community for r in communities.communities(vertices, edges).collect()}
    assert got == {x: x // 6 * 6 if x < 24 else x for x in [*range(24), 40, 41, 50, 60]}
    monkeypatch.setattr(communities, "SMALL_EDGES", 0)
    assert {r.id: r.community for r in communities.communities(vertices, edges).collect()} == got


def test_blocks_raise_the_quality_by_the_sum_of_their_gains(spark, monkeypatch):
    """Few steps, few of them with nothing but an independent set, and a quality near that of one task."""
    edges = nearest_edges("/root/testdata/sf0.001")
    small = communities.SmallGraph(*edges.T, 1.0)
    at = small.solve()
    want = plain_quality(edges, dict(zip(small.ids.tolist(), small._parts(at).tolist(), strict=True)))
    monkeypatch.setattr(communities, "SMALL_EDGES", 300)
    monkeypatch.setattr(communities, "BLOCK_EDGES", 600)
    wishes, steps, dealt, deal = communities.wishes, [], [], communities.deal
    monkeypatch.setattr(communities, "wishes", lambda *a: steps.append(1) or wishes(*a))

    def first_deal(state, wanting, step, most):
        got, blocks = deal(state, wanting, step, most)
        if blocks > 1 and not dealt:
            size = {r.block: r.n for r in state.join(got, "community").groupBy("block").agg(F.sum("ends").alias("n")).collect()}
            dealt.append((blocks, size))
        return got, blocks

    monkeypatch.setattr(communities, "deal", first_deal)
    table = spark.createDataFrame([(a, b, w / UNITS) for a, b, w in edges.tolist()], "a long, b long, w double")
    got = {r.id: r.community for r in communities.communities(spark.createDataFrame([(x,) for x in small.ids.tolist()], "id long"), table).collect()}
    assert plain_quality(edges, got) >= 0.97 * want and len(steps) <= 60
    assert dealt[0][0] >= 3 and max(dealt[0][1].values()) < 3 * 1200  # blocks of about the size asked for

    monkeypatch.undo()
    graph = communities.in_units(table).cache()
    state = communities.degrees(graph).withColumns({"community": F.col("id"), "ends": F.lit(5).cast("long")})
    both = communities._both_ways(graph)
    given, blocks = communities.deal(state, communities.wishes(both, state, small.weight, 1.0), 0, 600)
    moves = {r.id: r.target for r in communities.block_moves(graph, state, given, blocks, small.weight, 1.0).collect()}
    block = {r.community: r.block for r in given.collect()}
    assert blocks >= 3 and moves and all(block[x] == block[c] for x, c in moves.items())
    after = {x: moves.get(x, x) for x in small.ids.tolist()}
    assert plain_quality(edges, after) > plain_quality(edges, {x: x for x in after})


def test_steps_of_both_forms_are_equal(spark, monkeypatch):
    """The three ways to choose, on one state of a graph with many wishes."""
    edges = nearest_edges("/root/testdata/sf0.001")
    small = communities.SmallGraph(*edges.T, 1.0)
    small._level()
    at = np.minimum(np.arange(small.n), np.arange(small.n) // 3 * 3)
    wish = small._wishes(at)
    table = communities.in_units(spark.createDataFrame([(a, b, w / UNITS) for a, b, w in edges.tolist()], "a long, b long, w double"))
    both = communities._both_ways(table)
    state = spark.createDataFrame([(x, k, small.ids[c].item()) for x, k, c in zip(small.ids.tolist(), small.k.tolist(), at, strict=True)], "id long, k long, community long")
    wanting = communities.wishes(both, state, small.weight, 1.0)
    of = lambda df: sorted((r.id, r.target, r.gain, r.lone) for r in df.collect())
    plain = [(small.ids[w].item(), small.ids[t].item(), g.item(), bool(one)) for w, t, g, one in zip(*wish, strict=True)]
    assert of(wanting) == sorted(plain)
    for way, df in (("together", communities.together(wanting)), ("independent", communities.independent(both, wanting, 7)), ("undisputed", communities.undisputed(communities.independent(both, wanting, 7)))):
        assert of(df) == sorted(plain[i] for i in small._choose(way, at, wish, 7))


def test_communities_without_edges(spark):
    vertices, edges = planted(spark)
    assert {r.id: r.community for r in communities.communities(vertices, edges.limit(0)).collect()} == {x: x for x in [*range(24), 40, 41, 50, 60]}
    assert communities.communities(vertices.limit(0), edges.limit(0)).count() == 0


def merged_one_by_one(ids, v, least):
    """Average linkage by the definition: the nearest pair of all merges while its mean similarity is above least."""
    s = v @ v.T
    groups = [[i] for i in range(len(ids))]
    while len(groups) > 1:
        value, i, j = max((np.mean([s[a, b] for a in x for b in y]), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if value <= least:
            break
        groups[-i] += groups.pop(-j)
    return {ids[a]: min(ids[b] for b in g) for g in groups for a in g}


def test_linkage_query_is_merging_one_by_one(spark, sf):
    t = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    want = {}
    for label, g in t.groupby("label"):
        if label in sorted(t.label.unique())[:3]:
            v = np.stack(g.embedding.to_numpy()).astype(float)
            want |= merged_one_by_one(g.vec_id.tolist(), v / np.linalg.norm(v, axis=1)[:, None], 0.2)
    got = {r.vec_id: r.cluster for r in registry.queries()["linkage_clusters"](spark, sf).collect()}
    assert len(got) == 500 and {x: got[x] for x in want} == want


def test_linkage_awkward(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (6, [0.1, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {r.id: r.cluster for r in communities.average_linkage(v, communities.near_pairs(v.dropDuplicates(["id"]), 0.5), 0.5).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 3}
    assert communities.average_linkage(v.limit(0), communities.near_pairs(v.limit(0), 0.5), 0.5).count() == 0


def brute_nearest(q, v, ids, k):
    out = {}
    for i, x in q.items():
        s = v @ x
        order = np.lexsort((ids, -np.round(s, 12)))[:k]
        out[i] = [(int(ids[j]), round(float(s[j]), 9)) for j in order]
    return out


@pytest.mark.parametrize(("rows", "lists", "part"), [(700, 12, 8192), (700, 3, 64), (30, None, 8192)])
def test_exact_mode_of_the_index(spark, monkeypatch, rows, lists, part):
    monkeypatch.setattr(vector_index, "PART_ROWS", part)
    rng = np.random.default_rng(rows)
    v = rng.normal(size=(rows, 10)).round(3)
    v[5:25] = v[4]  # ties
    q = {i: v[4] if i == 0 else rng.normal(size=10).round(3) for i in range(9)}
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in q.items()] + [(77, None)], "query_id long, embedding array<double>")
    index = vector_index.build(chunks, lists)
    got = collections.defaultdict(list)
    for r in vector_index.search(asked, index, 12, probes=2, exact=True).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, round(r.similarity, 9)))
    assert dict(got) == brute_nearest(q, v, np.arange(rows), 12)
    assert int(index.sizes.sum()) == rows


def test_recall_of_the_probed_index(spark):
    d = "/root/testdata/sf0.01"
    q, chunks = corpus(spark, d)
    rows = chunks.select("chunk_id", "embedding").toPandas()
    ids, v = rows.chunk_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    want = brute_nearest({r.query_id: np.array(r.embedding, float) for r in q.collect()}, v, ids, 24)
    got = collections.defaultdict(set)
    for r in registry.queries()["semantic_search_probed"](spark, d).collect():
        got[r.query_id].add(r.chunk_id)
    recall = np.mean([len(got[i] & {c for c, _ in w}) / 24 for i, w in want.items()])
    assert recall >= 0.9


def test_index_is_saved_and_read(spark, tmp_path):
    rng = np.random.default_rng(2)
    chunks = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(120)], "chunk_id long, embedding array<double>")
    asked = chunks.where("chunk_id < 5").withColumnRenamed("chunk_id", "query_id")
    index = vector_index.build(chunks)
    vector_index.save(index, f"file://{tmp_path}/index")
    again = vector_index.load(spark, f"file://{tmp_path}/index")
    one, two = (sorted(map(tuple, vector_index.search(asked, x, 5).collect())) for x in (index, again))
    assert one == two and len(one) == 25


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert vector_index.search(asked, vector_index.build(none), 3, exact=True).count() == 0


def test_trigram_lists_in_salts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(trigram_index, "LISTS_PER_SALT", 1)
    monkeypatch.setattr(trigram_index, "TEXT_BLOCK", 3)
    monkeypatch.setattr(trigram_index, "QUERY_BLOCK", 2)
    texts = ["The Quarterly revenue of the chip maker", "revenue quarterly rises", "it is !! what", "ab", "", None, "chip chip chip chip", "maker of chips, quarter by quarter", "étè naïve été", "x" * 30] * 2
    asked = ["quarterly revenue", "ab", "!!", "chip", "été", "chip maker of chips", "", None, "zzz qqq", "a"]
    q, c = spark.createDataFrame(list(enumerate(asked)), "query_id int, query_text string"), spark.createDataFrame(list(enumerate(texts)), "chunk_id int, search_text string")
    for threshold in (0.4, 0.7, 0.0):
        got = {(r.query_id, r.chunk_id): (r.exact, round(r.lexical, 9)) for r in trigram_index.lexical_pairs(q.where("query_text <> ''"), trigram_index.build(c), threshold).collect()}
        want = {}
        for i, a in enumerate(asked):
            for j, t in enumerate(texts):
                if a and t is not None:
                    grams = set(arrow.trigrams(a))
                    score = arrow.similarity_within(grams, arrow.trigrams(t.lower())) if grams else 0.0
                    if a.lower() in t.lower() or score >= threshold:
                        want[i, j] = (a.lower() in t.lower(), round(score, 9))
        assert got == want


def test_bounds_leave_nothing_out():
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("abc"), 3)) for _ in range(120)) for _ in range(12)]
    asked = [" ".join(t.split()[i : i + 9]) for t in texts for i in (0, 40)] + [" ".join("".join(rng.choice(list("abc"), 3)) for _ in range(8)) for _ in range(20)]
    for threshold in (0.3, 0.5, 0.8):
        needles = trigram_index.Needles(asked, threshold)
        for t in texts:
            got = {i: s for i, _, s in needles.found(t, list(range(len(asked))), [False] * len(asked))}
            grams = arrow.trigrams(t)
            want = {i: arrow.similarity_within(g, grams) for i, g in enumerate(needles.grams)}
            assert got == {i: s for i, s in want.items() if s >= threshold}
    assert blocks.TASKS >= 1


def test_few_queries_meet_all_texts_without_lists(spark, monkeypatch):
    """The same pairs as through the lists, null and empty texts and queries without a trigram among them, and no list is made for so few queries."""
    monkeypatch.setattr(trigram_index, "SCAN_BLOCK", 2)
    texts = ["The Quarterly revenue of the chip maker", "revenue quarterly rises", "it is !! what", "", None, "chip chip chip", "étè naïve été", "x" * 30, "chip maker " * 90]
    asked = ["quarterly revenue", "!!", "chip", "été", "chip maker of chips", "", None, "zzz qqq"]
    q, c = spark.createDataFrame(list(enumerate(asked)), "query_id int, query_text string"), spark.createDataFrame(list(enumerate(texts)), "chunk_id int, search_text string")
    listed = trigram_index.lexical_rank(q, c, 1000, 0.4, index=trigram_index.build(c)).collect()
    monkeypatch.setattr(trigram_index, "build", lambda chunks: pytest.fail("lists of all texts for a few queries"))
    assert sorted(listed) == sorted(trigram_index.lexical_rank(q, c, 1000, 0.4).collect()) != []


def test_fused_search_with_the_trigram_half(spark, tmp_path):
    """Ranks of both halves and their fusion, by plain loops over a few texts."""
    rng = np.random.default_rng(12)
    words = [f"w{i}ord" for i in range(30)]
    texts = [" ".join(rng.choice(words, 14)) for _ in range(40)]
    asked = [" ".join(texts[3].split()[2:8]), " ".join(texts[9].split()[:7]) + " other", "w1ord w2ord w3ord w4ord", texts[20]]
    e = rng.normal(size=(25, 8)).round(2)
    pd.DataFrame({"doc_id": range(40), "source": "s", "text": texts}).to_parquet(f"{tmp_path}/documents.parquet")
    pd.DataFrame({"item_id": range(4), "text": asked}).to_parquet(f"{tmp_path}/benchmark.parquet")
    pd.DataFrame({"vec_id": range(25), "label": 0, "embedding": e.tolist()}).to_parquet(f"{tmp_path}/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in registry.queries()["hybrid_search_trigram"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.rrf_score))
    ids = [i * 100_000 for i in range(40)]
    for n, a in enumerate(asked):
        near = sorted(((-round(float(e[n * 3 % 25] @ e[i * 7 % 25]), 9), c) for i, c in enumerate(ids)))[:24]
        grams = set(arrow.trigrams(a.lower()))
        scores = [(a.lower() in t, arrow.similarity_within(grams, arrow.trigrams(t.lower())), c) for t, c in zip(texts, ids, strict=True)]
        like = sorted(((not x, -s, c) for x, s, c in scores if x or s >= 0.6))[:24]
        score = collections.Counter()
        for ranked in ([c for _, c in near], [c for *_, c in like]):
            for place, c in enumerate(ranked, 1):
                score[c] += 1 / (50 + place)
        want = sorted(((-round(s, 9), c) for c, s in score.items()))[:8]
        assert got[n] == [(c, -s) for s, c in want]


def test_blocks_copy_rows_no_oftener_than_their_label_needs(spark, monkeypatch):
    dealt, met = [], blocks.met
    monkeypatch.setattr(blocks, "met", lambda one, two, keys, fn, schema: dealt.append((one.count(), two.count())) or met(one, two, keys, fn, schema))
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 16)
    rows = spark.range(67).selectExpr("id", "CASE WHEN id < 64 THEN id % 4 END AS label")

    def pairs(q, c):
        i, j = q["query_id"].to_numpy(), c["chunk_id"].to_numpy()
        return pa.table({"a": np.repeat(i, len(j)), "b": np.tile(j, len(i))})

    for few in (10_000, 2):  # numbers of blocks broadcast, and merged
        monkeypatch.setattr(blocks, "FEW_VALUES", few, raising=False)
        got = blocks.in_blocks(rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "chunk_id"), 8, pairs, "a long, b long", ["label"])
        assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(64) for b in range(64) if a % 4 == b % 4]
    assert dealt == [(64, 128)] * 2  # 16 rows a label: one block of questions, two parts of chunks


def test_rows_that_stream_by_are_copied_a_few_times(spark, monkeypatch):
    """Copies follow the cores and the bytes a task may hold, not the number of blocks; ties, labels, texts as ids and odd vectors rank as by one product."""
    kind, dealt = type(spark.range(0)), []
    repartition = kind.repartition
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 16)
    x = np.random.default_rng(8).integers(-2, 3, (640, 4)).astype(float)
    rows = spark.createDataFrame([(f"v{i:03d}", v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(x)] + [("none", None, 1), ("odd", [float("nan")] * 4, 1)], "id string, embedding array<double>, label int")
    q, c = rows.where("id <> 'odd'").withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "chunk_id")
    near = x @ x.T
    for by, held in ((None, 1 << 25), (["label"], 1 << 25), (None, 100 * 32), (["label"], 50 * 32)):
        monkeypatch.setattr(blocks, "HELD_BYTES", held, raising=False)
        monkeypatch.setattr(kind, "repartition", lambda self, *a: dealt.append(self.count()) or repartition(self, *a))
        ranked = search.semantic_rank(q, c, 5, by)
        monkeypatch.setattr(kind, "repartition", repartition)
        want = []
        for i in range(640):
            pool = [j for j in range(640) if not by or (i % 7 and j % 7 and i % 3 == j % 3)]
            want += [(f"v{i:03d}", n, f"v{j:03d}") for n, j in enumerate(sorted(pool, key=lambda j: (-near[i, j], j))[:5], 1)] if not by or i % 7 else []
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in ranked.collect()) == want
    assert len(dealt) == 4 and max(dealt) <= 640 * 12, dealt  # 40 blocks of queries would copy every row 40 times


def test_linkage_keeps_no_pairs(spark, monkeypatch):
    """Rounds of searches, and values that a task finishes, give what merging the nearest pair gives; the query makes no table of pairs."""
    monkeypatch.setattr(communities, "near_pairs", None)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5)) + np.repeat(rng.normal(size=(9, 5)) * 1.5, 10, axis=0)
    x[40:44] = x[40]  # copies
    rows = [(i, v.tolist(), "ab"[i % 2] if i < 80 else "c") for i, v in enumerate(x)]
    awkward = [(100, None, "a"), (101, [0.0] * 5, "a"), (102, x[1].tolist(), None), (103, [float("nan")] * 5, "b"), (104, [float("inf"), 1.0, 1.0, 1.0, 1.0], "b"), (3, x[3].tolist(), "b"), (None, x[5].tolist(), "a")]
    v = spark.createDataFrame(rows + awkward, "id long, embedding array<double>, kind string")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {i: i for i in range(100, 105)}
    for kind in "abc":
        ids = [i for i, _, k in rows if k == kind]
        want |= merged_one_by_one(ids, unit[ids], 0.3)
    for small in (2048, 12):
        monkeypatch.setattr(communities, "SMALL_CLUSTERS", small, raising=False)
        assert {r.id: r.cluster for r in communities.linkage_within(v, 0.3, "kind").collect()} == want, small
    assert communities.linkage_within(v.limit(0), 0.3, "kind").count() == 0
    plan = registry.queries()["linkage_clusters"]
    assert plan(spark, "/root/testdata/sf0.001").count() == 500


def test_written_tables_leave_no_shuffle_files(spark):
    dirs = [pathlib.Path(f.getPath()) for f in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for d in dirs for f in d.rglob("shuffle_*")}
    before, set_to = shuffled(), spark.conf.get(shared.CLEANUP, None)
    out = shared.written(spark.range(50_000).selectExpr("id % 700 AS k", "id").groupBy("k").count(), "left-over")
    for _ in range(50):  # deleted behind the query's end
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(shared.CLEANUP, None) == set_to
    assert out.agg(F.sum("count")).first()[0] == 50_000
