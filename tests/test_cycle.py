"""The bucketed store and the staged cycle: switches, conflicts, kills between stages, recovery."""

import datetime
import os

import pytest

from tidemark.operators.buckets import BucketStore, Conflict
from tidemark.plans.retrieval import news_stages
from tidemark.streaming import cycle, jobs

ROWS = "article_id long, stock_code long, kind string, value double, ts timestamp"
START = datetime.datetime(2026, 1, 1)


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def article(i, hours=0.0, value=50.0, kind="view"):
    return (i, i % 3, kind, value, START + datetime.timedelta(hours=hours))


BATCHES = [[article(i, i) for i in range(8)], [article(i, i, value=i * 6.0) for i in range(6, 16)], [article(20, 30, kind="error"), article(21, 31, value=95.0), article(22, 31)]]


def state(store):
    now = store.snapshot()
    return {t: sorted(map(tuple, store.read(t, now).drop("number", "last_at").collect()), key=str) for t in now.tables}


def test_killed_between_stages_is_as_if_not(spark, tmp_path):
    whole = BucketStore(spark, f"file://{tmp_path}/whole", 4)
    jobs.run_once(feed(spark, f"{tmp_path}/in", BATCHES), f"{tmp_path}/c1", batch=cycle.cycle(whole, news_stages()))
    killed, seen = BucketStore(spark, f"file://{tmp_path}/killed", 4), []

    def before(stage):
        seen.append(stage)
        if len(seen) in (3, 11):
            raise RuntimeError(f"killed before {stage}")

    s = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):
        with pytest.raises(Exception, match="killed before"):
            jobs.run_once(s, f"{tmp_path}/c2", batch=cycle.cycle(killed, news_stages(), before))
    jobs.run_once(s, f"{tmp_path}/c2", batch=cycle.cycle(killed, news_stages(), before))
    assert state(killed) == state(whole)
    runs = killed.read("runs").collect()
    assert len(runs) == 18 and len({(r.batch, r.stage) for r in runs}) == 18 and {r.status for r in runs} == {"done"}
    assert {r.stage: r.rows for r in runs if r.batch == 0}["collect"] == {"articles": 8}
    assert {r.cluster_id: r.n for r in killed.read("clusters").collect()} == {c: n for c, n in [(f"{k}:2026-01-01", sum(1 for i in range(16) if i % 3 == k and (i < 6 or i * 6 <= 90))) for k in range(3)] + [("1:2026-01-02", 1)]}


def test_rows_left_open_are_recovered_within_48_hours(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/t", 2)
    stages = news_stages()
    stages[4].skip = lambda batch, read: batch.where("article_id = 1").count() > 0  # another run holds the clusters during the first batch
    stages[5].work = lambda batch, read: 1 / 0
    s = feed(spark, f"{tmp_path}/in", [[article(1, 0), article(2, 30)], [article(3, 60)]])
    jobs.run_once(s, f"{tmp_path}/c", batch=cycle.cycle(store, stages))
    assert {r.article_id: r.cluster_id is not None for r in store.read("articles").collect()} == {1: False, 2: True, 3: True}
    runs = {(r.batch, r.stage): r for r in store.read("runs").collect()}
    assert runs[0, "cluster"].status == "skipped" and runs[1, "cluster"].rows == {"articles": 2}
    assert runs[0, "summary"].status == runs[1, "summary"].status == "failed" and "ZeroDivisionError" in runs[1, "summary"].error


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_merge_writes_the_buckets_that_it_touches(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/t", 16)
    rows = spark.range(4000).selectExpr("id", "id % 7 AS v", "0 AS at")
    store.commit({"big": (rows, ["id"], "at"), "small": (rows.limit(5), ["id"], "at")})
    held, before = store.snapshot(), files(tmp_path)
    store.commit({"big": (spark.createDataFrame([(11, 100, 1), (11, 99, 0)], "id long, v long, at int"), ["id"], "at"), "small": (spark.createDataFrame([(1, 5, 1)], "id long, v long, at int"), ["id"], "at")})
    new = {k: v for k, v in files(tmp_path).items() if k not in before}
    assert len(new) == 2 and sum(new.values()) < sum(before.values()) / 8
    now = store.snapshot()
    assert sum(now.tables["big"]["buckets"][b] != v for b, v in held.tables["big"]["buckets"].items()) == 1
    one = lambda at: store.read("big", at).where("id = 11").first().v
    assert (one(held), one(now)) == (4, 100) and store.read("big").count() == 4000
    # What no manifest names any longer goes; what readers of the newest hold stays.
    assert store.clean(keep=1) == 2 and store.read("big").count() == 4000 and store.read("none") is None


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    one, two = (BucketStore(spark, f"file://{tmp_path}/t", 2) for _ in range(2))
    row = spark.createDataFrame([(1, 1)], "id long, at int")
    base = two.snapshot()
    one.commit({"t": (row, ["id"], "at")})
    with pytest.raises(Conflict):
        two.switch(base, {"t": two.stage("t", row, ["id"], "at", base)})
    assert one.snapshot().number == 1


def test_an_empty_batch_is_a_batch(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/t", 2)
    row = spark.createDataFrame([(None, 1), (2, 1), (2, 2)], "id long, at int")
    store.commit({"t": (row.limit(0), ["id"], "at")})
    assert store.read("t").count() == 0
    store.commit({"t": (row, ["id"], "at")})
    assert sorted(map(tuple, store.read("t").collect()), key=str) == [(2, 2), (None, 1)]


def test_a_batch_merges_its_runs_once(spark, tmp_path, monkeypatch):
    """Until the last stage the ledger holds the rows of `runs`, also those of a batch that never went on."""
    staged, stage = [], BucketStore.stage
    monkeypatch.setattr(BucketStore, "stage", lambda self, table, *rest: staged.append(table) or stage(self, table, *rest))
    store = BucketStore(spark, f"file://{tmp_path}/t", 70)
    batch = spark.createDataFrame(BATCHES[0], ROWS)
    stages = [cycle.Stage("one", lambda b, read: {"a": (b.select("article_id", "ts"), ["article_id"], "ts")}), cycle.Stage("two", lambda b, read: {})]

    def before(name):
        if name == "two":
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        cycle.cycle(store, stages, before)(batch, 0)
    assert [r[:3] for r in store.snapshot().ledger["runs"]] == [[0, "one", "done"]] and store.read("runs") is None
    cycle.cycle(store, stages)(spark.createDataFrame(BATCHES[1], ROWS), 1)
    assert staged.count("runs") == 1 and store.snapshot().ledger["runs"] == []
    assert sorted((r.batch, r.stage, r.rows.get("a")) for r in store.read("runs").collect()) == [(0, "one", 8), (1, "one", 10), (1, "two", None)]
    assert sorted(r.article_id for r in store.read("a").collect()) == list(range(16))
