"""Every registered query against its SQL, and the shape of the registry."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v.tolist() if hasattr(v, "tolist") else v)

    df = df[sorted(df.columns)].map(one)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, con, name):
    got = plain(registry.queries()[name](spark, sf).toPandas())
    want = plain(con.execute(registry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_whole_questions(spark, tmp_path):
    start = "the quarterly revenue of the chip maker rose"  # 44 signs
    texts = [start + " by a third in spring", start + " while nobody at all was looking at it", "semiconductorsandotherverylongthingswithoutblanks", "quiet"]
    pd.DataFrame({"doc_id": range(4), "source": "s", "text": texts}).to_parquet(f"{tmp_path}/documents.parquet")
    pd.DataFrame({"item_id": [0, 1], "text": [texts[0], "semiconductors"]}).to_parquet(f"{tmp_path}/benchmark.parquet")
    pd.DataFrame({"vec_id": range(40), "label": 0, "embedding": [[float(i == j) for j in range(40)] for i in range(40)]}).to_parquet(f"{tmp_path}/embeddings.parquet")
    lexical = registry.queries()["lexical_search"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.chunk_id) for r in lexical if r.exact} == {(0, 0), (1, 200_000)}
    whole = registry.queries()["search_with_context"](spark, str(tmp_path)).collect()
    assert [r.chunk_id for r in sorted(whole, key=lambda r: r["rank"]) if r.query_id == 0][0] == 0
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    got, want = registry.queries()["hybrid_search"](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()["hybrid_search"]).df()
    pd.testing.assert_frame_equal(plain(got), plain(want))


@pytest.mark.parametrize("folder", [False, True])
def test_streams_read_files_and_folders(spark, sf, tmp_path, folder):
    for t in ("events", "embeddings"):
        df = pd.read_parquet(f"{sf}/{t}.parquet")
        if folder:
            spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
        else:
            df.to_parquet(f"{tmp_path}/{t}.parquet")
            df.to_parquet(f"{tmp_path}/{t}_x.parquet")  # another table
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet{'/*.parquet' if folder else ''}')")
    for name in ("stream_tumbling", "stream_merge"):
        pd.testing.assert_frame_equal(plain(registry.queries()[name](spark, str(tmp_path)).toPandas()), plain(con.execute(registry.oracle_sql()[name]).df()))
    got = registry.queries()["stream_clusters"](spark, str(tmp_path))
    assert got.count() == got.select("article_id").distinct().count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_entry_lists_everything():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_knows_the_training_data_queries():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "tidemark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = registry.queries()["fil_predicates"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "ReadSchema: struct<o_orderkey" in plan and "c_name" not in plan


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"stream_tumbling", "stream_merge", "stream_clusters", "stream_clusters_resumed", "stream_cycle", "graph_communities", "linkage_clusters"}))
def test_no_query_crosses_rows(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan, name


def test_values_that_round_or_divide_apart_are_as_in_sql(spark, tmp_path):
    day, us = pd.Timestamp("2024-01-01"), lambda x: pd.to_datetime(pd.Series(x)).astype("datetime64[us]")
    pairs = [(0.0, 5.0), (0.0, 0.0), (0.0, -5.0), (40.0, 0.09), (40.0, 0.39), (80.0, 5.03), (8.0, 0.01)]
    events = [(2 * i + j, day + pd.Timedelta(days=j), i, v) for i, pair in enumerate(pairs) for j, v in enumerate(pair)]
    # Gaps of an hour, a microsecond more, and half a second more that whole seconds don't show.
    at = [pd.Timedelta(0), pd.Timedelta(hours=1), pd.Timedelta(hours=2, microseconds=1), pd.Timedelta(hours=3, microseconds=500_001)]
    events += [(100 + i, day + t, 99, 1.0) for i, t in enumerate(at)]
    ids, ts, users, values = zip(*events)
    pd.DataFrame({"event_id": ids, "ts": us(ts), "user_id": users, "event_type": "view", "value": values, "props": "{}"}).to_parquet(f"{tmp_path}/events.parquet")
    prices = [100_000 + 5_000 * i for i in range(40)] + [1e9 + 5e6 * i for i in range(40)] + [115_000.01, 999_999_999.99, 99_999.99]
    pd.DataFrame({"o_orderkey": range(len(prices)), "o_totalprice": [float(p) for p in prices]}).to_parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    for name in ("activity_sessions", "text_money", "market_overview", "price_changes"):
        pd.testing.assert_frame_equal(plain(registry.queries()[name](spark, str(tmp_path)).toPandas()), plain(con.execute(registry.oracle_sql()[name]).df()))
