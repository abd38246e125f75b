"""Tools as table functions in SQL."""

import pytest

from tidemark.functions import fixed_values as V
from tidemark.functions import tools


def test_envelopes(spark):
    tools.register(spark)
    rows = [(q, r, f"c{q}{r}" if q < 3 else None, f"t{r}", "x" * 600 if r == 1 else " y ", "z") for q in range(4) for r in (range(9, 0, -1) if q < 3 else [1])]
    spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, title string, snippet string, other string").createOrReplaceTempView("hits_of_tools")
    got = {r.query_id: r for r in spark.sql("SELECT * FROM search_news(TABLE(hits_of_tools), 4, array('a'), array('b', 'c'))").collect()}
    assert set(got) == {0, 1, 2, 3} and got[3].status == "no_data" and got[3].warnings == [V.NO_NEWS] and got[3].items == []
    first = got[1]
    assert first.status == "ok" and [i.title for i in first["items"]] == ["t1", "t2", "t3", "t4"] and [s.source_id for s in first.sources] == ["c11", "c12", "c13", "c14"]
    assert first["items"][0].snippet == "x" * 500 + "…" and first["items"][1].snippet == "y" and set(first["items"][0].asDict()) == {"title", "snippet"}
    assert first.warnings == [V.EXCLUDED.format(["a"]), V.INCLUDED.format(["b", "c"])]
    plain = spark.sql("SELECT query_id, size(items) AS n, warnings FROM search_research_reports(TABLE(SELECT * FROM hits_of_tools WHERE query_id < 3))").collect()
    assert all(r.n == 5 and r.warnings == [V.FORECASTS] for r in plain) and len(plain) == 3


def test_wrong_calls(spark):
    tools.register(spark)
    spark.createDataFrame([(1, 1, "a")], "query_id long, rank int, chunk_id string").createOrReplaceTempView("narrow_hits")
    assert spark.sql("SELECT * FROM search_news(TABLE(narrow_hits))").first().status == "ok"
    assert spark.sql("SELECT * FROM search_news(TABLE(SELECT * FROM narrow_hits WHERE rank > 1))").count() == 0
    for call, says in (("search_disclosures(TABLE(narrow_hits))", "lacks rcept_no"), ("search_news(TABLE(narrow_hits), 13)", "from 1 to 12"), ("search_news(1)", "must be a table")):
        with pytest.raises(Exception, match=says):
            spark.sql(f"SELECT * FROM {call}").collect()
