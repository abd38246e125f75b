"""Filings and news operators on literal frames."""

from pyspark.sql import functions as F

from tidemark.operators import filings, news


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_statement_rows(spark):
    cols = "stock_code string, bsns_year string, reprt_code string, fs_div string, ord int, account_id string, account_nm string, thstrm_amount string, thstrm_add_amount string, frmtrm_amount string, frmtrm_q_amount string, frmtrm_add_amount string"
    api = [
        ("s", "2025", "11014", "CFS", 1, "ifrs-full_Revenue", "x", "1,000", "3,000", None, "900", "2,700"),
        ("s", "2025", "11014", "CFS", 2, "other", "매출액", "5", None, None, None, None),
        ("s", "2025", "11014", "CFS", 3, "none", "자산총계", "70", None, "60", None, None),
        ("s", "2025", "11014", "CFS", 4, "none", "영업이익", "-", None, None, None, None),
    ]
    got = filings.statement_rows(spark.createDataFrame(api, cols)).select("account_nm", "thstrm_amount", "frmtrm_amount", "amount_type")
    assert rows(got) == sorted([("매출액", 1000, 900, "quarter"), ("매출액", 3000, 2700, "cumulative"), ("자산총계", 70, 60, "point_in_time")])


def test_facts_limit_before_nulls(spark):
    df = spark.createDataFrame([("s", "a", "2025", "11011", "CFS", "cumulative", None), ("s", "a", "2024", "11011", "CFS", "cumulative", 5), ("s", "a", "2023", "11011", "CFS", "cumulative", 7)], "stock_code string, account_nm string, bsns_year string, reprt_code string, fs_div string, amount_type string, thstrm_amount long")
    assert rows(filings.financial_facts(df, "s", ["a"], limit=2).select("bsns_year", "shown")) == [("2024", "5원")]
    assert filings.financial_facts(df, "s", ["a"], year="2022").count() == 0


def test_profile_fields_and_types(spark):
    one = filings.company_profile(spark.createDataFrame([("s", '{"corp_name":" A ","hm_url":"","est_dt":"19690113"}')], "stock_code string, payload string")).first()
    assert one.corp_name == "A" and one.homepage is None and str(one.est_dt) == "1969-01-13"
    m = F.create_map(*[F.lit(x) for x in ("aq_dd", "2024년 1월 2일", "n", "1,200", "p", "-", "q", "note")])
    got = spark.range(1).select(filings.map_fields(m, {"n": "shares"}, {"aq_dd": "day"}, {"p": "purpose"}, ["shares", "purpose"]).alias("x"), filings.typed_fields(m).alias("t")).first()
    assert got.x["values"] == {"shares": "1200", "day": "2024-01-02"} and got.x["missing"] == ["purpose"]
    assert [(e["key"], e["kind"]) for e in got.t] == [("aq_dd", "date"), ("n", "number"), ("q", "text")]


def test_documents_to_fetch(spark):
    f = spark.createDataFrame([("1", "사업보고서", False, "2024-05-01", False, "", None), ("2", "합병", False, "2024-05-02", False, "text", "success"), ("3", "합병", True, "2024-05-03", False, "text", "success"), ("4", "x", False, "2024-05-04", True, None, "unavailable")], "rcept_no string, title string, truncated boolean, disclosed_at string, is_correction boolean, raw_text string, parse_status string").withColumn("disclosed_at", F.col("disclosed_at").cast("timestamp"))
    assert [r.rcept_no for r in filings.needing_text(f, F.expr("TIMESTAMP '2024-06-01'")).collect()] == ["3", "1"]


def test_news_queues(spark):
    members = spark.createDataFrame([(1, 11, 2, "p", "u1"), (1, 10, 1, "q", "u2"), (1, 12, 3, "p", "u3")], "cluster_id int, article_id int, published_at int, press string, url string")
    s = news.cluster_sources(members).first()
    assert s.article_ids == [10, 11, 12] and s.publishers == ["q", "p"] and s.source_count == 2
    assert news.label_template(news.cluster_sources(members)).first().article_ids == "10|11|12"
    before, after = (spark.createDataFrame(x, "cluster_id int, article_count int") for x in ([(1, 2), (2, 5)], [(1, 3), (2, 5), (3, 1)]))
    assert rows(news.dirty_clusters(before, after)) == [(1,), (3,)]
    cell = spark.range(1).select(news.repair_cell(F.lit("1 ,234 . 5")).alias("c"), news.english_name(F.lit("Exchange Traded Fund; ETF")).alias("e")).first()
    assert cell.c == "1,234.5" and tuple(cell.e) == ("Exchange Traded Fund", "ETF")
    a, b = news.glossary_differences(spark.createDataFrame([("A B",), ("C",)], "term string"), spark.createDataFrame([("ab/d",)], "term string"))
    assert rows(a) == [("c",)] or rows(a) == [("ab",), ("c",)]
    blind, key = news.blind_sample(members.withColumn("stock_code", F.lit("s")))
    assert "cluster_id" not in blind.columns and key.count() == 3


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("a", "u1")], "split string, unit string")
    news.write_splits(df, f"{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"{tmp_path}/s/manifest").count() == 2
    for _ in range(2):
        news.log_failures(df.limit(1), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2


def test_names_cells_and_reasons(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(news.repair_cell(F.lit("25358 27134 , , 합계"))) == "25,358 27,134 합계" and one(news.repair_cell(F.lit("7 %"))) == "7%"
    assert one(news.repair_cell(F.lit(None).cast("string"))) is None and one(news.repair_cell(F.lit(""))) == ""
    assert tuple(one(news.english_name(F.lit("한글 Name")))) == (None, None) and one(news.abbreviations(F.lit("AB; Cd Ef: GH"))) == ["AB", "GH"]
    assert tuple(one(news.english_name(F.lit(None).cast("string")))) == (None, None)
    name = lambda t, d: one(news.defined_name(F.lit(t), F.lit(d)))["english"]
    assert name("용어", "이 용어(Full Name)는") == "Full Name" and name("용어", "용어 (Full Name)") is None and name("", "(Full Name)") is None
    candidates = F.array(F.struct(F.lit(3).alias("cluster_id"), *[F.lit(0.5).alias(n) for n in ("centroid", "prototype", "signature")]))
    assert one(news.reason(F.lit("new"), candidates)) == "new | candidates=3:c0.5000/p0.5000/s0.5000"
    assert one(news.reason(F.lit("new"), F.slice(candidates, 1, 0))) == "new"
