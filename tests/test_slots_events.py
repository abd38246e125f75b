"""Candidate places against a plain version, event rows and code sync on awkward input."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import cluster, filings
from tidemark.sources import files


def places(rows: list[tuple], most: int) -> list[tuple]:
    """(article, cluster, rank) by filling places one after another."""
    out = []
    for article in sorted({r[0] for r in rows}):
        mine = [(c, sim or 0.0, sig or 0.0, hits or 0) for a, c, sim, sig, hits in rows if a == article]
        score = lambda x: max(x[1], x[2] * 0.92)
        near = sorted((x for x in mine if x[1] >= 0.55), key=lambda x: (-x[1], x[0]))
        signed = sorted((x for x in mine if x[2] >= 0.55 and x[3] >= 2), key=lambda x: (-x[2], x[0]))
        chosen = near[: max(1, most - 1)]
        chosen += [x for x in signed[:1] if x not in chosen and len(chosen) < most]
        rest = sorted((x for x in {*near, *signed} if x not in chosen), key=lambda x: (-score(x), x[0]))
        chosen = sorted(chosen + rest[: most - len(chosen)], key=lambda x: (-score(x), x[0]))
        out += [(article, x[0], n) for n, x in enumerate(chosen, 1)]
    return out


def test_candidate_places_equal_a_plain_version(spark):
    r = random.Random(5)
    some = lambda: r.choice([None, 0.3, 0.55, 0.6, 0.7, 0.7, 0.9])
    rows = [(a, c, some(), some(), r.choice([None, 1, 2, 3])) for a in range(60) for c in range(r.randrange(8))]
    df = spark.createDataFrame(rows, "article_id long, cluster_id long, similarity double, signature double, hits int")
    for most in (1, 2, 3, 5):
        got = sorted((x.article_id, x.cluster_id, x.rank) for x in cluster.candidate_slots(df, most).collect())
        assert got == sorted(places(rows, most)), most
    assert cluster.candidate_slots(df.limit(0)).count() == 0


def test_event_rows_on_awkward_filings(spark):
    rows = [
        (1, "[정정] 정기주주총회 결과", "일시 2024년 2월 30일\n일시: 2024.3.9 오전 9시 5분 장소 : - ", "x"),
        (2, "기준일 설정", None, "x"), (3, None, "기준일 2024-01-01", "x"), (4, "현금ㆍ현물배당", "주당 현금배당금 (원) 1,250 원\n배당기준일 " + "x" * 200 + "2024-01-01", "x"), (5, "기업설명회(IR)", "y" * 300000 + "취소", "x"), (6, "기업설명회 (IR)", "취소", "x"),
    ]
    got = {r.n: r for r in filings.event_rows(spark.createDataFrame(rows, "n int, title string, raw_text string, status string")).collect()}
    assert set(got) == {1, 2, 4, 5, 6} and got[1].event_type == "shareholders_meeting" and got[1].status == "changed"
    # The label's first day is none of the calendar and no other label of the kind follows.
    assert got[1].event_date is None and got[1].location is None and got[1].start_time == "09:05:00"
    assert got[2].event_date is None and got[2].normalized == {} and got[4].amount == 1250 and got[4].event_date is None
    assert got[5].status == "scheduled" and got[6].status == "cancelled"
    day = filings.event_rows(spark.createDataFrame([("배당 기준일", "기준일 : 2024/1/2")], "title string, raw_text string")).first()
    assert day.event_date == dt.date(2024, 1, 2) and day.normalized == {"event_date": "2024-01-02"}


def test_code_sync(spark):
    kind = "stock_code string, corp_code string"
    stocks = spark.createDataFrame([("1", "a"), ("2", None), ("3", "c"), ("4", None), (None, "x"), ("5", "e")], kind)
    register = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "d"), ("3", "c"), (None, "y"), ("5", "")], kind)
    got = {r.stock_code: (r.corp_code, r.outcome) for r in files.sync_codes(stocks, register).collect()}
    assert got == {"1": ("a", "same"), "2": ("b", "changed"), "3": ("d", "changed"), "4": (None, "missing"), None: ("x", "missing"), "5": ("e", "missing")}


def test_patterns_are_tried_only_where_their_label_stands(spark):
    """A label without a day gives way to its next place and to the next label; no pattern runs over a text without its label."""
    texts = ["일시 미정, 일시 2024.3.5", "개최일시 없음" + "-" * 130 + " 일시 2024년 3월 6일", "x" * 500, None]
    rows = spark.createDataFrame([(i, "기업설명회(IR) 개최", t) for i, t in enumerate(texts)], "i int, title string, raw_text string")
    got = filings.event_rows(rows)
    assert [r.d for r in got.orderBy("i").select(F.col("event_date").cast("string").alias("d")).collect()] == ["2024-03-05", "2024-03-06", None, None]
    tried = str(filings._after(F.col("raw_text"), ("일시", "시간"), "(x)", 9, lambda g: g(1)))
    assert tried.count("contains(raw_text") == tried.count("regexp_extract(") == 2
