"""Text functions on literal cases, against plain Python where there is one."""

import datetime as dt
import json
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrow, models, pages, text, vectors
from tidemark.functions import fixed_values as V
from tidemark.ship import ship


@pytest.fixture(scope="module")
def value(spark):
    ship(spark)

    def one(column, **given):
        row = spark.createDataFrame([(1,)], "one int").select(*[(F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v])).alias(k) for k, v in given.items()]) if given else spark.range(1)
        return row.select(column.alias("x")).first()["x"]

    return one


@pytest.mark.parametrize("url, want", [
    ("HTTPS://WWW.News.Example.com//a//b/?utm_source=x&b=2&a=1#top", "https://news.example.com/a/b?a=1&b=2"),
    ("http://example.com", "http://example.com/"),
    ("http://example.com/?fbclid=9", "http://example.com/"),
    ("https://e.com/x/?q", "https://e.com/x?q="),
])
def test_canonical_url(value, url, want):
    assert value(text.canonical_url("u"), u=url) == want == value(arrow.canonicalize_url("u"), u=url)


def test_hosts(value):
    assert value(text.host("u"), u="https://user@WWW.A.B.co.kr:8080/x") == "a.b.co.kr"
    assert value(text.host_suffixes(F.lit("a.b.co"))) == ["a.b.co", "b.co", "co"]


def test_cleaning(value):
    assert value(text.compact_whitespace("t"), t=" a  b\t\tc\n\n\n\nd ") == "a b c\n\nd"
    assert value(text.normal_lines("t"), t="  a   b \r\n\r\n\r\n\r\n c&amp;d ") == "a b\n\nc&d"
    assert value(text.strip_tags("t"), t="<b>x</b> &lt;y&gt;<br>z") == "x <y> z"
    assert value(arrow.strip_html("t"), t="<b>x</b> &quot;y&quot; <script>no</script>z") == 'x "y" z'
    assert value(text.sentiment_text("t"), t="# Title\n- **bold** [link](http://x) <i>t</i>") == "Title bold link t"
    assert value(text.clean_body("t"), t="line one\nx\nline one\nAll rights reserved\n  two  ") == "line one\nAll rights reserved\ntwo"
    gone = "무단 전재 및 재배포 금지\n저작권자(c) 어디든 금지\n아무개 기자 (a@b.kr)\n제보는 카카오톡 어디\n댓글\n앱에서 읽기"
    kept = "무단 전재\n재배포 금지\n저작권자\n기자 (전화)\n댓글 3개\n로그인 하기"
    assert value(text.clean_body("t"), t=f"{gone}\n{kept}") == kept
    assert value(arrow.normalize_content("t"), t="ＡＢＣ　１２") == "ABC 12"
    assert value(text.search_text("a", "b"), a="X\nY", b="") == "x y"
    assert value(text.markup_to_text("t"), t="<?x y?><p>a</p><!-- c --><td>b</td>&lt;") == "a\nb <"


def test_parsing(value):
    day = dt.datetime(2024, 2, 9)
    for t in ("20240209", "2024-2-9", "2024년 2월 9일", " 2024.02.09 "):
        assert value(text.flexible_date("t"), t=t) == day
    assert value(text.flexible_date("t"), t="20241399") is None
    assert [value(text.amount("t"), t=t) for t in ("1,234", "-5", "-", "", "1.5", "12a")] == [1234, -5, None, None, None, None]
    assert value(text.rfc2822("t"), t="Mon, 05 Feb 2024 09:00:00 +0900") == dt.datetime(2024, 2, 5)
    assert value(text.first_sentence("t"), t="쉽게 말해, **A** rose! Then fell. End") == "A rose! Then fell."
    assert value(text.first_sentences("t"), t="A. B! C?") == "A. B!"
    assert value(text.normal_title("t"), t="[기재정정][첨부] 사업 보고서") == "사업보고서"
    assert value(text.first_submission_date("t"), t="정정대상 공시서류의 최초제출일 : 2023년 3월 4일") == dt.date(2023, 3, 4)
    assert value(text.json_object("t", "struct<a:int>"), t='noise {"a": 3} end')["a"] == 3
    assert value(text.bad_citations("t", F.lit(2)), t="x [1] [3] [0] [3]") == [0, 3]
    assert value(text.term_candidates("t"), t="유상증자는?")[:2] == ["유상증자는", "유상증자"]
    assert [value(text.is_abbreviation("t"), t=t) for t in ("ETF", "Etf", "E T", "KOSPIa")] == [True, False, False, True]


def test_rules(value):
    assert value(text.market_score("t", "d"), t="코스피 급락", d="") == 2.0
    assert value(text.kind("t", "d"), t="코스피 급락 마감", d="") == "market"
    assert value(text.kind("t", "d"), t="오늘의 추천 종목", d="") == "info"
    assert value(text.kind("t", "d"), t="추천 종목 수주", d="") == "company"
    assert value(text.mentions("t", ["Acme", "Acme Motor", "005930"]), t="ACME MOTOR and acme, 1005930 005930") == 3
    plan = text.query_plan("q")
    assert value(plan["need_reports"], q="목표주가 전망") and not value(plan["need_documents"], q="목표주가 전망")
    assert value(plan["stock_code"], q="code 123456 now") == "123456" and value(plan["need_documents"], q="hello")
    s, n = text.signature_similarity({"core_subjects": "a", "core_topic": "b", "unique_anchors": "c"}, {"core_subjects": "d", "core_topic": "e", "unique_anchors": "f"})
    given = {"a": "acme", "b": "new plant", "c": "", "d": "acme", "e": "new plant opens", "f": "x"}
    assert math.isclose(value(s, **given), (0.30 + 0.35 * 0.9) / 0.65) and value(n, **given) == 2
    now, old = "TIMESTAMP '2024-06-01'", "TIMESTAMP '2020-01-01'"
    p = lambda title, at, cut=False, corr=False: value(text.document_priority(F.lit(title), F.lit(cut), F.expr(at), F.lit(corr), F.expr(now)))
    assert [p("주식등의대량보유상황보고서", now, True), p("x", old, True), p("사업보고서", old), p("합병", old), p("합병", now), p("x", now, corr=True), p("x", now)] == ["low", "required", "required", "skip", "important", "important", "skip"]


def test_formats(value):
    assert [value(text.format_won("v"), v=v) for v in (5, -1234, 150_000_000, 2_340_000_000_000)] == ["5원", "-1,234원", "1.5억원", "2.34조원"]
    assert [value(text.format_won_eok("v"), v=v) for v in (1_230_000_000_000, -2_000_000_000_000, 49_000_000)] == ["1조 2,300억원", "-2조원", "0억원"]
    assert value(text.change_rate("a", "b"), a=11.0, b=10.0) == 10.0 and value(text.change_rate("a", "b"), a=1.0, b=0.0) is None
    assert value(text.kst_day(F.expr("TIMESTAMP '2024-01-01 15:00:00'"))) == "2024-01-02"
    assert value(text.clamp("t", 3), t="abcd") == "abc…"
    assert value(text.fixed_chunks("t", 2), t="abcde") == ["ab", "cd", "e"] and value(text.fixed_chunks("t", 2), t="") == []


def test_keys(value):
    fields = F.create_map(F.lit("b"), F.lit('x"y'), F.lit("a"), F.lit("1"), F.lit("c"), F.lit(""))
    want = json.dumps({"source_api": "s", "rcept_no": "", "fields": {"b": 'x"y', "a": "1"}}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert value(text.record_key(F.lit("s"), F.lit(None).cast("string"), fields)) == hashlib.sha256(want.encode()).hexdigest()
    rows = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    assert not value(text.has_business_content(rows("status", "ok", "stlm_dt", "x", "se", " - "))) and value(text.has_business_content(rows("se", "5")))
    assert value(text.summary_text(F.lit("A"), rows("status", "ok", "se", "5", "q", "-"))) == "A / se: 5"


def brute_similarity(query, body):
    q, t = set(arrow.trigrams(query)), arrow.trigrams(body)
    return max((len(q & set(t[i:j])) / len(q | set(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)), default=0.0)


@pytest.mark.parametrize("query, body", [("word", "two words"), ("hybrid search", "a search that is hybrid"), ("abc", "xyz"), ("same text", "same text"), ("late night", "the lateness of nights, late at night")])
def test_word_similarity(value, query, body):
    assert math.isclose(value(arrow.word_similarity("q", "t"), q=query, t=body), brute_similarity(query, body))


def test_chunks():
    short, long = "a" * 1200, "\n\n".join(["p" * 500, "q" * 500, "r" * 300])
    assert arrow.split_long("") == [] and arrow.split_long(short) == [short]
    got = arrow.split_long(long)
    assert got[0] == "p" * 500 and got[1].startswith("p" * 100 + "\n\nq") and len(got) <= 3
    assert [len(x) for x in arrow.split_long("z" * 3000)] == [900, 900, 900]


def test_pages(value):
    page = '<html><head><title> T </title><meta property="og:image" content="/i.png"><link rel="amphtml" href="http://a/amp"><meta http-equiv="refresh" content="0; url=/next"><script type="application/ld+json">{"x":[{"articleBody":"the body"}]}</script></head><body><p>one</p><p>two</p></body></html>'
    got = value(pages.found(F.lit("https://s.com/a"), "h"), h=page)
    assert (got.title, got.image, got.amp, got.refresh) == ("T", "https://s.com/i.png", "http://a/amp", "https://s.com/next")
    assert value(pages.best_body(pages.found(F.lit("https://s.com/a"), "h")), h=page) == "the body" and value(text.clean_body(arrow.page_text("h")), h=page).split("\n")[-2:] == ["one", "two"]


def test_vectors_and_models(value, spark):
    a = [3.0, 4.0]
    assert value(vectors.unit("a"), a=a) == [0.6, 0.8] and value(vectors.cosine("a", "b"), a=a, b=[0.0, 0.0]) == 0.0
    s = value(models.sentiment("l"), l=[2.0, 1.0, 0.0])
    e = np.exp([2.0, 1.0, 0.0])
    assert s["label"] == "positive" and math.isclose(s["score"], e[0] / e.sum()) and math.isclose(s["negative"], e[2] / e.sum())
    assert value(models.sentiment(F.lit(None).cast("array<double>")))["label"] == "unknown"
    assert tuple(value(models.shown_sentiment(F.lit("positive"), F.lit(0.5)))) == ("neutral", None, "low_confidence")

    def flaky():
        def model(xs):
            if "bad" in xs:
                raise ValueError("bad")
            return [len(x) for x in xs]

        return model

    got = models.apply_model(spark.createDataFrame([("a",), ("bad",), ("ccc",)], "t string"), "t", flaky, "n", "int").collect()
    assert [(r.t, r.n) for r in got] == [("a", 1), ("bad", None), ("ccc", 3)]


def test_models_get_one_batch_as_values_and_leave_other_columns_alone(spark):
    def seen():
        return lambda xs: [f"{len(xs)} {type(xs[-1]).__name__}" for _ in xs]

    rows = spark.range(0, 1201, 1, 1).selectExpr("CASE WHEN id % 100 < 99 THEN id END AS x", "TIMESTAMP '9999-12-31 00:00:00' AS far")
    got = models.apply_model(rows, "x", seen, "said", "string", batch=100)
    # A null stays one among whole numbers, and a time that pandas can't hold passes by.
    assert {r.said for r in got.select("said").collect()} == {"100 NoneType", "1 int"}
    assert got.where("far = TIMESTAMP '9999-12-31 00:00:00'").count() == 1201


def test_models_get_full_batches_whatever_arrow_holds(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(key), spark.range(0, 1201, 1, 1).selectExpr("id AS x")
    try:
        for size in ("7", "1024"):
            spark.conf.set(key, size)
            got = models.apply_model(rows, "x", lambda: lambda xs: [f"{len(xs)} {x}" for x in xs], "said", "string", batch=100).collect()
            assert [r.said for r in got] == [f"{100 if x < 1200 else 1} {x}" for x in range(1201)]
    finally:
        spark.conf.set(key, before)


def test_tables(value):
    kinds = value(text.column_kinds("h"), h=["2023A", "2024E", "2025F", "x"])
    assert kinds == ["actual", "estimate", "forecast", "unknown"]
    assert value(text.table_kind("k"), k=["actual", "estimate"]) == "mixed"
    cells = F.array(F.array(F.lit("1,000"), F.lit("2")), F.array(F.lit("a"), F.lit("3%")))
    assert not value(text.narrative_table(cells)) and value(text.narrative_table(F.array(F.array(F.lit("only words"), F.lit("here")))))


def test_titles_terms_units_and_signatures(value):
    assert value(text.is_opinion("t"), t="[사설] 제목") and not value(text.is_opinion("t"), t="광장에서") and not value(text.is_opinion(F.lit(None).cast("string")))
    assert value(text.term_candidates("t"), t="PER이 뭐야?") == ["PER이", "PER"] and value(text.term_candidates("t"), t="") == []
    assert value(text.units("t"), t="억원 % 억원 배") == ["억원", "%", "배"] and value(text.units(F.lit(None).cast("string"))) == []
    assert value(text.column_kinds("h"), h=["2024P", "1Q2025 F", "가이던스", "2024Average"]) == ["estimate", "forecast", "guidance", "unknown"]
    s = value(text.event_signature("j"), j='{"subject": "a", "action": "b", "object": " c", "amount": ["1", "1"], "identifiers": "2"}')
    assert tuple(s) == (["a"], "b c", ["1", "2"], "unknown")
    assert tuple(value(text.event_signature("j"), j="none")) == ([], None, [], "unknown")
    assert tuple(value(text.event_signature("j"), j='{"core_topic": "t", "story_relation": "reaction"}')) == ([], "t", [], "reaction")


def test_info_patterns_are_tried_where_one_of_their_words_stands(spark):
    """Every form of every pattern holds one of its words, and the score counts what all patterns tried on every text count."""
    import re
    from re import _constants as K
    from re import _parser

    def forms(parts) -> set[str]:
        out = {""}
        for op, x in parts:
            if op is K.LITERAL:
                some = {chr(x)}
            elif op is K.IN:
                some = {"7" if x[0][1] is K.CATEGORY_DIGIT else " "} if x[0][0] is K.CATEGORY else {"x" if x[0][0] is K.NEGATE else chr(x[0][1][0] if x[0][0] is K.RANGE else x[0][1])}
            elif op is K.BRANCH:
                some = set().union(*map(forms, x[1]))
            elif op is K.SUBPATTERN:
                some = forms(x[3])
            elif op is K.MAX_REPEAT:
                some = {s * n for s in forms(x[2]) for n in {x[0], x[0] + 1} if n <= x[1]}
            else:
                some = {"" if op is K.AT else "x"}
            out = {a + b for a in out for b in some}
        return out

    name_list = r"[가-힣A-Za-z]{2,}[·,]\s*[가-힣A-Za-z]{2,}[·,]\s*[가-힣A-Za-z]{2,}"
    texts = {"", "a,b,c", "ab,cd,ef", "xab, cd· ef", "ab,c,de", "ab,cd,,ef", "ab cd,ef,gh"}
    for p, words in zip(V.INFO_PATTERNS, V.INFO_WORDS, strict=True):
        here = {x for x in forms(_parser.parse(p)) if re.search(p, x)}
        assert here and all(any(w in x for w in words) for x in here), p
        texts |= {f"뉴스 {x}" for x in sorted(here)[:4]}
    texts = sorted(texts)
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(text.info_score("t").alias("n")).collect()]
    assert got == [sum(bool(re.search(p, t)) for p in [*V.INFO_PATTERNS, name_list]) for t in texts]


def test_pages_go_back_a_few_at_a_time(spark, monkeypatch):
    """Rows meet their own pages, whatever the number that goes back at once; pages without a text among them."""
    monkeypatch.setattr(pages, "PAGES", 2)
    ship(spark)
    html = [f"<title>t{i}</title><article>text {i}</article>" if i % 3 else [None, ""][i % 2] for i in range(11)]
    rows = spark.createDataFrame(list(enumerate(html)), "i int, h string").coalesce(1)
    assert {r.i: r.t for r in rows.select("i", pages.found(F.lit("https://a.example/"), F.col("h"))["title"].alias("t")).collect()} == {i: f"t{i}" if i % 3 else None for i in range(11)}
