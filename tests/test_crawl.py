"""Pages of every form through the tree and the crawl's joins."""

import json

from pyspark.sql import functions as F

from tidemark.functions import pages as P
from tidemark.operators.crawl import crawl

LONG = "\n".join(f"Line {i} of an article that says one thing more." for i in range(8))
OTHER = "\n".join(f"Row {i} of the other text, which is rather longer than the first." for i in range(9))


def page(body: str, head: str = "") -> str:
    return f"<html><head><title> A  title </title>{head}</head><body>{body}</body></html>"


def best(spark, html: str | None, url: str = "https://a.com/1") -> str:
    df = spark.createDataFrame([(url, html)], "url string, html string").select(P.found("url", "html").alias("f"))
    return df.select(P.best_body(F.col("f")).alias("b")).first()["b"]


def test_tree_spans_and_selectors():
    t = P.Tree('<div id="x" class="story-news article">a<p>one<p>two <b>bold</b> end<br>more</div>tail<script>hid<b>den</script></i>')
    assert t.text(t.first("#x"), "|") == "a|one|two|bold|end|more" and t.first("div.article.story-news") == 0 and t.first("#y") is None
    assert [t.text(at, " ") for at in t.all("p")] == ["one", "two bold end more"]
    assert t.raw(next(t.all("script"))) == "hid<b>den" and "hid" not in t.text(0, "")
    many = P.Tree("<p>x" * 5000)
    assert sum(len(many.text(at, "")) for at in many.all("p")) == 5000


def test_each_extractor(spark):
    lines = LONG.split("\n")
    elements = {"content_elements": [{"type": "text", "content": lines[0]}, {"type": "list", "items": [{"type": "quote", "content": f"<i>{lines[1]}</i>"}, {"type": "image", "content": "no"}]}, *[{"type": "header", "content": x} for x in lines[2:]]]}
    assert best(spark, page(f"<script id='fusion-metadata'>x=1;Fusion.globalContent={json.dumps(elements)};Fusion.y=2</script>")) == LONG
    arranged = {"q": [{"contentArrange": [{"type": "text", "content": x} for x in lines] + [{"type": "img", "content": "no"}]}]}
    assert best(spark, page(f"<script type='application/json'>{json.dumps(arranged)}</script>")) == LONG
    pushed = {"deep": [{"articleContent": "<p>" + "</p><p>".join(lines) + "</p>"}]}
    assert best(spark, page(f"<script>self.q.push({json.dumps(pushed)});q.push(broken</script>")) == LONG
    linked = {"@graph": [{"articleBody": "short"}, {"articleBody": LONG}]}
    assert best(spark, page(f"<script type='application/ld+json'>{json.dumps(linked)}</script>")) == LONG
    assert best(spark, page("<div class='newsct_article x'>" + "<br>".join(lines) + "</div>")) == LONG
    assert best(spark, page("<div>" + "".join(f"<p>{x}</p>" for x in lines) + "<p>tiny</p></div>")) in (LONG, LONG + "\ntiny")
    links = "".join(f"<li><p><a href='/{i}'>{x}{x}</a></p></li>" for i, x in enumerate(lines))
    assert P.densest_text(P.Tree(page(links + "<div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>"))) == LONG


def test_preferred_beats_longer_and_awkward_pages(spark):
    both = page(f"<article>{OTHER}</article><div class='news_body'>only this</div>")
    assert best(spark, both, "https://www.edaily.co.kr/1") == "only this" and best(spark, both, "https://edaily.com/1") == OTHER
    emptied = page(f"<article>{OTHER}</article><div class='news_body'>로그인</div>")
    assert best(spark, emptied, "https://www.edaily.co.kr/1") == OTHER
    assert best(spark, None) == best(spark, "") == best(spark, "<<<>>&#") == ""
    assert best(spark, page("<script type='application/ld+json'>" + "[" * 100000 + "</script>")) == ""
    assert best(spark, page(f"<article>{LONG}</article>"), "https://[bad/1") == LONG
    assert best(spark, page(f"<article>a  b\n{'y' * 300000}\nx\na b</article>")) == "a b\n" + "y" * 300000


def test_crawl_follows_hops_and_fallbacks(spark):
    html, art = "text/html; charset=utf-8", lambda t: page(f"<article>{t}</article>", "<meta property='og:image' content='/i.png'>")
    rows = [
        ("https://a.com/plain", 200, html, art(LONG)),
        ("https://a.com/hop", 200, html, page("wait", "<meta http-equiv='Refresh' content='0; URL=/plain?utm_source=x'>")),
        ("https://a.com/lost", 200, html, page("wait", "<meta http-equiv='refresh' content='0;url=/nowhere'>")),
        ("https://a.com/short", 200, html, page("<article>Too short.</article>", "<link rel='x amphtml' href='/amp'>")),
        ("https://a.com/amp", 200, html, art(OTHER)),
        ("https://biz.sbs.co.kr/article_hub/77/x", 200, html, page("shell")),
        ("https://www.edaily.co.kr/9", 200, html, art("z" * 100)),
        ("https://a.com/brief", 200, html, art("z" * 100)),
        ("https://a.com/private/1", 200, html, art(LONG)),
        ("https://a.com/toprivate", 200, html, page("", "<meta http-equiv='refresh' content='0;url=/private/1'>")),
        ("https://a.com/gone", 404, html, art(LONG)),
        ("https://a.com/pdf", 200, "application/pdf", "x"),
        ("https://a.com/plain#again", 200, html, art(LONG)),
        (None, 200, html, art(LONG)),
        ("https://a.com/null", None, None, None),
    ]
    pages = spark.createDataFrame(rows, "url string, status int, content_type string, html string")
    rules = spark.createDataFrame([("a.com", "/private", False)], "host string, prefix string, allow boolean")
    replies = spark.createDataFrame([("https://apis.sbs.co.kr/play-api/1.0/sbs_newsmedia/77", json.dumps({"clip": {"info": {"contentdata": " ", "synopsis": "<p>" + LONG.replace("\n", "</p><p>") + "</p>"}}})), (None, "x")], "url string, body string")
    asked = [u for u, *_ in rows] + ["https://a.com/unseen", "https://a.com/plain"]
    requests = spark.createDataFrame([(i, u, "t") for i, u in enumerate(asked)], "n int, url string, title string")
    got = crawl(requests, pages, rules, replies).orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(asked)))
    by = {r.url: r for r in got if r.url}
    for path, body in (("plain", LONG), ("hop", LONG), ("short", OTHER), ("plain#again", LONG)):
        r = by[f"https://a.com/{path}"]
        assert (r.outcome, r.error, r.body, r.title) == ("success", None, body, "A title"), path
    assert by["https://a.com/hop"].final_url == "https://a.com/plain" and by["https://a.com/plain"].image == "https://a.com/i.png"
    assert by["https://a.com/short"].final_url == "https://a.com/amp"
    assert by["https://biz.sbs.co.kr/article_hub/77/x"].body == LONG and by["https://www.edaily.co.kr/9"].body == "z" * 100
    said = {p: by[f"https://a.com/{p}"].error for p in ("lost", "brief", "private/1", "toprivate", "gone", "pdf", "null", "unseen")}
    assert said == {"lost": "no page", "brief": "body too short: 100", "private/1": "forbidden by rules", "toprivate": "forbidden by rules", "gone": "HTTP 404", "pdf": "not HTML: application/pdf", "null": "HTTP 0", "unseen": "no page"}
    assert by["https://a.com/toprivate"].outcome == "skipped" and by["https://a.com/gone"].outcome == "failed" and by["https://a.com/gone"].body is None
    assert crawl(requests, pages.limit(0)).where("outcome <> 'failed'").count() == 0 and crawl(requests.limit(0), pages).count() == 0
