"""Crawled pages and printed glossaries, laid out from documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import cluster, filings, glossary
from ..operators.crawl import LEAST, LEAST_SHORT, crawl
from ..sources import files
from .common import Plans, table

QUERIES = Plans()

#: A document's page by its number, in ten forms: where its text stands and how it is reached.
_FORM = "doc_id % 10"
_REPLIER, _PREFERRED = sorted(V.PUBLISHER_REPLIES)[0], sorted(V.PREFERRED_SELECTORS)[0]
_URL = f"CASE {_FORM} WHEN 6 THEN 'https://{_REPLIER}/article/' WHEN 7 THEN 'https://{_PREFERRED}/article/' WHEN 8 THEN 'https://news.example.com/closed/' ELSE 'https://news.example.com/article/' END || doc_id"
_MADE = "z" * 300


@QUERIES.add(f"""
WITH d AS (SELECT doc_id, {_FORM} AS k, {_URL} AS url, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM d)),
c AS (SELECT doc_id, i, trim(regexp_replace(raw, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS x FROM l),
u AS (SELECT doc_id, x, min(i) AS i FROM c WHERE length(x) >= 2 AND NOT ({" OR ".join(f"regexp_matches(x, '{p}')" for p in V.BOILERPLATE)}) GROUP BY 1, 2),
t AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM u GROUP BY 1),
b AS (SELECT d.doc_id, k, url, coalesce(t, '') AS t FROM d LEFT JOIN t ON d.doc_id = t.doc_id),
f AS (SELECT doc_id, k, url, CASE WHEN k = 5 AND length(t) <= 10 THEN 'Too short.' WHEN k = 7 AND t = '' THEN '{_MADE}' ELSE t END AS body, CASE WHEN k = 7 THEN {LEAST_SHORT} ELSE {LEAST} END AS least FROM b),
e AS (SELECT *, CASE WHEN doc_id % 20 = 19 THEN 'no page' WHEN k = 9 THEN 'HTTP 404' WHEN k = 8 THEN 'forbidden by rules' WHEN length(body) < least THEN 'body too short: ' || length(body) END AS error FROM f)
SELECT doc_id, CASE WHEN k = 8 THEN 'skipped' WHEN error IS NULL THEN 'success' ELSE 'failed' END AS outcome, error,
       CASE WHEN doc_id % 20 = 19 THEN NULL WHEN k = 4 THEN 'https://news.example.com/moved/' || doc_id WHEN k = 5 AND body <> 'Too short.' THEN 'https://news.example.com/amp/' || doc_id ELSE url END AS final_url,
       CASE WHEN error IS NULL THEN sha256(body) END AS body_hash FROM e""")
def page_crawl(spark, d):
    """Requests over landed pages of every form: six extractors, preferred elements, refresh hops, AMP pages, publishers' replies, rules and faults (SRC-3..5, SCAL-34..37)."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(_FORM).alias("k"), F.expr(_URL).alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    k, said = F.col("k"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    state = lambda c: F.replace(F.to_json(c), F.lit("<"), F.lit("\\u003c"))
    within = lambda head, x, tail: F.concat(F.lit(head), x, F.lit(tail))
    elements = state(F.struct(F.array(F.struct(F.lit("list").alias("type"), F.array(F.struct(F.lit("quote").alias("type"), said.alias("content"))).alias("items"))).alias("content_elements")))
    article = within("<article>", said, "</article>")
    html = (
        F.when(k == 1, within("<script type='application/ld+json'>", state(F.array(F.struct(F.col("text").alias("articleBody")))), "</script>"))
        .when(k == 2, within(f"<script id='fusion-metadata'>{V.ELEMENTS_MARK}", elements, ";</script>"))
        .when(k == 3, within("<script>q.push(", state(F.struct(F.struct(within("<p>", said, "</p>").alias("articleContent")).alias("data"))), ");</script>"))
        .when(k == 4, within("<meta http-equiv='refresh' content='0;url=/moved/", F.col("doc_id").cast("string"), "'>"))
        .when(k == 5, within("<link rel='amphtml' href='/amp/", F.col("doc_id").cast("string"), "'><article>Too short.</article>"))
        .when(k == 6, F.lit("<div id='app'></div>"))
        .when(k == 7, within(f"<article>{_MADE}</article><div class='news_body'>", said, "</div>"))
        .otherwise(article)
    )
    other = F.when(k == 4, "https://news.example.com/moved/").when(k == 5, "https://news.example.com/amp/")
    page = lambda url, status, body: F.struct(url.alias("url"), status.alias("status"), F.lit("text/html").alias("content_type"), body.alias("html"))
    both = F.array(page(F.col("url"), F.when(k == 9, 404).otherwise(200), html), page(F.concat(other, F.col("doc_id").cast("string")), F.lit(200), article))
    pages = docs.where("doc_id % 20 <> 19").select(F.inline(both))
    rules = docs.where("k = 8").select(F.regexp_extract("url", "^https://([^/]+)", 1).alias("host"), F.lit("/closed/").alias("prefix"), F.lit(False).alias("allow")).distinct()
    replies = docs.where("k = 6").select(F.concat(F.lit(V.PUBLISHER_REPLIES[_REPLIER]), F.col("doc_id").cast("string")).alias("url"), F.to_json(F.struct(F.struct(F.struct(said.alias("contentdata")).alias("info")).alias("clip"))).alias("body"))
    got = crawl(docs.select("doc_id", "url"), pages, rules, replies)
    return got.select("doc_id", "outcome", "error", "final_url", F.sha2("body", 256).alias("body_hash"))


@QUERIES.add("""
WITH p AS (SELECT *, upper(p_name[1]) || p_name[2:] AS name, p_partkey % 5 AS doc_id, p_partkey // 10 + 1 AS page, p_partkey % 3 = 0 AS two, p_partkey % 4 = 1 AS short FROM part),
n AS (SELECT *, CASE WHEN two THEN name || '/' || p_brand ELSE name END AS term FROM p),
c AS (SELECT doc_id, replace(term, ' ', '') AS key, p_partkey % 9000 AS printed FROM n WHERE p_partkey % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY page, term, printed) = 1)
SELECT n.doc_id, page, term, CASE WHEN NOT short THEN p_type || ' Name' END AS english_name, 'The ' || p_name || ' is a ' || p_type || ' of size ' || p_size AS definition,
       array_to_string(CASE WHEN short THEN [upper(p_type)] ELSE ['T' || p_size] END || CASE WHEN two THEN [name, p_brand] ELSE [] END, '|') AS aliases,
       CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_type ELSE '' END AS related_terms, coalesce(whole.printed, head.printed, tail.printed, page - 1) AS source_page
FROM n LEFT JOIN c AS whole ON whole.doc_id = n.doc_id AND whole.key = replace(term, ' ', '') LEFT JOIN c AS head ON two AND head.doc_id = n.doc_id AND head.key = replace(name, ' ', '')
LEFT JOIN c AS tail ON two AND tail.doc_id = n.doc_id AND tail.key = p_brand WHERE p_partkey % 7 <> 0""")
def glossary_terms(spark, d):
    """Terms of glossaries laid out from parts: titles in two fonts, definitions over two columns, related terms, printed pages of the contents (SRC-25, 26)."""
    key = F.col("p_partkey")
    p = table(spark, d, "part").withColumns({"doc_id": key % 5, "page": (F.floor(key / 10) + 1).cast("int"), "y": F.when(key % 10 < 5, 100.0).otherwise(400.0)})
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    name = F.when(key % 3 == 0, F.concat(name, F.lit("/"), "p_brand")).otherwise(name)
    size = F.col("p_size").cast("string")
    latin = F.when(key % 4 == 1, F.concat(F.lit("("), F.upper("p_type"), F.lit(")"))).otherwise(F.concat(F.lit("(T"), size, F.lit("; "), F.col("p_type"), F.lit(" Name)")))
    span = lambda text, font, size, x, dy: F.struct(text.alias("text"), F.lit(font).alias("font"), F.lit(size).alias("size"), F.lit(x).alias("x0"), (F.col("y") + dy).alias("y0"))
    defined, related = key % 7 != 0, key % 2 == 0
    rows = F.array(
        span(latin, "DIN-Bold", 13.0, 260.0, 1.0), span(name, "SUIT-ExtraBold", 14.0, 50.0, 0.0), span(F.lit("Glossary"), "NanumSquare", 9.0, 50.0, 2.0), span(F.when(defined, F.concat(F.lit("The "), F.col("p_name"))), "Batang", 10.5, 50.0, 20.0),
        span(F.when(defined, F.concat(F.lit(" is a  "), F.col("p_type"), F.lit(" of size "), size)), "Batang", 10.5, 50.0, 35.0), span(F.when(related, V.RELATED_LABEL), "KoPubDotum", 9.0, 50.0, 60.0), span(F.when(related, F.concat_ws(", ", "p_brand", "p_type")), "KoPubDotum", 9.5, 110.0, 60.0),
        span(F.when(related, F.lit("remark")), "Batang", 10.5, 50.0, 80.0),
    )
    spans = p.select("doc_id", "page", F.lit(500.0).alias("width"), F.posexplode(rows).alias("nth", "s")).select("doc_id", "page", F.col("nth").alias("ord"), "width", "s.*").where("text IS NOT NULL")
    lines = p.where(key % 11 != 0).select("doc_id", "page", F.concat(name, F.lit(" ..... "), (key % 9000).cast("string")).alias("text"))
    got = glossary.glossary_terms(spans, glossary.contents(lines), 1)
    return got.select("doc_id", "page", "term", "english_name", "definition", F.array_join("aliases", "|").alias("aliases"), F.array_join("related_terms", "|").alias("related_terms"), "source_page")


#: A filing by its number: a title, and a text that holds its day (d), hour and place as such filings say them.
_EVENT_TITLE = "CASE o_orderkey % 8 WHEN 0 THEN '주주총회 소집 결의' WHEN 1 THEN '현금ㆍ현물배당 결정' WHEN 2 THEN '기업설명회(IR) 개최' WHEN 3 THEN '영업(잠정) 실적' WHEN 4 THEN '[기재정정]주주명부폐쇄 기준일' WHEN 5 THEN '기업설명회(IR) 철회' WHEN 6 THEN '기타' ELSE '주주명부폐쇄' END"


@QUERIES.add(f"""
WITH e AS (SELECT *, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 8 <> 6),
v AS (SELECT o_orderkey, {_EVENT_TITLE} AS title, CASE k WHEN 0 THEN 'shareholders_meeting' WHEN 1 THEN 'dividend' WHEN 3 THEN 'earnings' WHEN 4 THEN 'record_date' WHEN 7 THEN 'book_closure' ELSE 'ir' END AS event_type,
  day AS event_date, CASE WHEN k = 4 THEN day + 5 END AS event_end_date, CASE WHEN k IN (0, 2, 5) THEN lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || CASE WHEN k = 0 THEN ':00:00' ELSE ':30:00' END END AS start_time,
  CASE WHEN k = 0 THEN 'hall ' || o_custkey END AS location, CASE WHEN k = 1 THEN CAST(trunc(o_totalprice) AS BIGINT) END AS amount FROM e)
SELECT o_orderkey, event_type, strftime(event_date, '%Y-%m-%d') AS event_date, strftime(event_end_date, '%Y-%m-%d') AS event_end_date, start_time, location, amount, CASE WHEN contains(title, '철회') THEN 'cancelled' WHEN starts_with(title, '[') THEN 'changed' ELSE 'scheduled' END AS status,
       CAST((event_end_date IS NOT NULL)::INT + (start_time IS NOT NULL)::INT + (location IS NOT NULL)::INT + (amount IS NOT NULL)::INT + 1 AS BIGINT) AS n_found FROM v""")
def filing_events(spark, d):
    """Company events of filings by their titles, with days, hours, places and dividends by labels (SCAL-29)."""
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_EVENT_TITLE).alias("title"), (F.col("o_orderkey") % 8).alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").cast("string").alias("corp"), (F.col("o_custkey") % 24).cast("string").alias("hour"), F.format_number(F.col("o_totalprice").cast("long"), 0).alias("paid"))
    k, words, points = F.col("k"), F.date_format("day", "yyyy'년 'M'월 'd'일'"), F.date_format("day", "yyyy. M. d")
    raw = (
        F.when(k == 0, F.concat(F.lit("주주총회 예정일 : "), words, F.lit("\n개최시간 : "), "hour", F.lit(" 시\n개최장소 :  hall   "), "corp", F.lit(" - \n끝")))
        .when(k == 1, F.concat(F.lit("배당기준일 2023-13-40\n지급예정일 "), points, F.lit("\n1주당 배당금 보통주식 "), "paid", F.lit(" 원")))
        .when(k.isin(2, 5), F.concat(F.lit("개최일시 "), points, F.lit(" "), "hour", F.lit(":30")))
        .when(k == 3, F.concat(F.lit("발표예정일 "), words))
        .when(k == 4, F.concat(F.lit("기준일 "), points, F.lit("\n종료일 "), F.date_format(F.date_add("day", 5), "yyyy/MM/dd")))
        .otherwise(F.concat(F.lit("시작일 "), points))
    )
    got = filings.event_rows(o.select("o_orderkey", "title", raw.alias("raw_text")))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return got.select("o_orderkey", "event_type", text("event_date"), text("event_end_date"), "start_time", "location", "amount", "status", F.size("normalized").cast("long").alias("n_found"))


@QUERIES.add("""
WITH e AS (SELECT vec_id, label, vec_id * 0.05::DOUBLE AS t, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT * FROM e WHERE vec_id % 5 = 0),
p AS (SELECT a.vec_id AS article_id, c.vec_id AS cluster_id, round(list_dot_product(a.v, c.v), 6) AS sim, ((a.vec_id * 7 + c.vec_id * 3) % 11) / 10.0::DOUBLE AS sig, (a.vec_id + c.vec_id) % 4 AS hits FROM e a JOIN c ON a.label = c.label AND a.t >= c.t AND a.t - c.t <= 6 AND a.vec_id <> c.vec_id),
s AS (SELECT *, sim >= 0.1 AS v, sig >= 0.55 AND hits >= 2 AS s, round(greatest(sim, sig * 0.92), 6) AS score FROM p),
r AS (SELECT *, CASE WHEN v THEN row_number() OVER (PARTITION BY article_id, v ORDER BY sim DESC, cluster_id) END AS nv, CASE WHEN s THEN row_number() OVER (PARTITION BY article_id, s ORDER BY sig DESC, cluster_id) END AS ns FROM s WHERE v OR s),
k AS (SELECT * FROM r WHERE nv <= 2 OR ns = 1), free AS (SELECT * FROM (SELECT r.* FROM r ANTI JOIN k USING (article_id, cluster_id)) f LEFT JOIN (SELECT article_id AS a2, count(*) AS taken FROM k GROUP BY 1) ON a2 = article_id QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, cluster_id) <= 3 - taken),
o AS (SELECT article_id, cluster_id, score FROM k UNION ALL SELECT article_id, cluster_id, score FROM free)
SELECT article_id, cluster_id, score, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, cluster_id) AS rank FROM o""")
def candidate_slots(spark, d):
    """Candidates of an article: two places by vector, one by signature, free ones by score (WIN-14)."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("stock_code"), F.col("vec_id").alias("article_id"), (F.col("vec_id") * 0.05).alias("t_hours"), F.col("embedding").alias("vec"))
    c = e.where("article_id % 5 = 0").select("stock_code", F.col("article_id").alias("cluster_id"), F.col("t_hours").alias("last_hours"), F.col("vec").alias("centroid"))
    a, b = F.col("article_id"), F.col("cluster_id")
    pairs = cluster.near_pairs(e, c, 6.0).where(a != b).select(a, b, F.round("similarity", 6).alias("similarity"), (((a * 7 + b * 3) % 11) / 10.0).alias("signature"), ((a + b) % 4).alias("hits"))
    return cluster.candidate_slots(pairs, 3, 0.1).select("article_id", "cluster_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@QUERIES.add("""
SELECT CAST(c_custkey AS VARCHAR) AS stock_code, CASE WHEN s_suppkey IS NULL THEN CASE WHEN c_custkey % 2 = 0 THEN c_name END ELSE s_name END AS corp_code, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN c_custkey % 3 = 0 THEN 'same' ELSE 'changed' END AS outcome
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def source_code_sync(spark, d):
    """Which stocks' codes a register changes, confirms or lacks (SRC-10)."""
    register = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("stock_code"), F.col("s_name").alias("corp_code"), F.col("s_suppkey").alias("c_custkey"))
    known = table(spark, d, "customer").join(register.select("c_custkey", F.col("corp_code").alias("met")), "c_custkey", "left")
    stocks = known.select(F.col("c_custkey").cast("string").alias("stock_code"), F.when((F.col("c_custkey") % 3 == 0) & F.col("met").isNotNull(), F.col("met")).when((F.col("c_custkey") % 2 == 0) & F.col("met").isNull(), F.col("c_name")).alias("corp_code"))
    return files.sync_codes(stocks, register)
