"""Sources, sinks and model calls as whole flows: written to the shared folder, read again, merged or resumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import models, text
from ..operators import merge, news, search
from ..shared import fresh_path
from ..sources import files, filings_api
from .common import Plans, table

QUERIES = Plans()


# Sources ------------------------------------------------------------------------------------------


@QUERIES.add("""
SELECT conv_id, turn, role, text, conv_id % 2 = 0 AS "even" FROM conversations""")
def source_csv(spark, d):
    """Delimited text with quotes, line feeds and a header, read by its schema (SRC-27, 28, 34)."""
    at = fresh_path(spark, "source-csv")
    table(spark, d, "conversations").select("conv_id", "turn", "role", "text").write.option("header", True).option("escape", '"').option("emptyValue", "").csv(at)
    return files.read_csv(spark, at, "conv_id bigint, turn bigint, role string, text string").withColumn("even", F.col("conv_id") % 2 == 0)


@QUERIES.add("""
SELECT CASE WHEN event_id % 50 > 0 THEN event_id END AS event_id, CASE WHEN event_id % 50 > 0 THEN event_type END AS event_type, CASE WHEN event_id % 50 > 0 THEN value END AS value, CASE WHEN event_id % 50 = 0 THEN '{broken ' || event_id END AS corrupt FROM events""")
def source_jsonl(spark, d):
    """Objects a line; lines that don't parse are kept as they stand (SRC-35)."""
    at = fresh_path(spark, "source-jsonl")
    line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    table(spark, d, "events").select(line.alias("value")).write.text(at)
    return files.read_jsonl(spark, at, "event_id bigint, event_type string, value double").select("event_id", "event_type", "value", F.col("_corrupt").alias("corrupt"))


@QUERIES.add("""
SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS stock_code, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS corp_code, c_name AS corp_name FROM customer WHERE c_custkey % 3 > 0""")
def source_corp_codes(spark, d):
    """Listed companies of an XML register: those with a six-digit code (SRC-8, 10)."""
    at = fresh_path(spark, "source-xml")
    code = F.when(F.col("c_custkey") % 3 > 0, F.lpad(F.col("c_custkey").cast("string"), 6, "0")).otherwise(" ")
    rows = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("corp_code"), F.col("c_name").alias("corp_name"), code.alias("stock_code"))
    rows.write.format("xml").option("rootTag", "result").option("rowTag", "list").save(at)
    return files.corp_codes(spark, at)


_REPLY = """CASE o_custkey % 6 WHEN 0 THEN '013' WHEN 1 THEN '020' WHEN 2 THEN '011' WHEN 3 THEN '800' ELSE '000' END"""


@QUERIES.add(f"""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, {_REPLY} AS status FROM orders)
SELECT CASE status WHEN '013' THEN 'no_data' WHEN '020' THEN 'rate_limited' WHEN '011' THEN 'auth_error' WHEN '000' THEN 'ok' ELSE 'error' END AS kind, CASE WHEN status = '000' THEN CAST(o_orderkey AS VARCHAR) END AS rcept_no,
  CASE WHEN status = '000' THEN CASE WHEN o_orderstatus = 'P' THEN '[기재정정]보고서' ELSE '보고서' END END AS title, CASE WHEN status = '000' THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS disclosed_at,
  status = '000' AND (o_orderstatus = 'P' OR o_orderkey % 2 = 0) AS is_correction FROM r""")
def source_api_replies(spark, d):
    """Replies of a filing API: what they mean, and the filings they list (SRC-6, 9, 16)."""
    row = F.struct(F.col("o_orderkey").cast("string").alias("rcept_no"), F.expr("CASE WHEN o_orderstatus = 'P' THEN ' [기재정정]보고서' ELSE '보고서 ' END").alias("report_nm"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN '정' ELSE '유' END").alias("rm"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"))
    status = F.expr(_REPLY)
    body = F.to_json(F.struct(status.alias("status"), F.when(status == "000", F.array(row)).alias("list")))
    r = table(spark, d, "orders").select(files.api_status(body, "struct<rcept_no:string,report_nm:string,rm:string,rcept_dt:string>").alias("r")).select("r.kind", F.explode_outer("r.rows").alias("row"))
    listed = files.filing_list(r.where("row IS NOT NULL").select("row.*"))
    ok = listed.select(F.lit("ok").alias("kind"), "rcept_no", "title", F.col("disclosed_at").cast("timestamp_ntz").alias("disclosed_at"), "is_correction")
    return ok.unionByName(r.where("row IS NULL").select("kind", F.lit(False).alias("is_correction")), allowMissingColumns=True)


#: Companies that are asked, and what a request (company * 36 + kind) answers first.
_COMPANIES = 4
_FIRST = "CASE WHEN x % 7 = 0 THEN '013' WHEN x % 7 = 1 THEN '020' WHEN x % 11 = 2 THEN '800' ELSE '000' END"


@QUERIES.add(f"""
WITH k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{e}')" for i, (e, a, _) in enumerate(V.MAJOR_EVENTS))}) AS k(nth, source_api, event_type)),
o AS (SELECT o_custkey % {_COMPANIES} AS corp, o_orderkey % 36 AS nth, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT c.corp, k.source_api, k.event_type, c.corp * 36 + k.nth AS x, coalesce(o.n, 0) AS n FROM (SELECT unnest(range({_COMPANIES})) AS corp) c CROSS JOIN k LEFT JOIN o ON o.corp = c.corp AND o.nth = k.nth),
s AS (SELECT *, {_FIRST} AS first FROM r WHERE x % 5 <> 0)
SELECT CAST(corp AS VARCHAR) AS corp_code, source_api, event_type, CASE WHEN first = '800' THEN 'failed' WHEN first = '013' OR n = 0 THEN 'no_data' ELSE 'success' END AS result_status,
       CASE WHEN first IN ('000', '020') THEN n ELSE 0 END AS row_count, CASE WHEN first = '020' THEN 2 ELSE 1 END AS attempts, CASE WHEN first IN ('000', '020') THEN n ELSE 0 END AS listed FROM s""")
def source_major_events(spark, d):
    """All kinds of major events of some companies through the filing API's source, from the requests that are not done: what each answered, after how many attempts, and the rows that it listed (SRC-6, 14, 15)."""
    kinds = filings_api.registry(spark)
    wanted = spark.range(_COMPANIES).withColumnRenamed("id", "corp").join(F.broadcast(kinds), F.lit(True)).withColumn("x", F.col("corp") * 36 + F.col("nth"))  # 36 kinds
    rows = table(spark, d, "orders").groupBy((F.col("o_custkey") % _COMPANIES).alias("corp"), (F.col("o_orderkey") % 36).alias("nth")).agg(F.sort_array(F.collect_list(F.col("o_orderkey").cast("string"))).alias("filings"))
    asked = wanted.join(rows, ["corp", "nth"], "left").withColumn("first", F.expr(_FIRST))
    listed = F.transform(F.coalesce("filings", F.array().cast("array<string>")), lambda f: F.struct(f.alias("rcept_no")))
    body = lambda status: F.to_json(F.struct(status.alias("status"), F.when(status.isin("000"), listed).alias("list")))
    replies = asked.select("source_api", F.col("corp").cast("string").alias("corp_code"), F.posexplode(F.when(F.col("first") == "020", F.array(body(F.col("first")), body(F.lit("000")))).otherwise(F.array(body(F.col("first"))))).alias("nth", "body"))
    folder = fresh_path(spark, "replies")
    filings_api.write_replies(replies, folder)
    request = asked.select(F.col("corp").cast("string").alias("corp_code"), "source_api", F.lit("20250101:20251231").alias("request_key"), "x")
    done = request.where("x % 5 = 0").withColumn("result_status", F.when(F.col("x") % 2 == 0, "success").otherwise("no_data")).unionByName(request.where("x % 5 = 1").withColumn("result_status", F.lit("failed")))
    got = filings_api.collect(request, done, folder, wait=0.0)
    by = got.groupBy("corp_code", "source_api").agg(F.max("result_status").alias("result_status"), F.max("row_count").alias("row_count"), F.max("attempts").cast("long").alias("attempts"), F.count("row").alias("listed"))
    return by.join(F.broadcast(kinds.select("source_api", "event_type")), "source_api").select("corp_code", "source_api", "event_type", "result_status", "row_count", "attempts", "listed")


@QUERIES.add("""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, NOT (starts_with(path, '/en') AND length(host) % 2 = 0) OR (starts_with(path, '/en/1') AND length(host) % 2 = 0) AS allowed FROM p""")
def source_robots(spark, d):
    """Pages that the longest rule of their host allows, or no rule forbids (SRC-4)."""
    p = table(spark, d, "pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    rule = lambda prefix, allow: F.struct(F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow"))
    rules = p.where(F.char_length("host") % 2 == 0).select("host").distinct().select("host", F.inline(F.array(rule("/en", False), rule("/en/1", True))))
    return files.robots_allowed(p, rules).select("page_id", "allowed")


@QUERIES.add("""
WITH i AS (SELECT page_id, 'http://news.example.com/' || page_id // 2 AS url, page_id % 11 > 0 AS dated FROM pages),
f AS (SELECT url, min(page_id) AS page_id FROM i WHERE dated AND page_id % 13 > 0 GROUP BY url)
SELECT url, 'Title ' || page_id || ' & more' AS title, TIMESTAMP '2024-01-02 03:04:05' + page_id * INTERVAL 1 HOUR AS published_at FROM f""")
def source_search_pages(spark, d):
    """Items of search pages: decoded, bad ones dropped, one per address, the first (SRC-1, 2)."""
    at = F.expr("TIMESTAMP '2024-01-02 03:04:05'") + F.make_dt_interval(hours=F.col("page_id"))
    url = F.concat(F.lit("http://news.example.com/"), F.expr("page_id div 2").cast("string"))
    item = F.struct(
        F.concat(F.lit("<b>Title</b> "), F.col("page_id").cast("string"), F.lit(" &amp; more")).alias("title"), F.when(F.col("page_id") % 2 == 0, url).otherwise("").alias("originallink"), F.when(F.col("page_id") % 13 == 0, "no address").otherwise(url).alias("link"),
        F.lit("d").alias("description"), F.when(F.col("page_id") % 11 > 0, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).otherwise("yesterday").alias("pubDate"),
    )
    item = item.withField("originallink", F.when(F.col("page_id") % 13 == 0, "").otherwise(item["originallink"]))
    items = table(spark, d, "pages").select(F.expr("page_id div 20").alias("page"), "page_id", item.alias("i"))
    pages = items.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("page_id", "i"))).alias("x")).select("page", F.to_json(F.struct(F.transform("x", lambda x: x["i"]).alias("items"))).alias("body"))
    return files.search_rows(pages).select("url", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@QUERIES.add("""
WITH n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS page, x AS text FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))
SELECT doc_id AS path, page, sha256(text) AS page_hash FROM n""")
def source_layout_pages(spark, d):
    """Pages of layout text, which form feeds divide (SRC-37)."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.translate("text", "\n\f", "\f").alias("text"))
    return files.page_text_layout(t).select("path", "page", F.sha2("text", 256).alias("page_hash"))


# Sinks --------------------------------------------------------------------------------------------


@QUERIES.add("""
WITH i AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_custkey, o_orderpriority FROM i WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey % 2 > 0 AND s.o_custkey = i.o_custkey AND s.o_orderpriority = i.o_orderpriority)""")
def sink_new_rows(spark, d):
    """Rows whose keys are not there yet, once each (JOIN-17, SNK-31, 32)."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", (F.col("o_orderkey") % 2).alias("odd"))
    return merge.insert_new(o.where("odd > 0").drop("odd"), o.where("odd = 0").drop("odd"), ["o_custkey", "o_orderpriority"])


@QUERIES.add("""
SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1""")
def sink_published(spark, d):
    """A table published twice: readers see the later version alone (SNK-25, 26, 30)."""
    at, o = fresh_path(spark, "published"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    merge.publish(o.where("o_orderkey % 2 > 0"), at)
    merge.publish(o.where("o_orderkey % 2 = 0"), at, ["o_orderstatus"])
    return merge.current(spark, at).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@QUERIES.add("""
SELECT CASE WHEN event_type = 'error' THEN 'first' ELSE 'second' END AS run, user_id, count(*) AS n, max(value) AS highest FROM events WHERE event_type IN ('error', 'click') GROUP BY 1, 2""")
def sink_failures(spark, d):
    """Failures of two runs, appended as JSON lines (SNK-27, 37, ST-16)."""
    at, e = fresh_path(spark, "failures"), table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for run, kind in (("first", "error"), ("second", "click")):
        news.log_failures(e.where(F.col("event_type") == kind).withColumn("run", F.lit(run)), at)
    return spark.read.schema("run string, user_id bigint, value double").json(at).groupBy("run", "user_id").agg(F.count("*").alias("n"), F.max("value").alias("highest"))


@QUERIES.add("""
SELECT CASE c_custkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split, CAST(c_nationkey AS INTEGER) AS unit, count(*) AS rows, count(*) AS listed FROM customer GROUP BY 1, 2""")
def sink_splits(spark, d):
    """Rows in a folder per split, and the manifest beside them (SNK-28, 29)."""
    at = fresh_path(spark, "splits")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("unit"), F.expr("CASE c_custkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END").alias("split"))
    news.write_splits(c, at)
    rows = files.read_csv(spark, f"{at}/rows", "c_custkey bigint, unit int, split string").groupBy("split", "unit").agg(F.count("*").alias("rows"))
    listed = files.read_csv(spark, f"{at}/manifest", "split string, unit int, listed bigint")
    return rows.join(listed, ["split", "unit"], "full")


@QUERIES.add("""
WITH r AS (SELECT o_custkey AS run_id, l_suppkey AS stock, l_returnflag AS data_group, l_linestatus AS source_api, l_linenumber AS request_key, CASE WHEN l_orderkey % 4 = 0 THEN 'no_data' ELSE 'ok' END AS result, l_orderkey AS arrived FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT run_id, stock, data_group, source_api, request_key, max(arrived) AS arrived, arg_max(result, arrived) AS result FROM r GROUP BY 1, 2, 3, 4, 5""")
def sink_audit(spark, d):
    """The latest result of each call, by five keys (SNK-38)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
    r = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("run_id"), F.col("l_suppkey").alias("stock"), F.col("l_returnflag").alias("data_group"), F.col("l_linestatus").alias("source_api"), F.col("l_linenumber").alias("request_key"), F.when(F.col("l_orderkey") % 4 == 0, "no_data").otherwise("ok").alias("result"), F.col("l_orderkey").alias("arrived"))
    return merge.upsert(r.where("arrived % 2 = 0"), r.where("arrived % 2 > 0"), ["run_id", "stock", "data_group", "source_api", "request_key"], "arrived")


@QUERIES.add("""
WITH e AS (SELECT event_id AS article_id, user_id AS stock, event_id % 3 AS step FROM events)
SELECT article_id, stock, CASE step WHEN 0 THEN 'assigned' ELSE 'pending_retry' END AS status, CASE step WHEN 0 THEN article_id % 7 END AS cluster_id, CASE WHEN step > 0 THEN TIMESTAMP '2024-01-01 00:10:00' + step * INTERVAL 10 MINUTE END AS next_retry_at FROM e""")
def sink_assignments(spark, d):
    """Pairs queued as pending before the work, then overwritten by what came of them (SNK-19, 20, 39)."""
    e = table(spark, d, "events").select(F.col("event_id").alias("article_id"), F.col("user_id").alias("stock"), (F.col("event_id") % 3).alias("step"))
    at = F.expr("TIMESTAMP '2024-01-01 00:10:00'")
    retry = lambda steps: (at + F.make_dt_interval(mins=steps * 10)).cast("timestamp_ntz").alias("next_retry_at")
    none = lambda kind: F.lit(None).cast(kind)
    queued = e.select("article_id", "stock", F.lit("pending_retry").alias("status"), none("bigint").alias("cluster_id"), retry(F.lit(1)), F.lit(0).alias("saved"))
    came = e.where("step <> 1").select("article_id", "stock", F.when(F.col("step") == 0, "assigned").otherwise("pending_retry").alias("status"), F.when(F.col("step") == 0, F.col("article_id") % 7).alias("cluster_id"), F.when(F.col("step") > 0, retry(F.col("step").cast("int"))).alias("next_retry_at"), F.lit(1).alias("saved"))
    return merge.upsert(queued, came, ["article_id", "stock"], "saved").drop("saved")


# Models -------------------------------------------------------------------------------------------


def _judge():
    """A stand-in for a judge's service: an article is an event if its text has a fifth word; a text with a bracket fails."""

    def roles(texts: list) -> list:
        if any("[" in t for t in texts):
            raise ValueError("not to be judged")
        return ["company_event" if len(t.split()) > 4 else "other" for t in texts]

    return roles


@QUERIES.add(f"""
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'opinion' WHEN contains(text, '[') OR doc_id % 6 = 1 THEN NULL WHEN len(list_filter(string_split_regex(text, '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+'), lambda x: x <> '')) > 4 THEN 'company_event' ELSE 'other' END AS role FROM documents WHERE text IS NOT NULL""")
def role_gate(spark, d):
    """A rule decides on opinions; the rest goes to a judge, whose failures stay by themselves (UDF-4, 6, 7, ST-26)."""
    head = F.expr("CASE doc_id % 6 WHEN 0 THEN '사설: ' WHEN 1 THEN '[' ELSE '' END")
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(head, "text").alias("t"), text.is_opinion(head).alias("opinion"))
    judged = models.apply_model(t.where("NOT opinion").select("doc_id", "t"), "t", _judge, "role", "string")
    return t.where("opinion").select("doc_id", F.lit("opinion").alias("role")).unionByName(judged.select("doc_id", "role"))


@QUERIES.add("""
WITH k AS (SELECT doc_id, source, lang FROM documents), c AS (SELECT DISTINCT source, lang FROM documents WHERE lang = 'en')
SELECT k.doc_id, CASE WHEN c.lang IS NULL THEN 'computed ' ELSE 'stored ' END || coalesce(k.source, '') AS result FROM k LEFT JOIN c ON k.source = c.source AND k.lang = c.lang WHERE k.source IS NOT NULL AND k.lang IS NOT NULL""")
def model_cache(spark, d):
    """Results from a cache by their keys, and computed ones for what it lacks (UDF-16, 19)."""
    k = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", "source", "lang")
    stored = k.where("lang = 'en'").select("source", "lang").distinct().withColumn("result", F.concat(F.lit("stored "), "source"))
    return models.cached(k, stored, ["source", "lang"], lambda lacks: lacks.withColumn("result", F.concat(F.lit("computed "), "source"))).select("doc_id", "result")


@QUERIES.add("""
WITH h AS (SELECT user_id AS query_id, event_id AS chunk_id, event_type AS source_pk, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_pk <> 'error', rank, chunk_id) AS place FROM h)
SELECT query_id, chunk_id, source_pk, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place FROM p WHERE place <= 6""")
def document_at_hand_first(spark, d):
    """Hits of the document at hand before the others, each part by rank (WIN-11, 22)."""
    h = table(spark, d, "events")
    h = h.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("event_type").alias("source_pk"), F.expr("CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS int)").alias("rank"))
    return search.current_first(h, F.lit("error"), 6).select("query_id", "chunk_id", "source_pk", "rank", "place")
