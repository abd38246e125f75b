"""Text, URL and page functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrow, text
from ..functions import fixed_values as V
from ..functions import pages as page
from ..operators import merge, state
from ..ship import ship
from .common import Plans, table

QUERIES = Plans()


@QUERIES.add("""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS h,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS raw, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
n AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN raw = '' THEN '/' ELSE raw END, '/{2,}', '/', 'g'), '(.)/+$', '\\1') AS path,
  array_to_string(list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','n_media','n_query','n_rank','n_ad_group','n_ad')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&') AS args FROM p)
SELECT page_id, h AS host, scheme || '://' || h || path || CASE WHEN args = '' THEN '' ELSE '?' || args END AS canonical_url FROM n""")
def text_urls(spark, d):
    """Hosts and canonical addresses, natively (SCAL-1, 5)."""
    return table(spark, d, "pages").select("page_id", text.host("url").alias("host"), text.canonical_url("url").alias("canonical_url"))


@QUERIES.add(None)
def text_url_dedup(spark, d):
    """The first page of each canonical address, percent-encoding included (SRC-1, SNK-1)."""
    ship(spark)
    p = table(spark, d, "pages").select("page_id", "url", arrow.canonicalize_url("url").alias("canonical_url"))
    return merge.keep_first(p, ["canonical_url"], [F.col("page_id")]).select("page_id", "canonical_url")


@QUERIES.add("""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages),
a AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM p)
SELECT page_id, host, min(domain) AS domain FROM p JOIN a ON host = domain OR ends_with(host, '.' || domain) GROUP BY 1, 2""")
def text_allowed_domains(spark, d):
    """Pages whose host is or lies under a listed domain: a join on the host's own suffixes (FIL-12, SCAL-6)."""
    p = table(spark, d, "pages").select("page_id", text.host("url").alias("host"))
    parts = F.split("host", r"\.")
    listed = p.select(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain")).distinct()
    return p.withColumn("domain", F.explode(text.host_suffixes(F.col("host")))).join(listed, "domain").groupBy("page_id", "host").agg(F.min("domain").alias("domain"))


@QUERIES.add("""
SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title,
       len(regexp_extract_all(html, '(?i)<p[ >]')) AS paragraphs, length(html) AS size FROM pages""")
def text_page_titles(spark, d):
    """Titles and counts of blocks by pattern (SCAL-30)."""
    title = F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))
    return table(spark, d, "pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit("(?i)<p[ >]")).cast("long").alias("paragraphs"), F.char_length("html").cast("long").alias("size"))


@QUERIES.add(None)
def text_page_bodies(spark, d):
    """Title, links and the body that the extractors find, from one tree a page (SCAL-31..37)."""
    p = table(spark, d, "pages").select("page_id", page.found("url", "html").alias("f"))
    body = F.nullif(page.best_body(F.col("f")), F.lit(""))
    return p.select("page_id", "f.title", "f.image", "f.amp", body.alias("body"), (F.char_length(body) >= 250).alias("enough"))


@QUERIES.add("""
SELECT doc_id, sha256(text) AS content_hash, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS search_hash, length(text) AS n FROM documents""")
def text_hashes(spark, d):
    """Content and search hashes (SCAL-11, 15, 17)."""
    norm = F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")))
    return table(spark, d, "documents").select("doc_id", text.content_hash("text").alias("content_hash"), F.sha2(norm, 256).alias("search_hash"), F.char_length("text").cast("long").alias("n"))


@QUERIES.add("""
WITH c AS (SELECT doc_id, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i, text FROM documents)
SELECT doc_id, i AS chunk_order, sha256(substr(text, i * 1000 + 1, 1000)) AS content_hash, length(substr(text, i * 1000 + 1, 1000)) AS n FROM c""")
def text_fixed_chunks(spark, d):
    """Pieces of a fixed width (SCAL-14, SNK-40)."""
    c = table(spark, d, "documents").select("doc_id", F.posexplode(text.fixed_chunks("text")).alias("i", "c"))
    return c.select("doc_id", F.col("i").cast("long").alias("chunk_order"), F.sha2("c", 256).alias("content_hash"), F.char_length("c").cast("long").alias("n"))


@QUERIES.add(None)
def text_event_chunks(spark, d):
    """Normalised texts in at most three overlapping chunks (SCAL-10, 12, 13)."""
    ship(spark)
    c = table(spark, d, "documents").select("doc_id", F.posexplode(arrow.event_chunks(F.concat(F.lit("doc "), F.col("source")), F.lit(None).cast("string"), "text")).alias("chunk_order", "content"))
    return c.select("doc_id", "chunk_order", text.content_hash("content").alias("content_hash"), F.char_length("content").alias("n"))


@QUERIES.add("""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(trim(regexp_replace(regexp_replace(t, '[-‐‑‒–—_/]+', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 'the and|the|and')) AS mention_count,
       CASE WHEN len(regexp_extract_all(trim(regexp_replace(regexp_replace(t, '[-‐‑‒–—_/]+', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 'the and|the|and')) > 0 THEN 'relevant' ELSE 'irrelevant' END AS relevance FROM t""")
def text_relevance(spark, d):
    """Mentions of a subject's terms, the longest first (SCAL-7..9, AGG-5)."""
    n = text.mentions("text", ["the", "and", "the and"]).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("mention_count"), F.when(n > 0, "relevant").otherwise("irrelevant").alias("relevance"))


def _any_of(words: list[str]) -> str:
    """SQL: t holds one of the fixed words."""
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


#: A fixed head by the document's number, so that each list of words decides some rows.
_HEADED = f"CASE doc_id % 6 WHEN 0 THEN '{V.MARKET_SUBJECT[0]} ' WHEN 1 THEN '{V.MARKET_MOVE[0]} ' WHEN 2 THEN '{V.MARKET_FLOW[0]} ' WHEN 3 THEN '{V.MARKET_SUBJECT[2]} {V.COMPANY_EVENT[0]} ' WHEN 4 THEN '{V.COMPANY_EVENT[1]} ' ELSE '' END || text"


@QUERIES.add(f"""
WITH t AS (SELECT doc_id, {_HEADED} AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN {_any_of(V.MARKET_SUBJECT)} THEN 1.0 ELSE 0 END + CASE WHEN {_any_of(V.MARKET_MOVE)} THEN 1.0 ELSE 0 END
  + CASE WHEN {_any_of(V.MARKET_FLOW)} THEN 0.5 ELSE 0 END - CASE WHEN {_any_of(V.COMPANY_EVENT)} THEN 1.5 ELSE 0 END AS score FROM t)
SELECT doc_id, CAST(score AS DOUBLE) AS market_score FROM s""")
def text_market_score(spark, d):
    """Points for market words less company events (SCAL-38)."""
    return table(spark, d, "documents").select("doc_id", F.expr(_HEADED).alias("text")).select("doc_id", text.market_score("text", F.lit(None).cast("string")).alias("market_score"))


@QUERIES.add(None)
def text_kinds(spark, d):
    """Kinds of texts (SCAL-39, 40, 81)."""
    return table(spark, d, "documents").select("doc_id", text.kind("text", F.lit("")).alias("kind"), text.info_score("text").alias("info_score"))


#: Heads of turns that ask for something, one plan of a question each.
_ASKED = "CASE turn % 4 WHEN 0 THEN '005930 매출 ' WHEN 1 THEN '주가 123456 ' WHEN 2 THEN '1234567 EPS ' ELSE '' END || text"


@QUERIES.add(f"""
WITH asked AS (SELECT conv_id, turn, {_ASKED} AS text FROM conversations)
SELECT conv_id, turn, nullif(regexp_extract(coalesce(text, ''), '\\b(\\d{{6}})\\b', 1), '') AS stock_code, regexp_matches(lower(coalesce(text, '')), '매출|영업이익|순이익|eps|발행주식|계약금액|전환가액|수익률|등락률|배당|자산|부채|자본|현금흐름|주식수|주당순이익') AS need_financials,
       regexp_matches(lower(coalesce(text, '')), '주가|현재가|올랐|내렸|거래량|시세') AS need_price FROM asked""")
def text_query_plan(spark, d):
    """What a turn asks for (SCAL-48)."""
    plan = text.query_plan("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(_ASKED).alias("text")).select("conv_id", "turn", *[plan[k].alias(k) for k in ("stock_code", "need_financials", "need_price")])


@QUERIES.add("""
WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text || ' [' || (turn + 2) || '] [1]', '\\[(\\d+)\\]', 1), lambda x: TRY_CAST(x AS INTEGER)) AS n FROM conversations)
SELECT conv_id, turn, list_sort(list_distinct(list_filter(n, lambda x: x < 1 OR x > 3))) AS bad FROM c""")
def text_citations(spark, d):
    """Citations that point to no source (SCAL-51, 53)."""
    answer = F.concat("text", F.lit(" ["), (F.col("turn") + 2).cast("string"), F.lit("] [1]"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.bad_citations(answer, F.lit(3)).alias("bad"))


@QUERIES.add("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) > 1 AS repeated FROM conversations""")
def text_repeated_calls(spark, d):
    """Calls with the same name and arguments as one before (UDF-15)."""
    from pyspark.sql import Window

    return table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1).alias("repeated"))


@QUERIES.add("""
SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END AS clamped, trim(regexp_replace(regexp_replace(regexp_replace(text, '[*_~`]+', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS plain FROM documents""")
def text_clamp(spark, d):
    """Texts cut to a length, and without decoration (SCAL-16, 78)."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[*_~`]+", ""), "<[^>]+>", " "), r"[ \t\n\x0B\f\r]+", " "))
    return table(spark, d, "documents").select("doc_id", text.clamp("text").alias("clamped"), plain.alias("plain"))


@QUERIES.add("""
SELECT o_orderkey, CASE WHEN n >= 1000000000000 THEN printf('%.2f조원', n / 1e12) WHEN n >= 100000000 THEN printf('%.1f억원', n / 1e8) ELSE format('{:,}', n) || '원' END AS won
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 1000) AS BIGINT) AS n FROM orders)""")
def text_money(spark, d):
    """Amounts as text (SCAL-54, 55)."""
    return table(spark, d, "orders").select("o_orderkey", text.format_won(F.floor(F.col("o_totalprice") * 1000)).alias("won"))


@QUERIES.add("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string('note: ' || props, '$.k') IS NULL AS x FROM (SELECT event_id, props FROM events)""".replace("json_extract_string('note: ' || props, '$.k') IS NULL AS x", "true AS found"))
def text_lenient_json(spark, d):
    """Objects read from replies with words around them (SCAL-44..47)."""
    o = text.json_object(F.concat(F.lit("note: "), "props", F.lit(" end")), "struct<k:bigint>")
    return table(spark, d, "events").select("event_id", o["k"].alias("k"), o.isNotNull().alias("found"))


@QUERIES.add("""
WITH m AS (SELECT event_id, '{"fields":{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '"},"rcept_no":"' || event_id || '","source_api":"events"}' AS j FROM events) SELECT event_id, sha256(j) AS record_key FROM m""")
def text_record_keys(spark, d):
    """Keys of rows from canonical JSON (SCAL-22, 26)."""
    fields = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", text.record_key(F.lit("events"), F.col("event_id").cast("string"), fields).alias("record_key"))


@QUERIES.add("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'low' WHEN value > 90 THEN 'required' WHEN ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR THEN 'skip' WHEN value > 50 THEN 'important' ELSE 'skip' END AS priority FROM events""")
def text_priorities(spark, d):
    """The first of several rules that holds, in a fixed order (FIL-9, 10)."""
    e = table(spark, d, "events")
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))
    p = F.when(F.col("event_type") == "error", "low").when(F.col("value") > 90, "required").when(F.col("ts") < F.col("newest") - F.expr("INTERVAL 1 HOUR"), "skip").when(F.col("value") > 50, "important").otherwise("skip")
    return e.join(newest, F.lit(True)).select("event_id", p.alias("priority"))


@QUERIES.add("""
SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type = 'error' AND (ts > last_ok OR last_ok IS NULL)) AS failures FROM (SELECT *, max(ts) FILTER (event_type <> 'error') OVER (PARTITION BY user_id) AS last_ok FROM events) GROUP BY user_id""")
def state_retries(spark, d):
    """Failures since the last success, and what follows (ST-10, SNK-2)."""
    return state.retry_states(table(spark, d, "events"), ["user_id"], "ts", F.col("event_type") != "error").select("user_id", "attempts", "failures")
