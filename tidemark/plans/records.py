"""Records of filings, clusters and terms: the operators for them over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text
from ..operators import filings, news, search, state
from .common import Plans, table

QUERIES = Plans()
NOW = "TIMESTAMP '1998-06-01 00:00:00'"


def _titles(priority: str) -> str:
    """CASE, the same in both dialects: a filing's title by the order's priority."""
    return f"CASE {priority} WHEN '1-URGENT' THEN '{V.CORE_TITLES[0]}' WHEN '2-HIGH' THEN '합병 결정' WHEN '3-MEDIUM' THEN 'plain note' ELSE 'other note' END"


def _filings(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("rcept_no"), F.expr(_titles("o_orderpriority")).alias("title"), (F.col("o_orderkey") % 7 == 0).alias("truncated"), F.col("o_orderdate").cast("timestamp").alias("disclosed_at"), (F.col("o_orderkey") % 5 == 0).alias("is_correction"), F.when(F.col("o_orderkey") % 2 == 0, "text").alias("raw_text"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "unavailable").alias("parse_status"))


_PRIORITY = f"""
WITH f AS (SELECT o_orderkey AS rcept_no, {_titles('o_orderpriority')} AS title, o_orderkey % 7 = 0 AS truncated, o_orderdate AS filed_at, o_orderkey % 5 = 0 AS correction, o_orderkey % 2 = 0 AS has_text, o_orderstatus AS s FROM orders),
p AS (SELECT *, CASE WHEN truncated OR title = '{V.CORE_TITLES[0]}' THEN 'required' WHEN filed_at < {NOW} - INTERVAL 365 DAYS THEN 'skip' WHEN title = '합병 결정' OR correction THEN 'important' ELSE 'skip' END AS priority FROM f)
"""


@QUERIES.add(_PRIORITY + "SELECT priority, count(*) AS n, min(rcept_no) AS lowest FROM p GROUP BY 1")
def filing_priorities(spark, d):
    """What a filing's title, age and corrections make of it (FIL-9)."""
    p = text.document_priority("title", "truncated", "disclosed_at", "is_correction", F.expr(NOW))
    return _filings(spark, d).groupBy(p.alias("priority")).agg(F.count("*").alias("n"), F.min("rcept_no").alias("lowest"))


@QUERIES.add(_PRIORITY + "SELECT rcept_no, priority FROM p WHERE priority IN ('required', 'important') AND (truncated OR NOT has_text OR s <> 'F') AND s <> 'P'")
def filing_documents(spark, d):
    """Filings whose document is still to be fetched (SRC-11, 40, FIL-10)."""
    return filings.needing_text(_filings(spark, d), F.expr(NOW)).select("rcept_no", "priority")


_ACCOUNT_ID = "CASE WHEN l_linenumber = 1 THEN 'ifrs-full_Revenue' WHEN l_linenumber = 2 THEN 'dart_OperatingIncomeLoss' ELSE 'none' END"
_ACCOUNT_NAME = "CASE WHEN l_linenumber = 3 THEN '자산총계' WHEN l_linenumber = 4 THEN '영업활동현금흐름' WHEN l_linenumber = 5 THEN '매출액' ELSE 'unknown' END"


def _statements(spark, d):
    l = table(spark, d, "lineitem")
    amount = lambda c: F.col(c).cast("long").cast("string")
    rows = l.select(F.col("l_suppkey").alias("stock_code"), F.year("l_shipdate").alias("bsns_year"), F.lit("11011").alias("reprt_code"), F.col("l_returnflag").alias("fs_div"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.expr(_ACCOUNT_ID).alias("account_id"), F.expr(_ACCOUNT_NAME).alias("account_nm"), amount("l_extendedprice").alias("thstrm_amount"), F.when(F.col("l_orderkey") % 2 == 0, amount("l_partkey")).otherwise("-").alias("thstrm_add_amount"), amount("l_quantity").alias("frmtrm_amount"), F.lit("5").alias("frmtrm_q_amount"), F.lit("1,234").alias("frmtrm_add_amount"), (F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("tie"))
    w = ["stock_code", "bsns_year", "fs_div", "ord"]
    return rows.groupBy(*w).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (*w, "tie")]), F.struct("tie", "thstrm_amount")).alias("r")).select(*w, "r.*")


_STATEMENTS = f"""
WITH l AS (SELECT l_suppkey AS stock_code, year(l_shipdate) AS bsns_year, l_returnflag AS fs_div, l_orderkey * 10 + l_linenumber AS ord, {_ACCOUNT_ID} AS id, {_ACCOUNT_NAME} AS nm, CAST(trunc(l_extendedprice) AS BIGINT) AS a, CASE WHEN l_orderkey % 2 = 0 THEN l_partkey END AS c, CAST(trunc(l_quantity) AS BIGINT) AS f, l_orderkey * 100000 + l_partkey AS tie FROM lineitem),
u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY stock_code, bsns_year, fs_div, ord ORDER BY tie, CAST(a AS VARCHAR)) = 1),
m AS (SELECT *, CASE WHEN id = 'ifrs-full_Revenue' THEN '매출액' WHEN id = 'dart_OperatingIncomeLoss' THEN '영업이익' WHEN nm <> 'unknown' THEN nm END AS account, CASE WHEN id <> 'none' THEN 0 ELSE 1 END AS priority FROM u),
o AS (SELECT * FROM m WHERE account IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stock_code, bsns_year, fs_div, account ORDER BY priority, ord) = 1),
s AS (SELECT stock_code, bsns_year, fs_div, account AS account_nm, a AS thstrm_amount, 5 AS frmtrm_amount, 'quarter' AS amount_type FROM o WHERE account IN ('매출액', '영업이익') AND c IS NOT NULL
UNION ALL SELECT stock_code, bsns_year, fs_div, account, c, 1234, 'cumulative' FROM o WHERE account IN ('매출액', '영업이익') AND c IS NOT NULL
UNION ALL SELECT stock_code, bsns_year, fs_div, account, a, f, 'cumulative' FROM o WHERE account = '영업활동현금흐름' OR account IN ('매출액', '영업이익') AND c IS NULL
UNION ALL SELECT stock_code, bsns_year, fs_div, account, a, f, 'point_in_time' FROM o WHERE account = '자산총계')
"""


@QUERIES.add(_STATEMENTS + "SELECT stock_code, bsns_year, fs_div, account_nm, thstrm_amount, frmtrm_amount, amount_type FROM s")
def statement_rows(spark, d):
    """Standard accounts by id, else by name, with quarter and cumulative amounts (SCAL-27, 28)."""
    return filings.statement_rows(_statements(spark, d)).select("stock_code", F.col("bsns_year").cast("long").alias("bsns_year"), "fs_div", "account_nm", "thstrm_amount", "frmtrm_amount", "amount_type")


@QUERIES.add(_STATEMENTS + "SELECT fs_div, bsns_year, account_nm, amount_type, thstrm_amount FROM (SELECT * FROM s WHERE stock_code = 3 AND account_nm IN ('매출액', '자산총계') ORDER BY bsns_year DESC, account_nm, fs_div, amount_type LIMIT 20)")
def financial_facts(spark, d):
    """A stock's newest facts of some accounts (FIL-15, 16, UDF-10)."""
    got = filings.financial_facts(filings.statement_rows(_statements(spark, d)), 3, ["매출액", "자산총계"])
    return got.select("fs_div", F.col("bsns_year").cast("long").alias("bsns_year"), "account_nm", "amount_type", "thstrm_amount")


@QUERIES.add(_STATEMENTS + "SELECT account_nm, CASE WHEN account_nm = '자산총계' THEN 'point_in_time' WHEN account_nm = '영업활동현금흐름' OR bsns_year % 2 = 0 THEN 'cumulative' ELSE 'quarter' END AS meant, count(*) AS n FROM s GROUP BY 1, 2")
def amount_types(spark, d):
    """The amount that a question means, by account and period (FIL-17)."""
    s = filings.statement_rows(_statements(spark, d))
    return s.groupBy("account_nm", filings.default_amount_type(F.col("account_nm"), F.col("bsns_year") % 2 == 0).alias("meant")).agg(F.count("*").alias("n"))


@QUERIES.add("""
SELECT o_orderkey, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS shares, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS purpose, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_missing, 3 - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_fields FROM orders""")
def filing_fields(spark, d):
    """Named fields of a filing under standard keys, and every field with its kind (SCAL-24, 25)."""
    o = table(spark, d, "orders")
    fields = F.create_map(F.lit("n"), F.format_number(F.floor("o_totalprice").cast("long"), 0), F.lit("aq_dd"), F.date_format("o_orderdate", "yyyy'년 'M'월 'd'일'"), F.lit("p"), F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(F.col("o_orderpriority")))
    x = o.select("o_orderkey", filings.map_fields(fields, {"n": "shares"}, {"aq_dd": "day"}, {"p": "purpose"}, ["shares", "purpose"]).alias("x"), filings.typed_fields(fields).alias("t"))
    get = lambda k: F.try_element_at("x.values", F.lit(k))
    return x.select("o_orderkey", get("shares").alias("shares"), get("day").alias("day"), get("purpose").alias("purpose"), F.size("x.missing").alias("n_missing"), F.size("t").alias("n_fields"))


@QUERIES.add("""
SELECT coalesce(c_custkey, s_suppkey) AS stock_code, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE s_name END AS corp_name, CASE WHEN c_custkey % 4 = 1 THEN 'https://c' || c_custkey || '.com' ELSE 'http://s' || s_suppkey || '.com' END AS homepage FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def company_profiles(spark, d):
    """Master fields, else those of the profile's payload; addresses get a scheme (SRC-17, 18, 22, 42)."""
    s = table(spark, d, "supplier")
    payload = F.to_json(F.struct(F.col("s_name").alias("corp_name"), F.concat(F.lit("http://s"), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("hm_url"), F.lit("19690113").alias("est_dt")))
    profile = filings.company_profile(s.select(F.col("s_suppkey").alias("stock_code"), payload.alias("payload")))
    master = table(spark, d, "customer").select(F.col("c_custkey").alias("stock_code"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise(" ").alias("corp_name"), F.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".com"))).alias("homepage"))
    return filings.merge_company(master, profile, ["corp_name", "homepage"])


@QUERIES.add("SELECT event_id, event_type FROM (SELECT * FROM events WHERE user_id = 3 AND event_type IN ('view', 'click') ORDER BY event_id DESC LIMIT 10)")
def structured_filings(spark, d):
    """A stock's newest structured filings of some kinds (FIL-14, UDF-12)."""
    e = table(spark, d, "events").select(F.col("user_id").alias("stock_code"), "event_type", F.col("event_id").alias("rcept_no"))
    return filings.structured_values(e, 3, ["view", "click"]).select(F.col("rcept_no").alias("event_id"), "event_type")


@QUERIES.add("""
SELECT o_orderkey, true AS graded, length(CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR)) < 3 OR o_orderkey % 2 = 0 AS graded_short FROM orders""")
def graded_amounts(spark, d):
    """Answers that hold an amount (AGG-42)."""
    v = F.col("o_totalprice").cast("long")
    short = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("약 "), text.format_won(v))).otherwise(F.lit("about 12"))
    return table(spark, d, "orders").select("o_orderkey", filings.grade_amount(F.concat(F.lit("= "), v.cast("string")), v).alias("graded"), filings.grade_amount(short, v).alias("graded_short"))


# News ---------------------------------------------------------------------------------------------


@QUERIES.add("""
SELECT e.event_id, e.user_id FROM events e JOIN orders o ON e.event_id = o.o_orderkey WHERE e.event_type = 'click' AND e.value > 20 AND e.event_id % 2 = 0 AND o.o_orderstatus = 'F' AND o.o_orderdate >= TIMESTAMP '1995-01-01'""")
def event_pairs(spark, d):
    """Links that may join a cluster: relevant company events of crawled articles (FIL-19, 21)."""
    e = table(spark, d, "events")
    links = e.select(F.col("event_id").alias("article_id"), "user_id", F.when(F.col("value") > 20, "relevant").otherwise("irrelevant").alias("relevance"), (F.col("event_id") % 2 == 0).alias("event_eligible"), F.when(F.col("event_type") == "click", "company_event").otherwise("other").alias("article_role"), F.lit("v1").alias("role_version"))
    articles = table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("crawl_status"), F.col("o_orderdate").alias("published_at"))
    return news.event_pairs(links, articles, "v1", F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'")).select(F.col("article_id").alias("event_id"), "user_id")


@QUERIES.add("""
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE user_id % 3 <> 0),
f AS (SELECT * FROM a WHERE nth <= 12)
SELECT user_id AS cluster_id, count(*) AS n, min(event_id) AS lowest, max(event_id) AS highest FROM f GROUP BY 1""")
def clusters_to_summarise(spark, d):
    """Clusters without a summary, each with its first articles (SRC-38, 39, ST-28)."""
    e = table(spark, d, "events")
    clusters = e.select(F.col("user_id").alias("cluster_id")).distinct().select("cluster_id", F.lit("v1").alias("clustering_version"), F.when(F.col("cluster_id") % 3 == 0, "success").alias("summary_status"))
    got = news.to_summarise(clusters, e.select(F.col("user_id").alias("cluster_id"), F.col("ts").alias("assigned_at"), F.col("event_id").alias("article_id")), e.select(F.col("event_id").alias("article_id"), F.col("event_type").alias("title")), "v1")
    ids = F.transform("articles", lambda x: x["article_id"])
    return got.select("cluster_id", F.size("articles").cast("long").alias("n"), F.array_min(ids).alias("lowest"), F.array_max(ids).alias("highest"))


@QUERIES.add("""
WITH a AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS m FROM events GROUP BY 1) SELECT user_id AS cluster_id FROM a WHERE n <> m OR user_id % 5 = 0""")
def dirty_clusters(spark, d):
    """Clusters whose count is not what it was, new ones included (ST-28, SNK-18)."""
    e = table(spark, d, "events")
    after = e.groupBy(F.col("user_id").alias("cluster_id")).agg(F.count("*").alias("article_count"))
    before = e.groupBy(F.col("user_id").alias("cluster_id")).agg(F.count(F.when(F.col("event_type") != "error", 1)).alias("article_count")).where("cluster_id % 5 <> 0")
    return news.dirty_clusters(before, after)


@QUERIES.add("""
SELECT conv_id AS cluster_id, string_agg(CAST(turn AS VARCHAR), '|' ORDER BY turn) AS article_ids, '' AS label FROM conversations GROUP BY 1""")
def label_templates(spark, d):
    """Rows for people to label (SNK-35)."""
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("cluster_id"), F.col("turn").alias("article_id"), F.col("turn").alias("published_at"), F.col("role").alias("press"), F.lit("u").alias("url"))
    return news.label_template(news.cluster_sources(m)).select("cluster_id", "article_ids", "label")


@QUERIES.add("""
WITH f AS (SELECT event_type AS stock_code, user_id AS cluster_id, event_id AS article_id, ts, min(ts) OVER (PARTITION BY event_type, user_id) AS first_at FROM events)
SELECT stock_code, article_id, cluster_id, CAST(row_number() OVER (PARTITION BY stock_code ORDER BY first_at, cluster_id, ts, article_id) AS INTEGER) AS sample_order FROM f""")
def blind_samples(spark, d):
    """Numbered rows without their cluster, and the key to them (SNK-36)."""
    e = table(spark, d, "events").select(F.col("event_type").alias("stock_code"), F.col("user_id").alias("cluster_id"), F.col("event_id").alias("article_id"), F.col("ts").alias("published_at"))
    blind, key = news.blind_sample(e)
    return blind.select("stock_code", "article_id", "sample_order").join(key, ["stock_code", "article_id", "sample_order"])


@QUERIES.add("""
WITH v AS (SELECT user_id AS path, event_id % 4 AS o, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2) SELECT path, arg_max(o, struct_pack(n := n, o := -o)) AS "offset" FROM v GROUP BY 1""")
def page_offsets(spark, d):
    """The most frequent difference of a page's place and its printed number (SCAL-63)."""
    e = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("pos"), (F.col("event_id") - F.col("event_id") % 4).alias("printed"))
    return news.page_offset(e)


@QUERIES.add("""
WITH p AS (SELECT o_custkey AS cluster_id, unnest([o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END]) AS text FROM orders) SELECT DISTINCT cluster_id, text FROM p WHERE text IS NOT NULL""")
def cluster_prototypes(spark, d):
    """Anchors and representatives that are to be encoded, once each (ST-30)."""
    return news.prototypes(table(spark, d, "orders").select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderpriority").alias("anchor_title"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("rep_title")))


@QUERIES.add("SELECT CAST(ceil(sum(length(text)) / 1.5::DOUBLE) AS BIGINT) AS tokens, round(sum(length(text)) / 1.5::DOUBLE / 1e6 * 0.1, 6) AS dollars FROM documents")
def embedding_cost(spark, d):
    """What embedding a column would take (AGG-41)."""
    return news.embedding_cost(table(spark, d, "documents"), "text")


@QUERIES.add("""
SELECT user_id, event_type, max(value) AS score FROM events GROUP BY 1, 2""")
def best_parameters(spark, d):
    """A sweep's best score for each set of parameters (AGG-40, SNK-29)."""
    return news.best_parameters(table(spark, d, "events").select("user_id", "event_type", F.col("value").alias("score")), ["user_id", "event_type"], "score")


@QUERIES.add("""
SELECT user_id AS run, list_sort(list_distinct(list(event_type))) AS source_ids, CAST(count(DISTINCT event_id % 5) AS INTEGER) AS n_amounts FROM events GROUP BY 1""")
def run_evidence(spark, d):
    """Sources and amounts that a run's tools returned (SCAL-52)."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.array("event_type").alias("sources"), F.array(F.col("event_id") % 5).alias("amounts"))
    return news.evidence(e).select("run", "source_ids", F.size("amounts").alias("n_amounts"))


@QUERIES.add("""
WITH n AS (SELECT lower(replace(p_name, ' ', '')) AS t, p_partkey FROM part), a AS (SELECT DISTINCT t FROM n WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT t FROM n WHERE p_partkey % 3 = 0)
SELECT 'unparsed' AS side, t FROM a WHERE t NOT IN (SELECT t FROM b) UNION ALL SELECT 'unlisted', t FROM b WHERE t NOT IN (SELECT t FROM a)""")
def glossary_differences(spark, d):
    """Terms that only one of two lists holds (JOIN-25)."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("term"))
    a, b = news.glossary_differences(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"))
    return a.select(F.lit("unparsed").alias("side"), "t").union(b.select(F.lit("unlisted").alias("side"), "t"))


@QUERIES.add("""
SELECT p_partkey, 'e5: ' || p_name || ' ' || p_brand AS model_text, lower(p_brand || ' ' || p_name) AS glossary, 'List' || chr(10) || '[1] ' || p_name || chr(10) || substr(p_type, 1, 5) AS prompt FROM part""")
def model_inputs(spark, d):
    """Texts as models and searches want them (SCAL-56, 66, 76, 89, 90)."""
    p = table(spark, d, "part")
    item = F.array(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("body")))
    given = news.model_input(news.input_text("description", F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string")), "e5-base", "e5: ")
    return p.select("p_partkey", given.alias("model_text"), F.trim(news.glossary_text(F.col("p_brand"), F.lit(None).cast("string"), F.array(F.col("p_name")), F.lit(None).cast("string"))).alias("glossary"), news.prompt(F.lit("List"), item, 5).alias("prompt"))


@QUERIES.add("""
SELECT CAST(count(*) FILTER (o_orderkey % 2 = 0) AS BIGINT) AS remaining, 'open' AS "check", count(*) FILTER (o_orderkey % 2 = 0) = 0 AS ok FROM orders UNION ALL SELECT 0, 'none', true""")
def activation_gate(spark, d):
    """What is left before a version is activated (ST-19)."""
    o = table(spark, d, "orders")
    return state.activation_gate({"open": o.where("o_orderkey % 2 = 0"), "none": o.where("o_orderkey < 0")})


@QUERIES.add("SELECT CAST(min(CASE WHEN event_type = 'error' THEN greatest(0, 1800 - (epoch(date_trunc('second', m)) - epoch(date_trunc('second', ts)))) ELSE 7200 END) AS BIGINT) AS seconds FROM events, (SELECT max(ts) AS m FROM events)")
def seconds_until_retry(spark, d):
    """The shortest wait until a retry is due (LIM-6)."""
    e = table(spark, d, "events")
    x = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))), F.lit(True))
    return state.seconds_until_retry(x.withColumn("next", F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 30 MINUTES")).otherwise(F.col("now") + F.expr("INTERVAL 2 HOURS"))), "next", F.col("now"))


@QUERIES.add("""
WITH t AS (SELECT p_partkey AS term_id, lower(p_name) AS term, lower(p_brand) AS alias, lower(p_name || ' ' || p_type) AS whole FROM part),
c AS (SELECT s_suppkey AS query_id, unnest([0, 1]) AS nth, unnest([CASE s_suppkey % 3 WHEN 0 THEN 'cold widget' WHEN 1 THEN 'brand#13' ELSE 'omy' END, CASE s_suppkey % 3 WHEN 2 THEN 'get eco' ELSE 'zzz' END]) AS c FROM supplier),
f AS (SELECT query_id, term_id, 1 AS stage, nth FROM c JOIN t ON c.c = t.term UNION ALL SELECT query_id, term_id, 2, nth FROM c JOIN t ON c.c = t.alias),
r AS (SELECT * FROM f UNION ALL SELECT query_id, term_id, 3, -length(c) FROM c JOIN t ON contains(t.whole, c.c) WHERE query_id NOT IN (SELECT query_id FROM f))
SELECT query_id, arg_min(term_id, struct_pack(s := stage, n := nth, i := term_id)) AS term_id, min(stage) AS stage FROM r GROUP BY 1""")
def term_lookup(spark, d):
    """A term by name, alias or the longest candidate that its text holds (SCAL-50, UDF-14)."""
    terms = table(spark, d, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"), F.array("p_brand").alias("aliases"), F.concat_ws(" ", "p_name", "p_type").alias("search_text"))
    third = F.col("s_suppkey") % 3
    names = F.array(F.when(third == 0, "Cold widget").when(third == 1, "brand#13").otherwise("omy"), F.when(third == 2, "get eco").otherwise("zzz"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.posexplode(names).alias("nth", "candidate"))
    return search.lookup_terms(c, terms)


@QUERIES.add("""
SELECT event_id, CAST(CASE WHEN m < 60 THEN greatest(m, 0) || ' min' WHEN m < 1440 THEN CAST(floor(m / 60) AS BIGINT) || ' h' ELSE CAST(floor(m / 1440) AS BIGINT) || ' d' END AS VARCHAR) AS ago, strftime(ts + INTERVAL 9 HOURS, '%Y-%m-%d') AS day, CAST(time_bucket(INTERVAL 30 MINUTE, ts) AS TIMESTAMP) AS half FROM (SELECT *, CAST(floor((epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts))) / 60) AS BIGINT) AS m FROM events)""")
def shown_times(spark, d):
    """Times as they are shown (SCAL-71)."""
    e = table(spark, d, "events")
    return e.select("event_id", text.relative_time("ts", F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("ago"), text.kst_day("ts").alias("day"), text.half_hour("ts").cast("timestamp_ntz").alias("half"))


@QUERIES.add("""
SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS short FROM documents""")
def clamped_texts(spark, d):
    """Texts cut to a width."""
    return table(spark, d, "documents").select("doc_id", text.clamp("text", 40).alias("short"))


@QUERIES.add("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS first_day, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS correction FROM orders""")
def correction_notes(spark, d):
    """Dates of first submission in notes, and filings that correct others (SCAL-67, SCAL-69)."""
    o = table(spark, d, "orders")
    note = F.concat(F.lit("정정대상 공시서류의 최초제출일 : "), F.date_format("o_orderdate", "yyyy'년 'M'월 'd'일'"))
    title = F.when(F.col("o_orderkey") % 2 == 0, "[기재정정] 보고").otherwise("보고")
    return o.select("o_orderkey", F.date_format(text.first_submission_date(note), "yyyy-MM-dd").alias("first_day"), text.is_correction(title, F.when(F.col("o_orderkey") % 3 == 0, note).otherwise("plain"), F.lit(False)).alias("correction"))


@QUERIES.add("""
SELECT event_id, CAST(k AS BIGINT) AS amount, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS day FROM (SELECT *, CAST(trunc(value * 1000) AS BIGINT) AS k FROM events)""")
def parsed_values(spark, d):
    """Amounts with commas and dates in many forms (SCAL-19, SCAL-20)."""
    e = table(spark, d, "events")
    shown = F.format_number((F.col("value") * 1000).cast("long"), 0)
    form = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyyMMdd")).when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy. M. d")).otherwise("none")
    return e.select("event_id", text.amount(shown).alias("amount"), F.date_format(text.flexible_date(form), "yyyy-MM-dd").alias("day"))
