"""Aggregations, metrics, quality checks and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import metrics, timeseries
from .common import Plans, table

QUERIES = Plans()


@QUERIES.add("""
SELECT source, count(*) AS n, min(doc_id) AS first_id, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (n_chars > 2000) AS n_long FROM documents GROUP BY source""")
def agg_summary(spark, d):
    """Count, minimum and counts by condition of each group (AGG-1)."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("n_chars") > 2000).alias("n_long"))


@QUERIES.add("""
SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""")
def agg_grouping_sets(spark, d):
    """Counts by either key and of all in one pass (AGG-1, 5)."""
    table(spark, d, "documents").createOrReplaceTempView("__docs")
    return spark.sql("SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM __docs GROUP BY GROUPING SETS ((source), (lang), ())")


@QUERIES.add("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def agg_inventory(spark, d):
    """Rows and distinct keys by kind (AGG-2, 3, 6)."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@QUERIES.add("SELECT user_id, round(sum((event_id % 700) * 15 + (event_id % 90) * 60)::DOUBLE / 1e8, 8) AS cost FROM events GROUP BY user_id")
def agg_token_cost(spark, d):
    """Cost of calls from their tokens, summed in whole units of the price list (AGG-4, 35, 43)."""
    units = (F.col("event_id") % 700) * int(V.PROMPT_PRICE * 100) + (F.col("event_id") % 90) * int(V.COMPLETION_PRICE * 100)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(units) / 1e8, 8).alias("cost"))


_CONTINGENCY = """
WITH i AS (SELECT CAST(label AS BIGINT) AS gold, vec_id % 7 AS pred FROM embeddings),
c AS (SELECT pred, gold, count(*)::DOUBLE AS n FROM i GROUP BY 1, 2),
p AS (SELECT pred, sum(n) AS a FROM c GROUP BY 1), g AS (SELECT gold, sum(n) AS b FROM c GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
j AS (SELECT * FROM c JOIN p USING (pred) JOIN g USING (gold), t),
s AS (SELECT max(total) AS items, sum(n * n / a) / max(total) AS bp, sum(n * n / b) / max(total) AS br, sum(n * (n - 1) / 2) AS tp, max(total * (total - 1) / 2) AS pairs, sum(n / total * ln(n * total / (a * b))) AS mi FROM j),
u AS (SELECT sum(a * (a - 1) / 2) AS sp, -sum(a / total * ln(a / total)) AS hp FROM p, t), v AS (SELECT sum(b * (b - 1) / 2) AS sg, -sum(b / total * ln(b / total)) AS hg FROM g, t)
SELECT CAST(items AS BIGINT) AS items, round(bp, 9) AS bcubed_precision, round(br, 9) AS bcubed_recall, round(2 * bp * br / (bp + br), 9) AS bcubed_f1, round(tp / sp, 9) AS pairwise_precision, round(tp / sg, 9) AS pairwise_recall,
 round(2 * (tp / sp) * (tp / sg) / (tp / sp + tp / sg), 9) AS pairwise_f1, round((sp - tp) / (pairs - sg), 9) AS over_merge_rate, round((sg - tp) / sg, 9) AS under_merge_rate,
 round((tp - sp * sg / pairs) / ((sp + sg) / 2 - sp * sg / pairs), 9) AS ari, round(greatest(0, mi) / ((hp + hg) / 2), 9) AS nmi FROM s, u, v"""


@QUERIES.add(_CONTINGENCY)
def agg_clustering_scores(spark, d):
    """B-cubed, pairwise, merge rates, ARI and NMI (AGG-12..16, JOIN-23)."""
    pairs = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("gold"), (F.col("vec_id") % 7).alias("pred"))
    got = metrics.clustering_scores(pairs)
    return got.select("items", *[F.round(c, 9).alias(c) for c in got.columns if c != "items"])


@QUERIES.add("""
WITH i AS (SELECT label AS stock, vec_id % 5 AS pred, vec_id % 3 AS gold FROM embeddings), c AS (SELECT stock, pred, gold, count(*)::DOUBLE AS n FROM i GROUP BY ALL),
x AS (SELECT *, sum(n) OVER (PARTITION BY stock, pred) AS a, sum(n) OVER (PARTITION BY stock, gold) AS b, sum(n) OVER (PARTITION BY stock) AS t FROM c)
SELECT stock, round(sum(n * n / a) / max(t), 9) AS bcubed_precision, round(sum(n * n / b) / max(t), 9) AS bcubed_recall FROM x GROUP BY stock""")
def agg_scores_by_stock(spark, d):
    """Scores of every group; a missing prediction is an error (AGG-17)."""
    e = table(spark, d, "embeddings")
    per, _ = metrics.scores_by_stock(e.select(F.col("vec_id").alias("item"), (F.col("vec_id") % 5).alias("pred")), e.select(F.col("vec_id").alias("item"), F.col("label").alias("stock"), (F.col("vec_id") % 3).alias("gold")))
    return per.select("stock", F.round("bcubed_precision", 9).alias("bcubed_precision"), F.round("bcubed_recall", 9).alias("bcubed_recall"))


@QUERIES.add("""
WITH r AS (SELECT role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)
SELECT role, count(*) AS n, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 3) AS recall, round(avg(1.0::DOUBLE / rank), 3) AS mrr FROM r GROUP BY role""")
def agg_recall_mrr(spark, d):
    """recall@k and MRR by kind of question (AGG-18, 21, 39)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return metrics.recall_mrr(table(spark, d, "conversations").withColumn("rank", F.row_number().over(w)), 3, ["role"])


@QUERIES.add("""
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) - 1 AS m FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (i = round_even(0.5::DOUBLE * m, 0)) AS p50, max(value) FILTER (i = round_even(0.95::DOUBLE * m, 0)) AS p95 FROM s GROUP BY event_type""")
def agg_nearest_rank(spark, d):
    """Percentiles by position (AGG-20, 34)."""
    return metrics.nearest_rank(table(spark, d, "events"), "value", ["event_type"], [50, 95])


@QUERIES.add("""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9A-Za-z가-힣]{2,}'))) AS token FROM documents)
SELECT token, count(*) AS df FROM w GROUP BY token HAVING count(*) <= (SELECT count(*) FROM documents) * 0.05""")
def agg_token_frequency(spark, d):
    """Document frequency of tokens that few documents hold (AGG-19, SCAL-77)."""
    return metrics.token_frequency(table(spark, d, "documents"), F.col("text"))


@QUERIES.add("""
WITH t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[0-9A-Za-z가-힣]{2,}'))) AS token FROM benchmark),
c AS (SELECT token, (SELECT count(*) FROM documents WHERE contains(lower(text), token)) AS df FROM t WHERE token NOT IN (SELECT lower(unnest(string_split(p_name, ' '))) FROM part))
SELECT token, df FROM c WHERE df <= (SELECT count(*) FROM documents) * 0.05""")
def agg_substring_frequency(spark, d):
    """Documents that contain a title's token anywhere, for rare tokens that are no names (AGG-19, SCAL-77)."""
    tokens = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"([0-9A-Za-z가-힣]{2,})"), 1)).alias("token"))
    names = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    return metrics.substring_frequency(tokens, table(spark, d, "documents"), F.col("text"), without=names)


@QUERIES.add("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def quality_duplicates(spark, d):
    """Keys that occur more than once (AGG-25, 27, 29, 38)."""
    return metrics.duplicates(table(spark, d, "documents"), ["text"])


@QUERIES.add("""
SELECT lang, count(*) FILTER (length(text) > 50000) AS too_long, count(*) FILTER (length(text) < 200) AS too_short, sum(length(text) - length(replace(text, '<', '')))::BIGINT AS tags, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents GROUP BY lang""")
def quality_texts(spark, d):
    """Lengths and traces of markup (AGG-25, 26)."""
    n = F.char_length("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(n > 50000).alias("too_long"), F.count_if(n < 200).alias("too_short"), F.sum(n - F.char_length(F.replace("text", F.lit("<"), F.lit("")))).alias("tags"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))


@QUERIES.add("""
SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(json_keys(props)) AS k, props AS p) WHERE k <> 'id' AND CAST(json_extract_string(p, '$.' || k) AS BIGINT) > 10)""")
def quality_json_entries(spark, d):
    """Rows whose JSON has no entry that counts (AGG-28, FIL-11)."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").where(~F.exists(F.map_entries(m), lambda e: (e["key"] != "id") & (e["value"].cast("bigint") > 10))).select("event_id")


@QUERIES.add("""SELECT 'documents' AS "table", count(*) AS rows FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages""")
def quality_snapshot(spark, d):
    """Row counts of tables (AGG-30, ST-32)."""
    return metrics.snapshot({t: table(spark, d, t) for t in ("documents", "events", "pages")})


@QUERIES.add("""
WITH b AS (SELECT user_id, time_bucket(INTERVAL 30 MINUTE, ts) AS bucket, event_type FROM events), k AS (SELECT DISTINCT user_id, bucket FROM b),
c AS (SELECT user_id, bucket, event_type, count(*) AS n, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS p FROM b WHERE event_type IN ('error', 'click', 'view') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY n DESC, p) AS i FROM c)
SELECT k.user_id, k.bucket, r.event_type AS dominant FROM k LEFT JOIN r ON r.user_id = k.user_id AND r.bucket = k.bucket AND i = 1""")
def agg_dominant_label(spark, d):
    """The most frequent label of each half hour, ties in a fixed order (AGG-31, SCAL-71)."""
    from ..functions.text import half_hour

    e = table(spark, d, "events").select("user_id", half_hour("ts").cast("timestamp_ntz").alias("bucket"), "event_type")
    return metrics.dominant(e, ["user_id", "bucket"], "event_type", ["error", "click", "view"])


@QUERIES.add("""
SELECT conv_id, list_distinct(list(role ORDER BY turn))[1] AS first_role, len(list_distinct(list(role))) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id""".replace("list_distinct(list(role ORDER BY turn))[1]", "arg_min(role, turn)"))
def agg_first_seen(spark, d):
    """Distinct labels in the order of their first sight (AGG-32)."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])).alias("r"), F.count("*").alias("turns"))
    return g.select("conv_id", F.get("r", F.lit(0)).alias("first_role"), F.size("r").cast("long").alias("roles"), "turns")


@QUERIES.add("""
WITH s AS (SELECT label AS stock, vec_id // 10 AS cluster_id, count(*) AS n FROM embeddings GROUP BY 1, 2)
SELECT stock, count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n = 1)::DOUBLE / count(*) AS singleton_ratio, max(n) AS largest, count(*) FILTER (n >= 3) AS "large" FROM s GROUP BY stock""")
def agg_overmerge(spark, d):
    """Sizes of clusters (AGG-10, 11, 37)."""
    from ..operators.cluster import overmerge

    return overmerge(table(spark, d, "embeddings").select(F.col("label").alias("stock"), F.floor(F.col("vec_id") / 10).alias("cluster_id")), ["stock"], large=3)


@QUERIES.add("""
WITH m AS (SELECT vec_id // 20 AS base, label AS other, count(*) AS n FROM embeddings GROUP BY 1, 2)
SELECT base, count(*) AS pieces, sum(n)::BIGINT AS members, max(n)::DOUBLE / sum(n) AS largest_share FROM m GROUP BY base""")
def agg_partition_pieces(spark, d):
    """The pieces that one clustering cuts another's clusters into (JOIN-27, 28, WIN-18)."""
    m = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 20).alias("base"), "label").agg(F.count("*").alias("n"))
    return m.groupBy("base").agg(F.count("*").alias("pieces"), F.sum("n").alias("members"), (F.max("n") / F.sum("n")).alias("largest_share"))


@QUERIES.add("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), l AS (SELECT o_custkey, max(y) AS y FROM y GROUP BY 1)
SELECT c.o_custkey, c.y AS year, round(c.v, 2) AS value, CASE WHEN p.v <> 0 THEN round((c.v - p.v) / abs(p.v) * 100, 1) END AS change
FROM l JOIN y c USING (o_custkey, y) LEFT JOIN y p ON p.o_custkey = c.o_custkey AND p.y = c.y - 1""")
def agg_headline(spark, d):
    """The latest period of each key and its change from the one before (AGG-9, WIN-6, 7)."""
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    latest = y.groupBy("o_custkey").agg(F.max("year").alias("year"))
    before = y.select("o_custkey", (F.col("year") + 1).alias("year"), F.col("v").alias("p"))
    got = latest.join(y, ["o_custkey", "year"]).join(before, ["o_custkey", "year"], "left")
    return got.select("o_custkey", "year", F.round("v", 2).alias("value"), F.when(F.col("p") != 0, F.round((F.col("v") - F.col("p")) / F.abs("p") * 100, 1)).alias("change"))


@QUERIES.add("""
WITH r AS (SELECT l_suppkey, CAST(year(l_shipdate) AS VARCHAR) AS y, CASE quarter(l_shipdate) WHEN 1 THEN '11013' WHEN 2 THEN '11012' WHEN 3 THEN '11014' ELSE '11011' END AS c, quarter(l_shipdate) AS q FROM lineitem)
SELECT l_suppkey, arg_max(y, y || q) AS report_year, arg_max(c, y || q) AS report_code FROM r GROUP BY l_suppkey""")
def latest_reports(spark, d):
    """The latest report by year and the rank of its code (WIN-7)."""
    q = F.quarter("l_shipdate")
    code = F.when(q == 1, "11013").when(q == 2, "11012").when(q == 3, "11014").otherwise("11011")
    r = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("string").alias("report_year"), code.alias("report_code"))
    return timeseries.latest_report(r, ["l_suppkey"], "report_year", "report_code", V.REPORT_RANK)


@QUERIES.add("""
WITH RECURSIVE u AS (SELECT sha256(text) AS unit, min(source) AS stock, count(*) AS rows FROM documents GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY stock ORDER BY rows DESC, md5('42:' || unit), unit) AS nth, CAST(sum(rows) OVER (PARTITION BY stock) AS DOUBLE) AS total FROM u),
r AS (
  SELECT DISTINCT stock, 0::BIGINT AS nth, ''::VARCHAR AS unit, 0::BIGINT AS rows, ''::VARCHAR AS split, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c FROM o
  UNION ALL
  SELECT stock, nth, unit, rows, split, a + CASE split WHEN 'development' THEN rows ELSE 0 END, b + CASE split WHEN 'validation' THEN rows ELSE 0 END, c + CASE split WHEN 'test' THEN rows ELSE 0 END
  FROM (SELECT o.stock, o.nth, o.unit, o.rows, a, b, c, CASE WHEN total * 0.6::DOUBLE - a >= greatest(total * 0.2::DOUBLE - b, total * 0.2::DOUBLE - c) THEN 'development' WHEN total * 0.2::DOUBLE - b >= total * 0.2::DOUBLE - c THEN 'validation' ELSE 'test' END AS split
        FROM r JOIN o ON o.stock = r.stock AND o.nth = r.nth + 1))
SELECT unit, stock, rows, split FROM r WHERE nth > 0""")
def agg_group_splits(spark, d):
    """Documents in splits near 60/20/20 by source, texts that are the same together (AGG-22..24)."""
    u = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("unit")).agg(F.min("source").alias("stock"), F.count("*").alias("rows"))
    return metrics.split_units(u, {"development": 0.6, "validation": 0.2, "test": 0.2})


@QUERIES.add("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_pricing(spark, d):
    """Sums of the largest table, combined before its only shuffle (AGG-36)."""
    price = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))
