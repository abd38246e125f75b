"""Filters, joins, set operations, limits and pages over the star tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import merge, timeseries
from .common import Plans, table

QUERIES = Plans()


@QUERIES.add("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND o_totalprice >= 50000 AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderpriority ILIKE '%h%'""")
def fil_predicates(spark, d):
    """Comparisons, membership, case-blind patterns; all reach the scan or its filter (FIL-1)."""
    o = table(spark, d, "orders")
    return o.where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") >= 50000) & (F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp_ntz")) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.ilike("o_orderpriority", F.lit("%h%"))).select("o_orderkey", "o_custkey", "o_totalprice")


@QUERIES.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'")
def fil_null_or_different(spark, d):
    """Null or not the current value (FIL-2)."""
    return table(spark, d, "orders").where(~F.nullif("o_orderstatus", F.lit("F")).eqNullSafe("O")).select("o_orderkey", "o_orderstatus")


def optional_filters(df, **wanted):
    """Equalities that are given; None filters nothing (FIL-3). Keys may end in __from or __to."""
    tests = {"from": lambda c, v: c >= v, "to": lambda c, v: c <= v, "": lambda c, v: c == v}
    parts = [tests[k.partition("__")[2]](F.col(k.partition("__")[0]), v) for k, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


@QUERIES.add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10 AND l_quantity <= 40")
def fil_optional_parameters(spark, d):
    return optional_filters(table(spark, d, "lineitem"), l_returnflag="R", l_linestatus=None, l_quantity__from=10, l_quantity__to=40).select("l_orderkey", "l_linenumber")


@QUERIES.add("""
SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS kst_day, count(*) AS n FROM events
WHERE ts >= (SELECT min(ts) FROM events) GROUP BY 1""")
def fil_kst_days(spark, d):
    """Calendar days of Seoul (FIL-4..6, SCAL-92)."""
    from ..functions.text import kst_day

    return table(spark, d, "events").groupBy(kst_day("ts").alias("kst_day")).agg(F.count("*").alias("n"))


@QUERIES.add("SELECT doc_id FROM documents WHERE contains(text, 'license') OR contains(text, 'token') OR contains(text, 'Copyright')")
def fil_any_pattern(spark, d):
    """Texts that hold one of several patterns (FIL-8)."""
    from ..functions.text import any_of

    return table(spark, d, "documents").where(any_of(F.col("text"), ("license", "token", "Copyright"))).select("doc_id")


@QUERIES.add("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500) WHERE o_totalprice > 100000""")
def fil_after_limit(spark, d):
    """A filter that stands after the limit stays there (FIL-15, LIM-4)."""
    o = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500)
    return o.where("o_totalprice > 100000").select("o_custkey", "o_orderkey", "o_totalprice")


@QUERIES.add("""
SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P'""")
def join_inner_star(spark, d):
    """Inner equal joins along the star (JOIN-1, 4, 15)."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@QUERIES.add("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def join_distinct_pairs(spark, d):
    """The set of pairs of a filtered join (JOIN-2)."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_partkey", "l_suppkey").distinct()


@QUERIES.add("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def join_anti_recovery(spark, d):
    """Keys that have no result yet (JOIN-3, 19)."""
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@QUERIES.add("""
WITH x AS (SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY o_custkey)
SELECT x.o_custkey, f.o_totalprice AS first_price, l.o_totalprice AS last_price FROM x LEFT JOIN orders f ON f.o_orderkey = x.a LEFT JOIN orders l ON l.o_orderkey = x.b""")
def join_two_aliases(spark, d):
    """One table joined under two names (JOIN-5)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    x = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    f, l = (o.select(F.col("o_orderkey").alias(k), F.col("o_totalprice").alias(p)) for k, p in (("a", "first_price"), ("b", "last_price")))
    return x.join(f, "a", "left").join(l, "b", "left").select("o_custkey", "first_price", "last_price")


@QUERIES.add("""
WITH a AS (SELECT l_suppkey AS k, count(*) AS shipped FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(shipped, 0) AS shipped, s_name FROM a FULL OUTER JOIN b ON a.k = b.k""")
def join_full_outer(spark, d):
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("shipped"))
    b = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), "s_name")
    return a.join(b, "k", "full_outer").select("k", F.coalesce("shipped", F.lit(0)).alias("shipped"), "s_name")


@QUERIES.add("""
WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderkey) OVER w AS supersedes, first_value(o_orderkey) OVER w AS original, lead(o_orderkey) OVER w IS NULL AS is_latest
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, original, supersedes, is_latest, CASE WHEN supersedes IS NULL THEN 'original' ELSE 'corrected' END AS status FROM s""")
def version_chains(spark, d):
    """Each customer's orders as a chain of versions (WIN-5)."""
    return timeseries.version_chain(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "original", "supersedes", "is_latest", "status")


@QUERIES.add("""
WITH s AS (SELECT *, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w IS NULL AS is_latest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT c.o_orderkey, p.o_orderkey AS previous, c.o_totalprice AS price, p.o_totalprice AS previous_price FROM s c LEFT JOIN orders p ON c.supersedes = p.o_orderkey WHERE c.is_latest""")
def correction_pairs(spark, d):
    """The latest version beside the one it supersedes (JOIN-13, FIL-13)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    chain = timeseries.version_chain(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").where("is_latest")
    before = o.select(F.col("o_orderkey").alias("previous"), F.col("o_totalprice").alias("previous_price"))
    return chain.join(before, F.col("supersedes") == F.col("previous"), "left").select("o_orderkey", "previous", F.col("o_totalprice").alias("price"), "previous_price")


@QUERIES.add("""
WITH f AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type FROM events),
o AS (SELECT user_id, day, count(*) AS n, min(event_id) AS original FROM f WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT f.event_id AS correction, o.original FROM f JOIN o USING (user_id, day) WHERE f.event_type = 'error' AND o.n = 1""")
def correction_links(spark, d):
    """Errors linked to the only other event of their user and day (JOIN-11)."""
    e = table(spark, d, "events").select(F.col("event_id").alias("rcept_no"), F.col("user_id").alias("norm_title"), F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("is_correction"))
    return timeseries.link_corrections(e.withColumn("first_day", F.col("day")))


@QUERIES.add("""
WITH c AS (SELECT o_custkey AS k, o_orderdate AS day, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2),
p AS (SELECT o_custkey AS k, o_orderdate AS day, max(o_totalprice) AS close FROM orders GROUP BY 1, 2)
SELECT c.o_orderkey, p.close AS previous_close FROM c ASOF LEFT JOIN p ON c.k = p.k AND c.day > p.day""")
def asof_previous_close(spark, d):
    """The latest value strictly before a day (JOIN-12)."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    left = o.groupBy("k", "day").agg(F.max("o_orderkey").alias("o_orderkey"))
    right = o.groupBy("k", "day").agg(F.max("o_totalprice").alias("close"))
    return timeseries.asof_before(left, right, ["k"], "day", "close", "previous_close").select("o_orderkey", "previous_close")


@QUERIES.add("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem)
SELECT o.o_orderkey, count(l.l_orderkey) AS lines, max(l.l_extendedprice) AS top_price,
       list(l.l_partkey ORDER BY l.l_extendedprice DESC, l.l_linenumber)[1] AS top_part
FROM orders o LEFT JOIN l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def join_nested_children(spark, d):
    """Parents with their children as sorted arrays (JOIN-16, AGG-7)."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("down"), "l_linenumber", "l_partkey"))).alias("x"))
    o = table(spark, d, "orders").select("o_orderkey").join(l, "o_orderkey", "left")
    top = F.get("x", F.lit(0))
    return o.select("o_orderkey", F.when(F.col("x").isNull(), 0).otherwise(F.size("x")).cast("long").alias("lines"), (-top["down"]).alias("top_price"), top["l_partkey"].alias("top_part"))


@QUERIES.add("""
WITH kinds AS (SELECT l_suppkey, map_from_entries(list(struct_pack(k := l_returnflag, v := n) ORDER BY l_returnflag)) AS m FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT s_suppkey, coalesce(m['R'], 0) AS returned, coalesce(m['N'], 0) AS new_lines, cardinality(m) AS kinds FROM supplier LEFT JOIN kinds ON s_suppkey = l_suppkey""")
def join_kind_counts(spark, d):
    """Counts by kind as a map beside their parent (JOIN-8, AGG-8)."""
    k = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    n = lambda x: F.coalesce(F.try_element_at("m", F.lit(x)), F.lit(0))
    return table(spark, d, "supplier").select("s_suppkey").join(k, "s_suppkey", "left").select("s_suppkey", n("R").alias("returned"), n("N").alias("new_lines"), F.when(F.col("m").isNotNull(), F.size("m")).cast("long").alias("kinds"))


@QUERIES.add("""
SELECT user_id, event_type FROM events WHERE event_type = 'purchase' UNION SELECT user_id, event_type FROM events WHERE value > 50""")
def set_union(spark, d):
    """Union of two sources, one row per key, the first source wins (JOIN-20..22)."""
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    return merge.keep_first(e.where("event_type = 'purchase'").withColumn("p", F.lit(0)).unionByName(e.where("value > 50").withColumn("p", F.lit(1))), ["user_id", "event_type"], [F.col("p")]).select("user_id", "event_type")


@QUERIES.add("""
SELECT DISTINCT p_brand, p_size FROM part WHERE p_size > 20 EXCEPT SELECT p_brand, p_size FROM part WHERE p_retailprice > 1200""")
def set_difference(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size > 20").select("p_brand", "p_size").subtract(p.where("p_retailprice > 1200").select("p_brand", "p_size"))


@QUERIES.add("""
SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: w IN ('the', 'and', 'of')))) AS hits
FROM documents WHERE len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: w IN ('the', 'and', 'of'))) > 0""")
def arrays_overlap(spark, d):
    """Two sets of words that meet (JOIN-26)."""
    wanted = F.array(*[F.lit(w) for w in ("the", "and", "of")])
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)
    return table(spark, d, "documents").select("doc_id", words.alias("w")).where(F.arrays_overlap("w", wanted)).select("doc_id", F.array_sort(F.array_intersect("w", wanted)).alias("hits"))


@QUERIES.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def lim_top(spark, d):
    """Limit after an order of several keys (LIM-1, FIL-23)."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@QUERIES.add("""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders), t AS (SELECT count(*) AS total FROM orders)
SELECT o_orderkey, total, 40 + 20 < total AS has_more FROM p, t WHERE r > 40 AND r <= 60""")
def lim_page(spark, d):
    """A page with the exact total (LIM-2, FIL-22)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    total = o.agg(F.count("*").alias("total"))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).join(F.broadcast(total), F.lit(True)).select("o_orderkey", "total", (F.lit(60) < F.col("total")).alias("has_more"))


@QUERIES.add("SELECT event_id, value FROM events WHERE event_id > 300 ORDER BY event_id LIMIT 250")
def lim_keyset(spark, d):
    """The page after a key (LIM-3)."""
    return table(spark, d, "events").where("event_id > 300").orderBy("event_id").limit(250).select("event_id", "value")


@QUERIES.add("""
SELECT * FROM (SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 400) WHERE value < 40 ORDER BY event_id LIMIT 100""")
def lim_prefetch(spark, d):
    """Four times as many, then what is due of them, then the limit (LIM-5)."""
    pre = table(spark, d, "events").orderBy("ts", "event_id").limit(400).where("value < 40")
    return pre.orderBy("event_id").limit(100).select("event_id", "user_id", "value")


@QUERIES.add("""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_id, event_type, value FROM u WHERE r = 1""")
def sink_upsert(spark, d):
    """The state of each user after a merge of older and newer rows (SNK-1, 4..8)."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("arrival"))
    half = F.expr("event_type IN ('error', 'click')")
    return merge.upsert(e.where(half), e.where(~half), ["user_id"], "arrival").drop("arrival")


@QUERIES.add("""
WITH s AS (SELECT doc_id AS source_pk, sha256(text) AS h FROM documents), n AS (SELECT doc_id AS source_pk, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'fr')
SELECT s.source_pk, s.h AS content_hash, 1 AS version, n.h IS NULL OR n.h = s.h AS is_current,
       CASE WHEN n.h IS NULL THEN 'kept' WHEN n.h = s.h THEN 'skipped' ELSE 'deactivated' END AS action FROM s LEFT JOIN n USING (source_pk)
UNION ALL SELECT n.source_pk, n.h, 2, true, 'indexed' FROM n JOIN s USING (source_pk) WHERE n.h <> s.h""")
def sink_versions(spark, d):
    """Documents indexed again: unchanged skipped, changed as a new version (SNK-9, 10, ST-14)."""
    from ..functions.text import content_hash

    docs = table(spark, d, "documents")
    stored = docs.select(F.col("doc_id").alias("source_pk"), content_hash("text").alias("content_hash"), F.lit(True).alias("is_current"), F.lit(1).alias("version"))
    new = docs.where("lang <> 'fr'").select(F.col("doc_id").alias("source_pk"), content_hash(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return merge.version_documents(stored, new).select("source_pk", "content_hash", "version", "is_current", "action")


@QUERIES.add("""
WITH incoming AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <= 2)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM incoming) UNION ALL SELECT * FROM incoming""")
def sink_replace_children(spark, d):
    """All children of a parent replaced (SNK-11, 12, 15, 16)."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return merge.replace_children(l, l.where("l_orderkey % 3 = 0 AND l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") * 2), "l_orderkey")


@QUERIES.add("""
WITH w AS (SELECT DISTINCT user_id, event_type FROM events), h AS (SELECT user_id, event_type, arg_max(CASE WHEN value < 30 THEN 'completed' WHEN value < 60 THEN 'processing' ELSE 'failed' END, event_id) AS status, max(ts) AS claimed FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT w.user_id, w.event_type, NOT coalesce(status = 'completed' OR (status = 'processing' AND claimed > (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE), false) AS taken FROM w LEFT JOIN h USING (user_id, event_type)""")
def sink_claims(spark, d):
    """Keys taken unless they are done or in fresh work (JOIN-18)."""
    e = table(spark, d, "events")
    status = F.when(F.col("value") < 30, "completed").when(F.col("value") < 60, "processing").otherwise("failed")
    claims = e.where("event_type <> 'view'").groupBy("user_id", "event_type").agg(F.max_by(status, "event_id").alias("status"), F.max("ts").alias("claimed_at"))
    now = e.agg(F.max("ts").alias("now"))
    wanted = e.select("user_id", "event_type").join(F.broadcast(now), F.lit(True))
    return merge.claim(claims, wanted, ["user_id", "event_type"], F.col("now")).select("user_id", "event_type", "taken")
