"""The tools called from SQL, each over what its search found for many questions at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text, tools
from ..operators import search
from . import records
from .common import Plans, table
from .retrieval import _CORPUS, corpus

QUERIES = Plans()
_SHOWN = "query_id, status, CAST(size(items) AS BIGINT) AS n, array_join(transform(sources, s -> s.source_id), ',') AS shown, array_join(warnings, ' ') AS warnings"


#: What the news tool says of its topics, quoted for SQL.
_TOPICS = f"{V.EXCLUDED.format(['ads'])} {V.INCLUDED.format(['prices'])}".replace("'", "''")


def _call(hits: DataFrame, call: str, shown: str = "") -> DataFrame:
    """A tool's rows over hits, by SQL; `call` names the table as {t}."""
    spark, name = hits.sparkSession, f"hits_{uuid.uuid4().hex}"
    tools.register(spark)
    hits.createOrReplaceTempView(name)
    out = spark.sql(f"SELECT {_SHOWN}{shown} FROM {call.format(t=f'TABLE({name})')}")
    spark.catalog.dropTempView(name)
    return out


def _newest(questions: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Every question with its k newest rows, ranked; with nulls if it has none."""
    w = Window.partitionBy("query_id").orderBy(F.desc("disclosed_at"), F.desc("rcept_no"))
    return questions.join(rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "query_id", "left")


def _filings(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("rcept_no"), F.col("o_orderdate").alias("disclosed_at"), "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("price"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("query_id")), o


def _ranked_orders(where: str, k: int, extra: str = "", none: str = "") -> str:
    """SQL: per customer the newest k orders that a condition fits, as a tool shows them."""
    return f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS rank FROM orders WHERE {where} QUALIFY rank <= {k})
SELECT c_custkey AS query_id, CASE WHEN count(o_orderkey) > 0 THEN 'ok' ELSE 'no_data' END AS status, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rank), '') AS shown, CASE WHEN count(o_orderkey) > 0 THEN '' ELSE '{none}' END AS warnings{extra}
FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY 1"""


@QUERIES.add(_CORPUS + f"""
SELECT query_id, 'ok' AS status, count(*) AS n, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS shown, '{_TOPICS}' AS warnings,
       CAST(sum(CASE WHEN length(t) > 500 THEN 501 ELSE length(t) END) AS BIGINT) AS signs FROM (SELECT query_id, chunk_id, rank, trim(search_text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM sem JOIN ch USING (chunk_id) WHERE rank <= 5) GROUP BY 1""")
def tool_search_news(spark, d):
    """The news tool over every question's nearest chunks; topics are warnings (UDF-10, 11)."""
    q, chunks = corpus(spark, d)
    hits = search.semantic_rank(q, chunks, 5).join(chunks.select("chunk_id", F.col("source").alias("title"), F.col("search_text").alias("snippet")), "chunk_id")
    return _call(hits, "search_news({t}, 5, array('ads'), array('prices'))", ", aggregate(items, 0L, (a, i) -> a + char_length(i.snippet)) AS signs")


@QUERIES.add(_CORPUS + f"""
, m AS (SELECT query_id, chunk_id, ch.doc_id, ch.chunk_order, rank FROM (SELECT query_id, chunk_id, rank FROM sem WHERE rank <= 10) JOIN ch USING (chunk_id) WHERE ch.doc_id % 5 <> 0 AND (query_id % 2 = 0 OR contains(ch.source, 'e'))),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS nth FROM m QUALIFY nth <= 5),
v AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk_order, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT q.query_id, CASE WHEN count(chunk_id) > 0 THEN 'ok' ELSE 'no_data' END AS status, count(chunk_id) AS n, coalesce(string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY nth), '') AS shown, CASE WHEN count(chunk_id) > 0 THEN '{V.FORECASTS}' ELSE '{V.NO_REPORTS}' END AS warnings,
       CAST(coalesce(sum(v.n), 0) AS BIGINT) AS n_values FROM (SELECT query_id FROM q) q LEFT JOIN h ON h.query_id = q.query_id LEFT JOIN v ON v.doc_id = h.doc_id AND v.chunk_order = h.chunk_order GROUP BY 1""")
def tool_research_reports(spark, d):
    """The report tool: nearest chunks of reports read whole, some by broker, with the kinds of values on their pages (LIM-4, UDF-13)."""
    q, chunks = corpus(spark, d)
    at = chunks.select("chunk_id", F.col("doc_id").alias("report_id"), F.col("chunk_order").alias("page_number"), F.col("search_text").alias("snippet"))
    ranked = search.semantic_rank(q, chunks, 10).select("query_id", "chunk_id", "rank").join(at, "chunk_id").withColumn("broker_asked", F.when(F.col("query_id") % 2 != 0, "e"))
    reports = table(spark, d, "documents").select(F.col("doc_id").alias("report_id"), F.concat(F.lit("report "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("broker"), F.when(F.col("doc_id") % 5 != 0, "success").otherwise("partial").alias("parse_status"))
    values = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("page_number"), F.col("l_returnflag").alias("value_kind"))
    hits = q.select("query_id").join(search.report_hits(ranked, reports, values), "query_id", "left")
    return _call(hits, "search_research_reports({t}, 5)", ", aggregate(items, 0L, (a, i) -> a + aggregate(coalesce(map_values(i.table_value_kinds), array()), 0L, (b, x) -> b + x)) AS n_values")


@QUERIES.add(_ranked_orders("o_orderstatus <> 'P'", 5, none=V.NO_FILINGS))
def tool_disclosures(spark, d):
    """The filings tool over every company's newest latest versions (UDF-10, 12)."""
    questions, o = _filings(spark, d)
    rows = o.where("o_orderstatus <> 'P'").select("query_id", "rcept_no", "disclosed_at", F.col("o_orderpriority").alias("title"), F.lit(True).alias("is_latest"))
    return _call(_newest(questions, rows, 5), "search_disclosures({t})")


@QUERIES.add(_ranked_orders("o_orderpriority IN ('1-URGENT', '2-HIGH')", 3, none=V.NO_VALUES))
def tool_disclosure_values(spark, d):
    """The tool of structured values over some kinds of filings (UDF-10, FIL-14)."""
    questions, o = _filings(spark, d)
    rows = o.where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select("query_id", "rcept_no", "disclosed_at", F.col("o_orderpriority").alias("event_type"), F.create_map(F.lit("price"), F.col("price").cast("string")).alias("normalized_data"))
    return _call(_newest(questions, rows, 3), "get_disclosure_values({t}, 3)")


@QUERIES.add(_ranked_orders("o_orderstatus = 'F'", 4, ", CAST(coalesce(sum(CAST(trunc(o_totalprice) AS BIGINT)), 0) AS BIGINT) AS won", V.NO_FACTS))
def tool_financial_facts(spark, d):
    """The facts tool: amounts with their shown form (UDF-10, FIL-15)."""
    questions, o = _filings(spark, d)
    won = F.col("price").cast("long")
    rows = o.where("o_orderstatus = 'F'").select("query_id", "rcept_no", F.col("rcept_no").alias("fact_id"), "disclosed_at", F.col("o_orderpriority").alias("label"), won.alias("value_won"), text.format_won(won).alias("value_display"))
    return _call(_newest(questions, rows, 4), "get_financial_facts({t}, 4)", ", aggregate(items, 0L, (a, i) -> a + i.value_won) AS won")


@QUERIES.add(f"""
WITH x AS ({records.QUERIES["term_lookup"][1]})
SELECT s_suppkey AS query_id, CASE WHEN p_name IS NULL THEN 'no_data' ELSE 'ok' END AS status, CASE WHEN p_name IS NULL THEN 0 ELSE 1 END AS n, coalesce(p_name, '') AS shown, CASE WHEN p_name IS NULL THEN '{V.NO_TERM}' ELSE '' END AS warnings
FROM supplier LEFT JOIN x ON query_id = s_suppkey LEFT JOIN part ON p_partkey = term_id""")
def tool_financial_term(spark, d):
    """The term tool over looked-up terms (UDF-14)."""
    found = records.term_lookup(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"), F.concat_ws(" ", "p_name", "p_type").alias("official_definition")), "term_id")
    hits = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id")).join(found.select("query_id", F.lit(1).alias("rank"), "term", "official_definition"), "query_id", "left")
    return _call(hits, "lookup_financial_term({t}, 1)").withColumn("n", F.col("n").cast("int"))
