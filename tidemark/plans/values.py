"""Values of single fields: cleaning, parsing, rules and formats over the driver tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import models, text, vectors
from ..operators import news
from .common import Plans, table

QUERIES = Plans()


def _sub(c: str, *pairs: tuple[str, str]) -> str:
    """SQL: regular replacements of all matches, one after another."""
    for old, new in pairs:
        c = f"regexp_replace({c}, '{old}', '{new}', 'g')"
    return c


def _signs(c: str) -> str:
    """SQL: the stored entities as signs, the ampersand last."""
    for entity, sign in [*list(V.ENTITIES.items())[1:], ("&amp;", "&")]:
        c = f"replace({c}, '{entity}', '{"''" if sign == "'" else sign}')"
    return c


# White space of Java's patterns, which RE2's \s lacks a sign of.
_WS = "[ \\t\\n\\x0B\\f\\r]+"


@QUERIES.add(f"""
WITH a AS (SELECT page_id, {_sub(_sub("html", ("(?s)<\\?.*?\\?>|<!--.*?-->", "")), ("(?i)</(p|tr|div|li|table|title|section-\\d)>|<br[ \\t\\n\\x0B\\f\\r]*/?>", chr(10)), ("(?s)<[^>]+>", " "))} AS t FROM pages),
b AS (SELECT page_id, trim({_sub(_sub(_signs("t"), ("[ \\t\\x{00A0}]+", " ")), (" *\\n *", chr(10)), ("\\n{3,}", chr(10) * 2))}, ' ' || chr(10)) AS t FROM a)
SELECT page_id, sha256(t) AS body_hash, length(t) AS n FROM b""")
def text_markup(spark, d):
    """Markup as text: comments go, block ends become line feeds (SCAL-21)."""
    return table(spark, d, "pages").select("page_id", text.markup_to_text("html").alias("t")).select("page_id", F.sha2("t", 256).alias("body_hash"), F.char_length("t").cast("long").alias("n"))


@QUERIES.add(f"""
WITH a AS (SELECT page_id, trim({_sub(_signs(_sub("html", ("(?s)<[^>]*>", " "))), (_WS, " "))}) AS t FROM pages)
SELECT page_id, sha256(t) AS text_hash, length(t) AS n FROM a""")
def text_stripped(spark, d):
    """Pages without tags on one line (SCAL-2)."""
    return table(spark, d, "pages").select("page_id", text.strip_tags("html").alias("t")).select("page_id", F.sha2("t", 256).alias("text_hash"), F.char_length("t").cast("long").alias("n"))


@QUERIES.add(f"""
WITH a AS (SELECT doc_id, trim({_sub("replace(text, chr(160), ' ')", ("[ \\t]+", " "), ("\\n{3,}", chr(10) * 2))}, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)
SELECT doc_id, sha256(t) AS text_hash, length(t) AS n FROM a""")
def text_compact(spark, d):
    """White space made compact, paragraphs kept (SCAL-4)."""
    return table(spark, d, "documents").select("doc_id", text.compact_whitespace("text").alias("t")).select("doc_id", F.sha2("t", 256).alias("text_hash"), F.char_length("t").cast("long").alias("n"))


#: A line behind the text, by the document's number: each rule decides some rows, and near misses stay.
_TAILS = ["무단 전재 및 재배포 금지", "저작권자(c) 금지", "아무개 기자 (a@b.kr)", "제보는 카카오톡 어디", "댓글", "무단 전재", "댓글 3개", ""]
_TAILED = "text || chr(10) || CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAILS)) + " END"
_NO_BODY = " OR ".join(f"regexp_matches(x, '{p}')" for p in V.BOILERPLATE)


@QUERIES.add(f"""
WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS raw FROM (SELECT doc_id, string_split({_TAILED}, chr(10)) AS p FROM documents)),
c AS (SELECT doc_id, i, trim(regexp_replace(raw, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS x FROM l),
k AS (SELECT doc_id, x, min(i) AS i FROM c WHERE length(x) >= 2 AND NOT ({_NO_BODY}) GROUP BY 1, 2),
j AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM k GROUP BY 1)
SELECT d.doc_id, sha256(coalesce(t, '')) AS body_hash FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN j ON d.doc_id = j.doc_id""")
def text_clean_bodies(spark, d):
    """Bodies without boilerplate, every line once, where it first stood (SCAL-37)."""
    tailed = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.expr(_TAILED.replace("chr(10)", "'\\n'")).alias("text"))
    return tailed.select("doc_id", F.sha2(text.clean_body("text"), 256).alias("body_hash"))


_OPENED = f"CASE doc_id % 5 WHEN 0 THEN '{V.BRIEF_OPENINGS[0]} ' WHEN 1 THEN '**{V.BRIEF_OPENINGS[2]}' ELSE '' END || text"


def _first(c: str) -> str:
    """SQL: up to and with the first of the marks that occurs, in their order."""
    return "CASE " + " ".join(f"WHEN instr({c}, '{m} ') > 0 THEN trim(string_split({c}, '{m} ')[1]) || '{m}'" for m in ".!?") + f" ELSE {c} END"


@QUERIES.add(f"""
WITH a AS (SELECT doc_id, text, trim({_sub("replace(" + _OPENED + ", '**', '')", (_WS, " "))}) AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, text, CASE WHEN starts_with(t, '{V.BRIEF_OPENINGS[0]}') THEN trim(substr(t, {len(V.BRIEF_OPENINGS[0]) + 1})) WHEN starts_with(t, '{V.BRIEF_OPENINGS[2]}') THEN trim(substr(t, {len(V.BRIEF_OPENINGS[2]) + 1})) ELSE t END AS t FROM a),
s AS (SELECT doc_id, t, list_filter(string_split({_sub("trim(text)", ("([.!?])" + _WS, chr(92) + "1" + chr(1)))}, chr(1)), lambda x: x <> '') AS parts FROM b)
SELECT doc_id, sha256({_first("t")}) AS first_hash, sha256(array_to_string(parts[1:2], ' ')) AS two_hash FROM s""")
def text_first_sentences(spark, d):
    """The first sentence without its opening, and the first two (SCAL-18, 79)."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.sha2(text.first_sentence(F.expr(_OPENED)), 256).alias("first_hash"), F.sha2(text.first_sentences("text"), 256).alias("two_hash"))


_HEADED = "CASE doc_id % 7 WHEN 0 THEN '[사설] ' WHEN 1 THEN '월요 광장 ' WHEN 2 THEN '기자 수첩: ' WHEN 3 THEN '광장에서 ' ELSE '' END || coalesce(text, '')"


@QUERIES.add(f"SELECT doc_id, regexp_matches({_HEADED}, '{V.OPINION}') AS opinion FROM documents")
def opinion_titles(spark, d):
    """Opinion pieces by what their titles show (FIL-18)."""
    return table(spark, d, "documents").select("doc_id", text.is_opinion(F.expr(_HEADED)).alias("opinion"))


@QUERIES.add("""
SELECT event_id, date_trunc('second', ts) AS published_at, CAST(NULL AS TIMESTAMP) AS bad FROM events""")
def rfc_dates(spark, d):
    """Dates as mail headers write them, in three zones, and what is none (SCAL-3)."""
    zone = F.element_at(F.array(F.lit(0), F.lit(9), F.lit(-5)), (F.col("event_id") % 3 + 1).cast("int"))
    sign = F.element_at(F.array(F.lit("+0000"), F.lit("+0900"), F.lit("-0500")), (F.col("event_id") % 3 + 1).cast("int"))
    local = F.col("ts").cast("timestamp") + F.make_dt_interval(hours=zone)
    written = F.concat(F.date_format(local, "EEE, d MMM yyyy HH:mm:ss "), sign)
    return table(spark, d, "events").select("event_id", text.rfc2822(written).cast("timestamp_ntz").alias("published_at"), text.rfc2822(F.col("event_type")).cast("timestamp_ntz").alias("bad"))


@QUERIES.add("""
SELECT o_orderkey, concat_ws(' / ', '주요사항 (' || o_orderkey || ')', concat_ws(', ', CASE WHEN o_orderkey % 4 > 1 THEN '상태: ' || o_orderstatus END, '순위: ' || CASE WHEN o_orderkey % 3 = 0 THEN '해당없음' ELSE o_orderpriority END)) AS summary,
  o_orderkey % 4 > 1 OR o_orderkey % 3 > 0 AS business FROM orders""")
def summary_texts(spark, d):
    """One line of a filing's fields, without those of its head and the empty ones (SCAL-23, FIL-11)."""
    status, rank = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN '' ELSE o_orderstatus END"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '해당없음' ELSE ' ' || o_orderpriority END")
    fields = F.create_map(F.lit("corp_code"), F.col("o_custkey").cast("string"), F.lit("상태"), status, F.lit("순위"), rank)
    head = F.concat(F.lit("주요사항 ("), F.col("o_orderkey").cast("string"), F.lit(")"))
    return table(spark, d, "orders").select("o_orderkey", text.summary_text(head, fields).alias("summary"), text.has_business_content(fields).alias("business"))


def _parts_of(c: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^0-9a-z가-힣]+'), lambda x: x <> '')"


def _similar(a: str, b: str) -> str:
    """SQL: equal, held, or shared words."""
    x, y, p, q = f"array_to_string({_parts_of(a)}, ' ')", f"array_to_string({_parts_of(b)}, ' ')", f"list_distinct({_parts_of(a)})", f"list_distinct({_parts_of(b)})"
    shared = f"len(list_intersect({p}, {q}))"
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0 WHEN {x} = {y} THEN 1.0 WHEN least(length({x}), length({y})) >= 4 AND (contains({x}, {y}) OR contains({y}, {x})) THEN 0.9 ELSE {shared} / greatest(1, len({p}) + len({q}) - {shared}) END"


@QUERIES.add(f"""
WITH p AS (SELECT a.p_partkey, a.p_name AS n1, b.p_name AS n2, a.p_type AS t1, b.p_type AS t2, CASE WHEN a.p_partkey % 3 > 0 THEN a.p_name || ' ' || a.p_type END AS u1, b.p_name AS u2 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
s AS (SELECT p_partkey, u1 IS NOT NULL AS has_u, CAST({_similar("n1", "n2")} AS DOUBLE) AS a, CAST({_similar("t1", "t2")} AS DOUBLE) AS b, CAST({_similar("u1", "u2")} AS DOUBLE) AS c FROM p)
SELECT p_partkey, round(a, 6) AS name_similarity, round((a * 0.30 + b * 0.35 + CASE WHEN has_u THEN c * 0.35 ELSE 0 END) / (0.65 + CASE WHEN has_u THEN 0.35 ELSE 0 END), 6) AS similarity,
  CAST(a >= 0.5 AS INTEGER) + CAST(b >= 0.5 AS INTEGER) + CAST(has_u AND c >= 0.5 AS INTEGER) AS hits FROM s""")
def signature_scores(spark, d):
    """How alike two events' signatures are, field by field (SCAL-43, 80)."""
    a = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("n1"), F.col("p_type").alias("t1"), F.expr("CASE WHEN p_partkey % 3 > 0 THEN p_name || ' ' || p_type END").alias("u1"))
    b = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n2"), F.col("p_type").alias("t2"))
    similarity, hits = text.signature_similarity({"core_subjects": "n1", "core_topic": "t1", "unique_anchors": "u1"}, {"core_subjects": "n2", "core_topic": "t2", "unique_anchors": "n2"})
    return a.join(b, "p_partkey").select("p_partkey", F.round(text.value_similarity("n1", "n2"), 6).alias("name_similarity"), F.round(similarity, 6).alias("similarity"), hits.alias("hits"))


_SIGNED = """CASE p_partkey % 4
  WHEN 0 THEN '{"core_subjects":["' || p_name || '"," "],"core_topic":" ' || p_type || ' ","story_relation":"follow_up"}'
  WHEN 1 THEN '{"core_subjects":"' || p_brand || '","unique_anchors":["x","' || p_name || '"],"story_relation":"other"}'
  WHEN 2 THEN '{"subject":"' || p_brand || '","action":"' || p_type || '","object":"' || p_name || '","amount":["9"],"identifiers":["9","' || p_name || '"]}'
  ELSE 'none' END"""


@QUERIES.add("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_brand ELSE '' END AS subjects,
  CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 2 THEN p_type || ' ' || p_name END AS topic,
  CASE p_partkey % 4 WHEN 1 THEN 'x|' || p_name WHEN 2 THEN '9|' || p_name ELSE '' END AS anchors,
  CASE p_partkey % 4 WHEN 0 THEN 'follow_up' ELSE 'unknown' END AS relation FROM part""")
def event_signatures(spark, d):
    """Signatures of the present and the older form as one (SCAL-42)."""
    s = table(spark, d, "part").select("p_partkey", text.event_signature(F.expr(_SIGNED)).alias("s"))
    return s.select("p_partkey", F.array_join("s.core_subjects", "|").alias("subjects"), F.col("s.core_topic").alias("topic"), F.array_join("s.unique_anchors", "|").alias("anchors"), F.col("s.story_relation").alias("relation"))


@QUERIES.add("""
WITH p AS (SELECT p_partkey, replace(p_type, ' ', '') AS w FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN w || '이란|' || w || '이|' || w ELSE w || CASE p_partkey % 3 WHEN 1 THEN '는|' || w ELSE '' END END AS forms FROM p
WHERE p_partkey % 3 > 0
UNION ALL SELECT p_partkey, w || '이란|' || w || '이|' || w FROM p WHERE p_partkey % 3 = 0""")
def term_forms(spark, d):
    """The term a question asks for and its forms without particles (SCAL-49)."""
    asked = F.expr("replace(p_type, ' ', '') || CASE p_partkey % 3 WHEN 0 THEN '이란 뭐야?' WHEN 1 THEN '는?' ELSE ' 뜻' END")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.term_candidates(asked), "|").alias("forms"))


@QUERIES.add("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://www.Example.org/' || page_id END AS url, CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE '(untitled)' END AS title,
  CASE WHEN page_id % 5 = 0 THEN 'The Press' WHEN page_id % 3 = 0 THEN regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') ELSE 'example.org' END AS press
FROM pages WHERE page_id % 7 > 0""")
def cited_sources(spark, d):
    """An article as a source: the final address before the original, none without either (SCAL-91)."""
    row = F.struct(F.expr("CASE WHEN page_id % 7 > 0 AND page_id % 3 = 0 THEN url ELSE ' ' END").alias("final_url"), F.expr("CASE WHEN page_id % 7 > 0 THEN 'https://www.Example.org/' || page_id END").alias("original_url"), F.expr("CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id END").alias("title"), F.expr("CASE WHEN page_id % 5 = 0 THEN 'The Press' END").alias("press"))
    return table(spark, d, "pages").select("page_id", news.source_of(row).alias("s")).where("s IS NOT NULL").select("page_id", "s.url", "s.title", "s.press")


@QUERIES.add("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN format('{:,}', o_custkey) || ' ' || format('{:,}', o_orderkey) || ' total' WHEN 1 THEN o_custkey || ',' || '333.5' WHEN 2 THEN o_custkey || '%' ELSE o_orderpriority END AS cell FROM orders""")
def repaired_cells(spark, d):
    """Table cells whose numbers layout cut or merged (SCAL-58, 83)."""
    cut = F.expr("CASE o_orderkey % 4 WHEN 0 THEN o_custkey || '  ' || o_orderkey || ' , , total' WHEN 1 THEN o_custkey || ' , 333 . 5' WHEN 2 THEN o_custkey || ' %' ELSE ' ' || o_orderpriority END")
    return table(spark, d, "orders").select("o_orderkey", news.repair_cell(cut).alias("cell"))


@QUERIES.add("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'actual|estimate' WHEN 1 THEN 'actual|unknown' WHEN 2 THEN 'forecast|guidance' WHEN 3 THEN 'estimate|unknown' ELSE 'unknown|unknown' END AS kinds,
  CASE o_orderkey % 5 WHEN 0 THEN 'mixed' WHEN 1 THEN 'actual' WHEN 4 THEN 'unknown' ELSE 'forecast' END AS kind,
  o_orderkey % 3 > 0 AS narrative, CASE o_orderkey % 3 WHEN 0 THEN '억원|%' WHEN 1 THEN '백만원|배|원' ELSE '' END AS units FROM orders""")
def table_kinds(spark, d):
    """What a report's table shows: past or expected values, numbers or text, and its units (SCAL-59..62)."""
    year = F.date_format("o_orderdate", "yyyy")
    century = F.concat(F.lit("20"), F.substring(year, 3, 2))
    head = F.expr("o_orderkey % 5")
    first = F.when(head <= 1, F.concat(century, F.lit("A"))).when(head == 2, F.concat(F.lit("1Q"), century, F.lit(". F"))).when(head == 3, F.concat(century, F.lit("P"))).otherwise(F.concat(century, F.lit("Average")))
    second = F.when(head == 0, F.concat(century, F.lit(" E"))).when(head == 2, "Guidance").otherwise(century)
    kinds = text.column_kinds(F.array(first, second))
    cells = F.expr("CASE o_orderkey % 3 WHEN 0 THEN array(array(cast(o_custkey AS string), o_orderstatus), array('', o_orderpriority)) WHEN 1 THEN array(array(o_orderstatus), array('')) ELSE array(array(repeat(o_orderstatus, 121), '1', '2')) END")
    flat = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '매출 억원, 이익 억원, 비율 %' WHEN 1 THEN '백만원 배 원 백만원' ELSE o_orderpriority END")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(kinds, "|").alias("kinds"), text.table_kind(kinds).alias("kind"), text.narrative_table(cells).alias("narrative"), F.array_join(text.units(flat), "|").alias("units"))


@QUERIES.add("""
WITH p AS (SELECT p_partkey, p_name, upper(replace(p_name, ' ', '')) AS short FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name END AS english, CASE p_partkey % 4 WHEN 0 THEN short WHEN 2 THEN short || '|ABC' ELSE '' END AS abbreviations,
  CASE WHEN p_partkey % 4 = 0 THEN p_name END AS defined FROM p""")
def glossary_names(spark, d):
    """English names and abbreviations in a term's brackets or its definition (SCAL-65, 86, 87)."""
    short = "upper(replace(p_name, ' ', ''))"
    inner = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN {short} || '; ' || p_name WHEN 1 THEN p_name WHEN 2 THEN {short} || ': ABC' ELSE '용어 ' || p_name END")
    definition = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN '뜻: 용어(' || p_name || ')는' WHEN 1 THEN '용어 (' || p_name || ')' WHEN 2 THEN '용어(한글)' ELSE repeat('가', 250) || '용어(' || p_name || ')' END")
    return table(spark, d, "part").select("p_partkey", news.english_name(inner)["english"].alias("english"), F.array_join(news.abbreviations(inner), "|").alias("abbreviations"), news.defined_name(F.lit("용어/다른 용어"), definition)["english"].alias("defined"))


@QUERIES.add(f"""SELECT doc_id, sha256({_sub("text", (_WS, ""))}) AS title_hash FROM documents WHERE text IS NOT NULL AND NOT starts_with(text, '[')""")
def normal_titles(spark, d):
    """Titles without marks before them and without white space (SCAL-68)."""
    marked = F.concat(F.expr("CASE doc_id % 3 WHEN 0 THEN '[정정] [첨부 추가]  ' WHEN 1 THEN '[기재정정]' ELSE '' END"), "text")
    return table(spark, d, "documents").where("text IS NOT NULL AND NOT startswith(text, '[')").select("doc_id", F.sha2(text.normal_title(marked), 256).alias("title_hash"))


@QUERIES.add("SELECT event_id, round(epoch_us(ts) / 3.6e9, 6) AS hours FROM events")
def event_hours(spark, d):
    """Hours since the epoch (SCAL-72)."""
    return table(spark, d, "events").select("event_id", F.round(vectors.hours("ts"), 6).alias("hours"))


@QUERIES.add("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 9)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e)
SELECT a.vec_id, round(a.v[1] / CASE WHEN a.size = 0 THEN 1 ELSE a.size END, 6) + 0.0 AS first_component, CASE WHEN a.size * b.size = 0 THEN 0.0 ELSE round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (a.size * b.size), 6) END AS next_cosine
FROM n a JOIN n b ON b.vec_id = a.vec_id + 1""")
def unit_vectors(spark, d):
    """Vectors of length one, and the cosine of neighbours; a zero vector stays one (SCAL-73, 74)."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 9)).alias("v"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(F.get(vectors.unit("v"), F.lit(0)), 6).alias("first_component"), F.round(vectors.cosine("v", "w"), 6).alias("next_cosine"))


@QUERIES.add("""
SELECT event_id, event_id % 5 > 0 AND event_id % 3 = 0 AND event_id % 2 = 0 AND event_id % 7 > 0 AS current FROM events""")
def current_results(spark, d):
    """Stored results that still stand: label, model, version and input as wanted (SCAL-82, ST-29)."""
    label, model = F.expr("CASE WHEN event_id % 5 > 0 THEN event_type END"), F.expr("CASE event_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'old' END")
    version, stored = F.expr("CASE WHEN event_id % 2 = 0 THEN 'v2' END"), F.when(F.expr("event_id % 7 > 0"), F.sha2("props", 256))
    return table(spark, d, "events").select("event_id", models.is_current(label, model, version, stored, "m", "v2", F.sha2("props", 256)).alias("current"))


@QUERIES.add("""
SELECT event_id, event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' | candidates=' || user_id || printf(':c%.4f/p%.4f/s%.4f', value, value / 2, 0.0) || CASE WHEN event_id % 3 = 2 THEN ',' || event_id || printf(':c%.4f/p%.4f/s%.4f', 0.25, 1.0, value) ELSE '' END END AS reason FROM events""")
def assignment_reasons(spark, d):
    """Why an article joined its cluster, with the candidates' scores (SCAL-88)."""
    one = lambda i, *x: F.struct(F.col(i).alias("cluster_id"), *[c.cast("double").alias(n) for n, c in zip(("centroid", "prototype", "signature"), x)])
    both = F.array(one("user_id", F.col("value"), F.col("value") / 2, F.lit(0.0)), one("event_id", F.lit(0.25), F.lit(1.0), F.col("value")))
    return table(spark, d, "events").select("event_id", news.reason(F.col("event_type"), F.slice(both, 1, F.pmod("event_id", F.lit(3)).cast("int"))).alias("reason"))


@QUERIES.add("""
WITH m AS (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-12 00:00:00') // 1000000 - floor(epoch_us(ts) / 1000000)) / 60) AS BIGINT) AS m FROM events)
SELECT event_id, CASE WHEN m < 60 THEN greatest(m, 0) || ' min' WHEN m < 1440 THEN m // 60 || ' h' ELSE m // 1440 || ' d' END AS shown FROM m""")
def relative_times(spark, d):
    """How long ago, in minutes, hours or days (SCAL-93)."""
    return table(spark, d, "events").select("event_id", text.relative_time("ts", F.expr("TIMESTAMP '2024-01-12 00:00:00'")).alias("shown"))


@QUERIES.add("""
WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' ELSE 'unknown' END AS l, CASE WHEN event_id % 9 > 0 THEN least(1.0, value / 100) END AS s FROM events)
SELECT event_id, CASE WHEN l = 'unknown' THEN NULL WHEN l <> 'neutral' AND coalesce(s, 0) < 0.65 THEN 'neutral' ELSE l END AS label, CASE WHEN l = 'unknown' OR (l <> 'neutral' AND coalesce(s, 0) < 0.65) THEN NULL ELSE s END AS score,
  CASE WHEN l IN ('positive', 'negative') AND coalesce(s, 0) < 0.65 THEN 'low_confidence' END AS reason FROM s""")
def shown_sentiments(spark, d):
    """Sentiment as shown: an unsure direction is neutral, the unknown nothing (FIL-24)."""
    label, score = F.expr("CASE event_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' ELSE 'unknown' END"), F.expr("CASE WHEN event_id % 9 > 0 THEN least(1.0D, value / 100) END")
    return table(spark, d, "events").select("event_id", models.shown_sentiment(label, score).alias("s")).select("event_id", "s.label", "s.score", "s.reason")
