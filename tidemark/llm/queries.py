"""Thin queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embedding_dedup, language_id, line_dedup, lm_scoring, mixing, periodic_runs, quality, secret_scan, sentencepieces, simhash, token_files, topk_search
from .common import WORD, whole_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs).select("doc_id", "secrets")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    return quality.score_quality(docs, quality.fit(docs, labels)).select("doc_id", held, "score", "predicted")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = simhash.near_duplicates(docs, carry=["doc_id"])
    return got.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read_token_files(spark, folder)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = sentencepieces.sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    each = got.select("doc_id", F.posexplode("segmentations").alias("nth", "s"))
    return each.select("doc_id", (F.col("nth") + 1).alias("nth"), *[F.col("s")[c].alias(c) for c in ("n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "round_trip")])


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"))


def with_repeats(text, doc_id):
    """The text of every document with crc32(doc_id) % 10 = 0 with its words from a on repeating at a distance of p, as the contract plants them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    return F.when(h % 10 == 0, F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), planted), 0)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_repeats(whole_text(), F.col("doc_id")).alias("text"))
    found = periodic_runs.collapse_runs(docs, into="text")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    # Greatest length / period without division: a * d against c * b; the first of equal ones stays, runs come by start and period.
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    top = F.aggregate("runs", F.get("runs", 0), better)
    got = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words")
    return got.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.fit(docs.where(~held))
    got = language_id.predict_language(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model)
    return got.select("doc_id", "held_out", "lang_pred", "score", "margin_bits", "rejected")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_secret_scans, op3_lm_scoring, op4_sentencepiece_sampling, op5_mix_sources, op6_quality_classifier, op7_simhash_near_dedup, op8_token_files, op9_embedding_near_dedup, op10_exact_top_k, op11_periodic_runs, op12_language_id, op13_source_divergence)}


ORACLE = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM e),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op10_exact_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
    "op11_periodic_runs": r"""
WITH c AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h
      FROM documents, c),
n AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 AS nth, h // 10 AS g FROM d),
m AS (SELECT doc_id, n, CASE WHEN nth = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE w END AS w FROM n),
e AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM m),
q AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND (b.i - a.i) * 4 <= a.n),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM q),
r AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM u GROUP BY doc_id),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = e.doc_id AND e.i >= u.start + u.period AND e.i < u.start + u.length) GROUP BY e.doc_id)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, m.n AS n_words
FROM m LEFT JOIN l USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS kinds FROM k GROUP BY lang),
g AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c ON s.lang = c.lang AND s.source = c.source GROUP BY s.lang, s.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.kinds) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.kinds) AS q
      FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
v AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
w AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM w QUALIFY part = 'pair' OR rank <= 10""",
    "op9_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v WHERE list_dot_product(v, v) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op5_mix_sources": r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
w AS (SELECT *, CASE WHEN length(t) = 0 THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * CAST(length(t) - length(regexp_replace(t, '[!#$%&*|<>{}\[\]\\^~=@_+]', '', 'g')) AS DOUBLE) / CAST(length(t) AS DOUBLE)) END AS q FROM d),
k AS (SELECT *, pow(u, 1.0::DOUBLE / q) AS key FROM w),
s AS (SELECT src, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY src),
r AS (SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_weight FROM s),
l AS (SELECT *, (total - coalesce(sum(most) OVER b, 0)) / (all_weight - coalesce(sum(weight) OVER b, 0)) AS level, row_number() OVER (ORDER BY ratio, src) AS nth FROM r
      WINDOW b AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, (SELECT min(nth) FROM l WHERE level <= ratio) AS cut, (SELECT arg_min(level, nth) FROM l WHERE level <= ratio) AS line FROM l),
g AS (SELECT src, source_size, CASE WHEN line IS NULL OR nth < cut THEN most ELSE weight * line END AS target FROM n),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
o AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
             coalesce(sum(k.size) OVER (PARTITION BY k.src ORDER BY k.key DESC, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM k JOIN p USING (src))
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN budget > 0 AND (budget - upto) * 2 > size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
