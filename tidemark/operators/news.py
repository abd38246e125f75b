"""News: queues, briefs, sources of clusters, samples and what is written for them."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text
from .merge import keep_first


def issue_briefs(clusters: DataFrame, most: int = 12) -> DataFrame:
    """(stock_code, items, source_hash): first sentences of directional clusters, the best of each direction (WIN-12, UDF-8).

    clusters: (id, stock_code, sentiment, easy_explanation, article_count,
    score, last_active_at). Empty sentences do not count.
    """
    c = clusters.where(F.col("sentiment").isin("positive", "negative")).withColumn("text", text.first_sentence("easy_explanation")).where("text <> ''")
    w = Window.partitionBy("stock_code", "sentiment").orderBy(F.desc("article_count"), F.desc_nulls_last("score"), F.desc_nulls_last("last_active_at"), "id")
    top = c.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    items = F.sort_array(F.collect_list(F.struct("sentiment", "nth", "id", "article_count", "text")))
    return top.groupBy("stock_code").agg(items.alias("items")).withColumn("source_hash", F.sha2(F.to_json("items"), 256))


def event_pairs(links: DataFrame, articles: DataFrame, version: str, since: Column | None = None) -> DataFrame:
    """Pairs that may join a cluster: relevant company events of crawled articles (FIL-19, 21)."""
    keep = (F.col("relevance") == "relevant") & F.col("event_eligible") & (F.col("article_role") == "company_event") & (F.col("role_version") == version)
    j = links.where(keep).join(articles.where("crawl_status = 'success'"), "article_id")
    return j if since is None else j.where(F.col("published_at") >= since)


def to_summarise(clusters: DataFrame, assignments: DataFrame, articles: DataFrame, version: str, each: int = 12) -> DataFrame:
    """Clusters of a version without a summary, each with its first articles by time of assignment (SRC-38, 39, ST-28)."""
    open_ = clusters.where((F.col("clustering_version") == version) & ~F.coalesce(F.col("summary_status") == "success", F.lit(False))).select("cluster_id")
    w = Window.partitionBy("cluster_id").orderBy("assigned_at", "article_id")
    first = assignments.join(open_, "cluster_id").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= each)
    return first.join(articles, "article_id").groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("nth", "article_id", "title"))).alias("articles"))


def dirty_clusters(before: DataFrame, after: DataFrame) -> DataFrame:
    """Clusters whose count differs from before (ST-28, SNK-18)."""
    b = before.select("cluster_id", F.col("article_count").alias("n"))
    return after.join(b, "cluster_id", "left").where(~F.col("article_count").eqNullSafe(F.col("n"))).select("cluster_id")


def source_of(row: Column) -> Column:
    """A cluster's source: the final address, else the original; none without one; names by default (SCAL-91, 57)."""
    url = F.coalesce(text.blank_to_null(row["final_url"]), text.blank_to_null(row["original_url"]))
    return F.when(url.isNotNull(), F.struct(url.alias("url"), F.coalesce(text.blank_to_null(row["title"]), F.lit("(untitled)")).alias("title"), F.coalesce(text.blank_to_null(row["press"]), text.host(url)).alias("press")))


def cluster_sources(members: DataFrame) -> DataFrame:
    """One row per cluster: ids, publishers and addresses in order of time, and distinct publishers (SNK-33, 34, AGG-32).

    members: (cluster_id, article_id, published_at, press, url).
    """
    g = members.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("published_at", "article_id", "press", "url"))).alias("m"))
    of = lambda f: F.transform("m", lambda x: x[f])
    return g.select("cluster_id", of("article_id").alias("article_ids"), F.array_distinct(of("press")).alias("publishers"), of("url").alias("urls"), F.size(F.array_distinct(of("press"))).alias("source_count"))


def label_template(clusters: DataFrame) -> DataFrame:
    """Rows for people to label: arrays joined by bars and an empty label (SNK-35)."""
    return clusters.select("cluster_id", F.array_join(F.transform("article_ids", lambda x: x.cast("string")), "|").alias("article_ids"), F.array_join("publishers", "|").alias("publishers"), F.lit("").alias("label"))


def blind_sample(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without their cluster, key with it), numbered by stock, first time of the cluster, time and id (SNK-36)."""
    first = F.min("published_at").over(Window.partitionBy("stock_code", "cluster_id"))
    ordered = pairs.withColumn("first_at", first)
    w = Window.partitionBy("stock_code").orderBy("first_at", "cluster_id", "published_at", "article_id")
    n = ordered.withColumn("sample_order", F.row_number().over(w))
    return n.drop("cluster_id", "first_at"), n.select("stock_code", "sample_order", "article_id", "cluster_id")


def needle_cluster(members: DataFrame, needle: str) -> DataFrame:
    """Per stock, the cluster with most titles that hold the needle (JOIN-29)."""
    n = members.where(F.col("title").contains(needle)).groupBy("stock_code", "cluster_id").agg(F.count("*").alias("n"))
    return n.groupBy("stock_code").agg(F.max_by("cluster_id", F.struct("n", "cluster_id")).alias("cluster_id"))


#: Sizes of clusters of which samples are taken apart: name and least size.
SIZES = (("20+", 20), ("5-19", 5), ("2-4", 2), ("1", 1))


def seeds(clusters: DataFrame, per_bucket: int, seed: int = 42, largest: int | None = None) -> DataFrame:
    """(cluster_id, bucket, pick): clusters sampled by size, recent and older ones in turn, of the least used stock first (WIN-17, 21).

    clusters: (cluster_id, stock_code, article_count, recent). Of equally used
    stocks the first in a seeded order of clusters counts; where one of the
    two runs out the other goes on; `largest` bounds the biggest size.

    Of each bucket and turn only the first per_bucket clusters of the first
    per_bucket stocks can be picked: with fewer picks than that, one of these
    stocks is always unused. So a bucket's task has 2 * per_bucket**2 rows at
    most, whatever the table has.
    """
    bucket = F.lit(None).cast("string")
    for name, least in reversed(SIZES):
        bucket = F.when(F.col("article_count") >= least, name).otherwise(bucket)
    pool = clusters.select("cluster_id", "stock_code", F.coalesce("recent", F.lit(False)).alias("recent"), bucket.alias("bucket"), F.md5(F.concat_ws(":", F.lit(seed), "cluster_id").cast("binary")).alias("place"), "article_count").where("bucket IS NOT NULL")
    if largest is not None:
        pool = pool.where(F.col("article_count") <= largest)
    turn = ["bucket", "recent"]
    own = pool.withColumn("nth", F.row_number().over(Window.partitionBy(*turn, "stock_code").orderBy("place", "cluster_id"))).where(F.col("nth") <= per_bucket)
    first = own.where("nth = 1").withColumn("of", F.row_number().over(Window.partitionBy(*turn).orderBy("place", "cluster_id"))).where(F.col("of") <= per_bucket)
    left = own.join(first.select(*turn, "stock_code"), [*turn, "stock_code"], "left_semi")
    kind = clusters.schema["cluster_id"].dataType.simpleString()

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        waiting = {k: g.sort_values(["place", "cluster_id"]).to_dict("records") for k, g in rows.groupby("recent")}
        used, picked = Counter(), []
        while len(picked) < per_bucket and any(waiting.values()):
            turn = len(picked) % 2 == 0
            some = waiting.get(turn) or waiting.get(not turn)
            some.sort(key=lambda r: used[r["stock_code"]])  # stable, and the list keeps that order
            picked.append(some.pop(0))
            used[picked[-1]["stock_code"]] += 1
        return pd.DataFrame([(r["cluster_id"], r["bucket"], i + 1) for i, r in enumerate(picked)], columns=["cluster_id", "bucket", "pick"])

    return left.groupBy("bucket").applyInPandas(pick, f"cluster_id {kind}, bucket string, pick int")


def spread(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each group at even places of its order, ends included (WIN-19)."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("n") - 1) / max(1, k - 1)).cast("long"))
    return n.where(F.array_contains(places, F.col("i").cast("long"))).drop("i", "n")


def glossary_differences(contents: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listed but not parsed, parsed but not listed), by terms without blanks, parts at slashes apart (JOIN-25)."""
    norm = F.lower(F.regexp_replace("term", r"\s+", ""))
    a = contents.select(norm.alias("t")).distinct()
    b = parsed.select(F.explode(F.concat(F.array(norm), F.split(norm, "/"))).alias("t")).distinct()
    return a.join(b, "t", "left_anti"), b.join(a, "t", "left_anti")


def _bracket_parts(inner: Column) -> Column:
    """What stands between the marks in a term's brackets; nothing where they hold Korean."""
    s = F.when(F.rlike(inner, F.lit("[가-힣]")), "").otherwise(F.coalesce(inner, F.lit("")))
    return F.filter(F.transform(F.split(s, "[;:]"), lambda x: F.trim(x)), lambda x: x != "")


def abbreviations(inner: Column) -> Column:
    """All abbreviations in a term's brackets, in order (SCAL-65)."""
    return F.filter(_bracket_parts(inner), lambda x: text.is_abbreviation(x))


def english_name(inner: Column) -> Column:
    """(english, abbreviation) of what stands in a term's brackets: the first of each kind (SCAL-65)."""
    full = F.filter(_bracket_parts(inner), lambda x: ~text.is_abbreviation(x))
    return F.struct(F.get(full, F.lit(0)).alias("english"), F.get(abbreviations(inner), F.lit(0)).alias("abbreviation"))


def defined_name(term: Column, definition: Column) -> Column:
    """english_name of the brackets right behind the term, in the first 250 signs of its definition (SCAL-87)."""
    base, head = F.trim(F.substring_index(term, "/", 1)), F.substring(definition, 1, 250)
    rest = F.when(base != "", F.substr(head, F.nullif(F.position(F.concat(base, F.lit("(")), head), F.lit(0)) + F.char_length(base)))
    return english_name(text.blank_to_null(F.regexp_extract(rest, r"^\(([^()]*[A-Za-z][^()]*)\)", 1)))


def glossary_text(term: Column, english: Column, aliases: Column, definition: Column) -> Column:
    """What a glossary search looks in (SCAL-66)."""
    return text.search_text(term, english, F.array_join(aliases, " "), definition)


def repair_cell(cell: Column) -> Column:
    """Numbers that layout cut: commas that gathered behind several numbers go back into them, blanks beside a mark go (SCAL-58, 83)."""
    c = F.trim(F.regexp_replace(cell, r"\s+", " "))
    numbers = F.split(F.trim(F.regexp_extract(c, V.MERGED_NUMBERS, 1)), " ")
    apart = F.array_join(F.transform(numbers, lambda n: F.coalesce(F.format_number(n.try_cast("bigint"), 0), n)), " ")
    c = F.when(F.size(numbers) >= 2, F.concat_ws(" ", apart, text.blank_to_null(F.regexp_extract(c, V.MERGED_NUMBERS, 3)))).otherwise(c)
    return F.regexp_replace(F.regexp_replace(c, r"(\d)\s+([.,%])", "$1$2"), r"([.,])\s+(\d)", "$1$2")


def input_text(kind: str, title: Column, description: Column, body: Column) -> Column:
    """Model inputs: the title, with the description, or with the body (SCAL-76)."""
    parts = {"title": [title], "description": [title, description], "body": [title, description, body]}[kind]
    return F.concat_ws(" ", *[text.blank_to_null(p) for p in parts])


def model_input(c: Column, model: str, prefix: str = "query: ") -> Column:
    """Texts as a model wants them (SCAL-90)."""
    return F.concat(F.lit(prefix), c) if "e5" in model.lower() else c


def prompt(head: Column, items: Column, width: int = 2400) -> Column:
    """A numbered list of titles and bodies under a heading (SCAL-56, 89)."""
    lines = F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["title"], F.lit("\n"), F.substring(x["body"], 1, width)))
    return F.concat_ws("\n", head, F.array_join(lines, "\n"))


def reason(why: Column, candidates: Column) -> Column:
    """Why an article went where it did, with the scores of its candidates (cluster_id, centroid, prototype, signature) (SCAL-88)."""
    scores = F.array_join(F.transform(candidates, lambda c: F.format_string("%s:c%.4f/p%.4f/s%.4f", c["cluster_id"].cast("string"), c["centroid"], c["prototype"], c["signature"])), ",")
    return F.when(F.coalesce(F.size(candidates), F.lit(0)) > 0, F.concat(why, F.lit(" | candidates="), scores)).otherwise(why)


def evidence(payloads: DataFrame) -> DataFrame:
    """(run, source_ids, amounts): what tools returned in a run (SCAL-52).

    payloads: (run, sources array<string>, amounts array<bigint>).
    """
    return payloads.groupBy("run").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("source_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("amounts")))).alias("amounts"))


def page_offset(pages: DataFrame) -> DataFrame:
    """(path, offset): the most frequent difference of place and printed number, with two votes or more (SCAL-63)."""
    v = pages.groupBy("path", (F.col("pos") - F.col("printed")).alias("offset")).agg(F.count("*").alias("n")).where("n >= 2")
    return v.groupBy("path").agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("offset"))


def prototypes(clusters: DataFrame) -> DataFrame:
    """(cluster_id, text) of anchors and representatives, once each (ST-30)."""
    return clusters.select("cluster_id", F.explode(F.array("anchor_title", "rep_title")).alias("text")).where(F.col("text").isNotNull()).dropDuplicates(["cluster_id", "text"])


def embedding_cost(chunks: DataFrame, column: str, chars_per_token: float = 1.5, price: float = 0.1) -> DataFrame:
    """Estimated tokens and dollars of embedding a column (AGG-41)."""
    tokens = F.sum(F.char_length(column)) / chars_per_token
    return chunks.agg(F.ceil(tokens).alias("tokens"), F.round(tokens / 1e6 * price, 6).alias("dollars"))


def best_parameters(results: DataFrame, keys: list[str], score: str) -> DataFrame:
    """A sweep's rows, equal parameters once, the best score first (AGG-40, SNK-29)."""
    return keep_first(results, keys, [F.desc(score)]).orderBy(F.desc(score), *keys)


def write_splits(rows: DataFrame, folder: str) -> None:
    """Rows as CSV in a folder per split, and a manifest of their units (SNK-28, 29)."""
    rows.write.partitionBy("split").option("header", True).csv(f"{folder}/rows")
    rows.groupBy("split", "unit").agg(F.count("*").alias("rows")).write.option("header", True).csv(f"{folder}/manifest")


def log_failures(rows: DataFrame, folder: str) -> None:
    """Failures appended as JSON lines (SNK-27, 37)."""
    rows.write.mode("append").json(folder)
