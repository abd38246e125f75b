"""Clustering, retrieval and evaluation metrics in closed form."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import CHUNK_BLOCK, in_blocks


def contingency(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, pred, gold, n, n_pred, n_gold, total) from one row per item (by, pred, gold)."""
    n = pairs.groupBy(*by, "pred", "gold").agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*by, *c))
    return n.select("*", over("pred").alias("n_pred"), over("gold").alias("n_gold"), over().alias("total"))


def clustering_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """B-cubed, pairwise, over- and under-merge, ARI and NMI (AGG-12..16), per `by`.

    All come from the contingency table: items are grouped once and no pair of
    items is ever made.
    """
    by = by or []
    t = contingency(pairs, by)
    two = lambda c: c * (c - 1) / 2
    n, a, b, total = (F.col(x).cast("double") for x in ("n", "n_pred", "n_gold", "total"))
    p_row = F.sum(F.when(F.col("first_pred"), two(a)).otherwise(0.0))
    g_row = F.sum(F.when(F.col("first_gold"), two(b)).otherwise(0.0))
    ent = lambda flag, c: -F.sum(F.when(F.col(flag), c / total * F.log(c / total)).otherwise(0.0))
    rank = lambda c, o: F.row_number().over(Window.partitionBy(*by, c).orderBy(o)) == 1
    t = t.withColumn("first_pred", rank("pred", "gold")).withColumn("first_gold", rank("gold", "pred"))
    s = t.groupBy(*by).agg(
        F.max("total").alias("items"), (F.sum(n * n / a) / F.max(total)).alias("bcubed_precision"), (F.sum(n * n / b) / F.max(total)).alias("bcubed_recall"),
        F.sum(two(n)).alias("tp"), p_row.alias("same_pred"), g_row.alias("same_gold"), F.max(two(total)).alias("all_pairs"),
        F.sum(n / total * F.log(n * total / (a * b))).alias("mi"), ent("first_pred", a).alias("h_pred"), ent("first_gold", b).alias("h_gold"),
    )
    ratio = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    f1 = lambda p, r: ratio(2 * p * r, p + r)
    c = F.col
    pp, pr = ratio(c("tp"), c("same_pred")), ratio(c("tp"), c("same_gold"))
    expected = c("same_pred") * c("same_gold") / c("all_pairs")
    half = (c("same_pred") + c("same_gold")) / 2
    return s.select(
        *by, "items", "bcubed_precision", "bcubed_recall", f1(c("bcubed_precision"), c("bcubed_recall")).alias("bcubed_f1"),
        pp.alias("pairwise_precision"), pr.alias("pairwise_recall"), f1(pp, pr).alias("pairwise_f1"),
        ratio(c("same_pred") - c("tp"), c("all_pairs") - c("same_gold")).alias("over_merge_rate"), ratio(c("same_gold") - c("tp"), c("same_gold")).alias("under_merge_rate"),
        F.when((half == expected) | (c("all_pairs") == 0), 1.0).otherwise((c("tp") - expected) / (half - expected)).alias("ari"),
        F.when((c("h_pred") + c("h_gold")) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), c("mi")) / ((c("h_pred") + c("h_gold")) / 2)).alias("nmi"),
    )


def scores_by_stock(pred: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per stock, macro mean); fails when an item of the gold has no prediction (AGG-17)."""
    joined = gold.join(pred, "item", "left").withColumn("pred", F.when(F.col("pred").isNull(), F.raise_error(F.concat(F.lit("no prediction for item "), F.col("item").cast("string"))).cast(pred.schema["pred"].dataType)).otherwise(F.col("pred")))
    per = clustering_scores(joined.select("stock", "pred", "gold"), ["stock"])
    names = [x for x in per.columns if x not in ("stock", "items")]
    return per, per.agg(*[F.avg(x).alias(x) for x in names])


def recall_mrr(ranks: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """recall@k and mean reciprocal rank; a missing rank counts 0 (AGG-18)."""
    hit = F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.avg(hit), 3).alias("recall"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 3).alias("mrr"))


def nearest_rank(df: DataFrame, value: str, by: list[str], percents: list[int]) -> DataFrame:
    """Values at position round(p / 100 (n - 1)) in order, halves to even (AGG-20).

    Positions come from a count and a running count of distinct values, so
    that a group is never gathered in an array.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = F.sum("m").over(w)
    n = F.sum("m").over(Window.partitionBy(*by))
    placed = counts.select(*by, value, (upto - F.col("m")).alias("lo"), upto.alias("hi"), n.alias("n"))
    at = lambda p: F.bround(F.lit(p / 100) * (F.col("n") - 1)).cast("long")
    return placed.groupBy(*by).agg(*[F.max(F.when((at(p) >= F.col("lo")) & (at(p) < F.col("hi")), F.col(value))).alias(f"p{p}") for p in percents])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (AGG-25, 27)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of every table (AGG-30)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.union(one)
    return out


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = before.select("table", F.col("rows").alias("before")), after.select("table", F.col("rows").alias("after"))
    return b.join(a, "table", "full_outer").withColumn("delta", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))


def dominant(df: DataFrame, by: list[str], label: str, order: list[str]) -> DataFrame:
    """The most frequent label of each group, ties by the given order; null where none of them occurs (AGG-31)."""
    counts = df.where(F.col(label).isin(*order)).groupBy(*by, label).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label))
    return df.select(*by).distinct().join(counts.groupBy(*by).agg(F.max_by(label, F.struct("n", -place)).alias("dominant")), by, "left")


def token_frequency(docs: DataFrame, text: Column, share: float = 0.05) -> DataFrame:
    """(token, df) of tokens that at most that share of the documents hold (AGG-19, SCAL-77)."""
    total = docs.agg(F.count("*").alias("total"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z가-힣]{2,})"), 1))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(total), F.lit(True)).where(F.col("df") <= F.col("total") * share).drop("total")


def substring_frequency(tokens: DataFrame, docs: DataFrame, text: Column, share: float = 0.05, without: DataFrame | None = None) -> DataFrame:
    """(token, df): documents that contain a token anywhere, whatever its case, for tokens that at most that share of them contain (AGG-19, SCAL-77).

    tokens: (token, ...), lower-cased and made distinct; without: (token)
    that are left out, names of stocks say. Blocks of tokens are automatons
    through which each text goes once; the counts of a part are summed by Spark.
    """
    wanted = tokens.select(F.lower("token").alias("query_id")).where("query_id <> ''").distinct()
    if without is not None:
        wanted = wanted.join(without.select(F.lower("token").alias("query_id")), "query_id", "left_anti")

    def count(asked: pa.Table, held: pa.Table) -> pa.Table:
        import ahocorasick

        found: Counter = Counter()
        if asked.num_rows and held.num_rows:
            automaton = ahocorasick.Automaton()
            for t in asked["query_id"].to_pylist():
                automaton.add_word(t, t)
            automaton.make_automaton()
            for t in held["search_text"].to_pylist():
                found.update({x for _, x in automaton.iter(t.lower())})
        return pa.table({"token": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    texts = docs.select(F.monotonically_increasing_id().alias("chunk_id"), text.alias("search_text")).where("search_text IS NOT NULL")
    parts = in_blocks(wanted, texts, CHUNK_BLOCK, count, "token string, n long")
    total = F.broadcast(docs.agg(F.count("*").alias("total")))  # one row
    counted = wanted.select(F.col("query_id").alias("token")).join(parts.groupBy("token").agg(F.sum("n").alias("df")), "token", "left")
    return counted.select("token", F.coalesce("df", F.lit(0)).alias("df")).join(total, F.lit(True)).where(F.col("df") <= F.col("total") * share).drop("total")


def split_units(units: DataFrame, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """units (stock, unit, rows) with `split`, filled near its shares by the largest deficit (AGG-22, 23).

    A stock's units go one after another, the largest first and equal ones in
    a seeded order, each to the split that lacks most of its share of the
    stock's rows, the first in `shares` of equal ones. A unit is never
    divided, so no key of it leaks into two splits (AGG-24). A stock lies
    sorted in one partition and goes by in batches; only what its splits have
    is carried along. Null stocks are a stock, null units a unit.
    """
    names = list(shares)
    totals = units.groupBy(F.col("stock").alias("__stock")).agg(F.sum("rows").alias("__total"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("unit").cast("string")).cast("binary"))
    known = units.join(totals, F.col("stock").eqNullSafe(F.col("__stock"))).drop("__stock").withColumn("__order", order)
    schema = T.StructType([*units.schema.fields, T.StructField("split", T.StringType())])

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, has = object(), []
        for frame in frames:
            splits = []
            for stock, n, total in zip(frame["stock"].tolist(), frame["rows"].tolist(), frame["__total"].tolist(), strict=True):
                stock = None if stock != stock else stock
                if stock != at:
                    at, has = stock, [0] * len(names)
                lacks = [total * shares[s] - h for s, h in zip(names, has, strict=True)]
                best = lacks.index(max(lacks))
                has[best] += n
                splits.append(names[best])
            yield frame.drop(columns=["__total", "__order"]).assign(split=splits)

    return known.repartition("stock").sortWithinPartitions("stock", F.desc("rows"), "__order", "unit").mapInPandas(fill, schema)

