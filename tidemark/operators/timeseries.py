"""As-of lookups, candles, buckets, version chains and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_before(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str = "before") -> DataFrame:
    """left with the latest `value` of right strictly before its own time (JOIN-12).

    Both sides go through one sort per key as a union; at equal times left
    stands first, so that only earlier values are seen. No pair is made.
    """
    cols = left.columns
    l = left.select(*by, at, F.lit(0).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.struct(*cols).alias("__row"))
    r = right.select(*by, at, F.lit(1).alias("__side"), F.col(value).alias("__value"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, -1)
    seen = l.union(r).withColumn(name, F.last("__value", ignorenulls=True).over(w)).where("__side = 0")
    return seen.select(*[F.col(f"__row.{c}").alias(c) for c in cols], name)


def candles(ticks: DataFrame, by: list[str], at: str, price: str, order: str, width: str = "30 minutes") -> DataFrame:
    """Open, high, low, close and count per bucket; order breaks ties of time (SRC-21, SCAL-71)."""
    first, last = F.struct(at, order), F.struct(at, order)
    w = F.window(F.col(at).cast("timestamp"), width)
    return ticks.groupBy(*by, w.alias("w")).agg(F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, last).alias("close"), F.count("*").alias("n")).select(*by, F.col("w.start").alias("bucket"), "open", "high", "low", "close", "n")


def version_chain(rows: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """rows with original, supersedes, is_latest and status in their chain (WIN-5, JOIN-13)."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("*", F.first(key).over(whole).alias("original"), F.lag(key).over(w).alias("supersedes"), F.lead(key).over(w).isNull().alias("is_latest"), F.when(F.lag(key).over(w).isNull(), "original").otherwise("corrected").alias("status"))


def link_corrections(filings: DataFrame) -> DataFrame:
    """(correction, original): corrections whose title and first date meet exactly one filing (JOIN-11).

    filings: (rcept_no, norm_title, day, is_correction, first_day).
    """
    c = filings.where("is_correction AND first_day IS NOT NULL").select(F.col("rcept_no").alias("correction"), "norm_title", F.col("first_day").alias("day"))
    o = filings.where("NOT is_correction").groupBy("norm_title", "day").agg(F.count("*").alias("n"), F.min("rcept_no").alias("original")).where("n = 1")
    return c.join(o, ["norm_title", "day"]).select("correction", "original")


def sessions(events: DataFrame, by: list[str], at: str, gap_seconds: int) -> DataFrame:
    """events with `session`, a number that grows after gaps longer than that, by the microsecond."""
    w = Window.partitionBy(*by).orderBy(at, *[c for c in events.columns if c not in (*by, at)][:1])
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    return events.withColumn("__new", F.when(gap <= gap_seconds * 1_000_000, 0).otherwise(1)).withColumn("session", F.sum("__new").over(w)).drop("__new")


def latest_report(rows: DataFrame, by: list[str], year: str, code: str, ranks: dict[str, int]) -> DataFrame:
    """(by, year, code) of the latest report by year and rank of its code within the year (WIN-7)."""
    rank = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    best = F.max_by(F.struct(year, code), F.struct(F.col(year), F.coalesce(F.try_element_at(rank, F.col(code)), F.lit(0))))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, f"b.{year}", f"b.{code}")
