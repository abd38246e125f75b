"""Folds over ordered outcomes: budgets, retries, gates, resumption."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship


def due(status: Column, next_retry_at: Column, changed_at: Column, now: Column, stale: str = "30 minutes") -> Column:
    """Pending, or a retry that is due (none set counts as due), or in processing for too long (FIL-7, 25, ST-10, 11)."""
    return F.coalesce((status == "pending") | ((status == "pending_retry") & (F.coalesce(next_retry_at, now) <= now)) | ((status == "processing") & (changed_at < now - F.expr(f"INTERVAL {stale}"))), F.lit(False))


def retry_states(attempts: DataFrame, by: list[str], at: str, ok: Column, most: int = 3, delay: str = "10 minutes") -> DataFrame:
    """The state of each key after its attempts: completed, pending_retry with its time, or failed (ST-10, SNK-2, 3).

    Failures since the last success count; from `most` on no retry is set.
    """
    marked = attempts.withColumn("__ok", ok)
    last_ok = F.max(F.when(F.col("__ok"), F.col(at))).over(Window.partitionBy(*by))
    since = F.coalesce(F.col(at) > last_ok, F.lit(True)) & ~F.col("__ok")
    g = marked.withColumn("__since", since).groupBy(*by).agg(F.count_if("__since").alias("failures"), F.max(at).alias("last_at"), F.count("*").alias("attempts"))
    state = F.when(F.col("failures") == 0, "completed").when(F.col("failures") < most, "pending_retry").otherwise("failed")
    return g.select(*by, "attempts", "failures", "last_at", state.alias("state"), F.when(state == "pending_retry", F.col("last_at") + F.expr(f"INTERVAL {delay}")).alias("next_retry_at"))


def seconds_until_retry(rows: DataFrame, next_retry_at: str, now: Column) -> DataFrame:
    """The shortest wait, 0 where a row has no time set (LIM-6)."""
    wait = F.greatest(F.lit(0), F.unix_seconds(F.col(next_retry_at).cast("timestamp")) - F.unix_seconds(now.cast("timestamp")))
    return rows.agg(F.min(F.coalesce(wait, F.lit(0))).alias("seconds"))


def running_budget(calls: DataFrame, by: list[str], order: list[str], cost: Column, most_calls: int, most_cost: float) -> DataFrame:
    """calls with `spent` before each and `allowed`: calls and cost so far stay within their caps (ST-21).

    Costs are not negative, so the first refused call is followed only by
    refused ones and a running sum tells exactly where the budget ends.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum("__cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(18,6)"))
    out = calls.withColumn("__cost", cost.cast("decimal(18,6)"))
    return out.select(*calls.columns, before.alias("spent"), ((F.row_number().over(w) <= most_calls) & (before + F.col("__cost") <= F.lit(most_cost).cast("decimal(18,6)"))).alias("allowed"))


def adaptive_gate(outcomes: DataFrame, by: list[str], order: list[str], workers: int = 8) -> DataFrame:
    """(by, order, limit, halted) after every ordered outcome (ST-20).

    A failure takes one worker away, 50 successes in a row give one back; 20
    failures in a row, or over 10 % failures after 20 calls, halt. A group is
    one run's calls, gone through in order.
    """
    ship(outcomes.sparkSession)
    kept = [*by, *order]
    schema = outcomes.select(*kept).schema.add("limit", T.IntegerType()).add("halted", T.BooleanType())

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        limit, bad_run, good_run, bad, halted, out = workers, 0, 0, 0, False, []
        for n, ok in enumerate(rows["ok"], 1):
            if not halted:
                bad_run, good_run, bad = (0, good_run + 1, bad) if ok else (bad_run + 1, 0, bad + 1)
                if ok and good_run >= 50 and limit < workers:
                    limit, good_run = limit + 1, 0
                elif not ok:
                    limit = max(1, limit - 1)
                halted = bad_run >= 20 or (n >= 20 and bad / n > 0.10)
            out.append((limit, halted))
        return rows[kept].assign(limit=[x[0] for x in out], halted=[x[1] for x in out])

    return outcomes.groupBy(*by).applyInPandas(fold, schema)


def unfinished(wanted: DataFrame, results: DataFrame, keys: list[str], done=("success", "no_data")) -> DataFrame:
    """Requests without a result that ends them (ST-9, SRC-14, UDF-16)."""
    return wanted.join(results.where(F.col("status").isin(*done)).select(*keys).distinct(), keys, "left_anti")


def activation_gate(counts: dict[str, DataFrame]) -> DataFrame:
    """(check, remaining, ok) for each set that must be empty before a version is activated (ST-19)."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("remaining")).select(F.lit(name).alias("check"), "remaining", (F.col("remaining") == 0).alias("ok"))
        out = one if out is None else out.union(one)
    return out
