"""Keep-latest merges, versions of documents, replacement of children, and publishing by a switch.

Plain Parquet has no MERGE: every function gives the whole new state, which
publish() writes to a fresh folder before a one-row pointer names it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Existing and incoming rows, the latest arrival of each key (SNK-1, 4..8, 13, 14, 19, 21..24, 38).

    Ties of arrival go to the incoming row. One shuffle on the keys.
    """
    return latest(arrivals(existing, incoming), keys, arrival)


def arrivals(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of both, those of incoming marked by `__new`."""
    return existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)


def latest(both: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The latest arrival of each key among arrivals(), ties to the incoming row."""
    return keep_first(both, keys, [F.col(arrival).desc_nulls_last(), F.col("__new").desc()]).drop("__new")


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming keys that are not there yet, once each: ON CONFLICT DO NOTHING (JOIN-17, SNK-31, 32)."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def version_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versions after an incremental run (SNK-9, 10, ST-14).

    stored: (source_pk, content_hash, is_current, version); incoming:
    (source_pk, content_hash). An equal hash of the current version is
    skipped; another deactivates it and becomes current, again if it was
    stored before. Gives all versions with `action`: indexed, reactivated,
    deactivated, skipped or kept.
    """
    new = keep_first(incoming, ["source_pk"], [F.col("content_hash")]).select("source_pk", F.col("content_hash").alias("new_hash"))
    joined = stored.join(new, "source_pk", "left")
    same = F.col("content_hash") == F.col("new_hash")
    old = joined.select(
        "source_pk", "content_hash", "version",
        F.when(F.col("new_hash").isNull(), F.col("is_current")).otherwise(same).alias("is_current"),
        F.when(F.col("new_hash").isNull(), "kept").when(same & F.col("is_current"), "skipped").when(same, "reactivated").when(F.col("is_current"), "deactivated").otherwise("kept").alias("action"),
    )
    last = stored.groupBy("source_pk").agg(F.max("version").alias("last"))
    fresh = new.join(stored.select("source_pk", F.col("content_hash").alias("new_hash")), ["source_pk", "new_hash"], "left_anti").join(last, "source_pk", "left")
    return old.unionByName(fresh.select("source_pk", F.col("new_hash").alias("content_hash"), (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), F.lit(True).alias("is_current"), F.lit("indexed").alias("action")))


def replace_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of a parent that comes again are replaced as a whole (SNK-11, 12, 15, 16)."""
    return children.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def publish(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> str:
    """Write a new version beside the old, then point to it by the next number (SNK-25, 26): readers never see half a version."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{folder}/v-{version}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    last = _versions(spark, folder).agg(F.max("number")).first()[0] if known else 0
    spark.createDataFrame([(version, last + 1)], _VERSION).coalesce(1).write.mode("append").json(f"{folder}/versions")
    return version


_VERSION = "version string, number long"


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_VERSION).json(f"{folder}/versions")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The version that was published last: the one with the highest number."""
    return spark.read.parquet(f"{folder}/v-{_versions(spark, folder).orderBy(F.desc('number'), F.desc('version')).first()[0]}")


def claim(claims: DataFrame, wanted: DataFrame, keys: list[str], now: Column, stale: str = "30 minutes") -> DataFrame:
    """wanted keys with `taken`: unless completed, or in processing for less than `stale` (JOIN-18)."""
    busy = (F.col("status") == "completed") | ((F.col("status") == "processing") & (F.col("claimed_at") > now - F.expr(f"INTERVAL {stale}")))
    held = keep_first(claims, keys, [F.col("claimed_at").desc_nulls_last()])
    return wanted.dropDuplicates(keys).join(held, keys, "left").withColumn("taken", ~F.coalesce(busy, F.lit(False))).select(*wanted.columns, "taken")
