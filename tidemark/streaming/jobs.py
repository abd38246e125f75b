"""Structured Streaming forms: windows, sessions, late rows, merges per batch, online clusters, retry timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.buckets import BucketStore
from ..operators.cluster import OPEN, Judge, Rules, State, assign, from_rows, prune, to_rows
from ..operators.merge import current, publish, version_documents
from ..ship import ship


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, `ts` with its zone."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "30 minutes", late: str = "48 hours") -> DataFrame:
    """(bucket, event_type, n, total): rows may be `late`; later ones are dropped by the watermark (ST-12, 22)."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "24 hours", late: str = "48 hours") -> DataFrame:
    """(user_id, start, end, n): sessions that end after a gap without events."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drop_seen(rows: DataFrame, keys: list[str], late: str = "48 hours") -> DataFrame:
    """Rows whose keys were not seen within the watermark (ST-31)."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def split_late(batch: DataFrame, newest, late: str = "48 hours") -> tuple[DataFrame, DataFrame]:
    """(rows in time, later rows for a side output)."""
    limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
    return batch.where(F.col("ts") >= limit), batch.where(F.col("ts") < limit)


def merge_batches(folder: str, keys: list[str], arrival: str, table: str = "rows", buckets: int = 64):
    """A foreachBatch function: each micro-batch is merged into the buckets of a published table that it touches (SNK-1, ST-14).

    A batch that comes again, since its run was killed after the switch, is known by its number and left out.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        store = BucketStore(batch.sparkSession, folder, buckets)
        base = store.snapshot()
        if base.ledger.get("batch", -1) < batch_id:
            store.switch(base, {table: store.stage(table, batch, keys, arrival, base)}, {"batch": batch_id})

    return merge


def index_batches(folder: str):
    """A foreachBatch function: versions of documents by content hash (SNK-9, ST-14)."""

    def index(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            stored = current(spark, folder).drop("action")
        except Exception as none:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(none):
                raise
            stored = spark.createDataFrame([], "source_pk string, content_hash string, version int, is_current boolean")
        publish(version_documents(stored, batch.select("source_pk", "content_hash")), folder)

    return index


class Assigner(StatefulProcessor):
    """A stock's open clusters and recent articles as map states, freed by a timer when the stock falls silent."""

    def __init__(self, rules: Rules, judge: Judge | None, stock: str, kind: str):
        self.rules, self.judge, self.stock, self.kind = rules, judge, stock, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clusters = handle.getMapState("clusters", f"cluster_id {self.kind}", OPEN.format(kind=self.kind).split(", ", 1)[1])
        self.seen = handle.getMapState("seen", f"article_id {self.kind}", "t_hours double")

    def _held(self) -> State:
        return from_rows([(*k, *v) for k, v in self.clusters.iterator()])

    def _keep(self, state: State, newest: float, seen: dict | None = None) -> None:
        """Write what is open, forget the rest, and wake when the last of it closes. seen: hours of the articles held and of the new ones."""
        rows = {r[0]: r for r in to_rows(state)}
        for (k,) in list(self.clusters.keys()):
            if k not in rows:
                self.clusters.removeKey((k,))
        for k, r in rows.items():
            self.clusters.updateValue((k,), tuple(r[1:]))
        # Each call is a message to the state server: articles that are not to be kept are never written.
        held = {k: t for (k,), (t,) in self.seen.iterator()}
        for k, t in ((seen or {}) | held).items():
            if newest - t > self.rules.window_hours:
                if k in held:
                    self.seen.removeKey((k,))
            elif k not in held:
                self.seen.updateValue((k,), (t,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if rows:
            self.handle.registerTimer(int((newest + self.rules.window_hours + FIRST_HOUR) * 3_600_000) + 1)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        names = [x.split(" ")[0] for x in OPEN.split(", ")]
        rows = [tuple(r[n] for n in names) for r in initialState.to_dict("records")]
        self._keep(from_rows(rows), max(r[4] for r in rows))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out, newest = self._held(), [], None
        rows = pd.concat(list(rows)).sort_values(["t_hours", "article_id"]).to_dict("records")
        try:
            new, seen = {}, {k for (k,) in self.seen.keys()}
            for r in rows:
                if r["article_id"] in new or r["article_id"] in seen:
                    continue
                prune(state, self.rules, r["t_hours"])
                out.append({"stock_code": key[0], "article_id": r["article_id"], **assign(state, self.rules, r, np.asarray(r["vec"], dtype=float), r["t_hours"], self.judge), "error": None})
                new[r["article_id"]] = newest = r["t_hours"]
        except Exception as failure:  # noqa: BLE001  one stock's failure is a row; its state stays as it was
            yield pd.DataFrame([(key[0], *[None] * 6, f"{type(failure).__name__}: {failure}")], columns=ASSIGNED, dtype=object)
            return
        if new:
            self._keep(state, newest, new)
        yield pd.DataFrame(out, columns=ASSIGNED, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clusters.clear()
        self.seen.clear()
        yield pd.DataFrame([], columns=ASSIGNED, dtype=object)

    def close(self) -> None:
        pass


#: Hours that event times are ahead of t_hours: the watermark begins at the epoch, and what is not after it is late.
FIRST_HOUR = 1.0
ASSIGNED = ["stock_code", "article_id", "cluster_id", "is_new", "similarity", "how", "candidates", "error"]


def cluster_stream(articles: DataFrame, rules: Rules | None = None, judge: Judge | None = None, initial: DataFrame | None = None, late: str = "48 hours") -> DataFrame:
    """Online clusters as a stream: a stock's open clusters are its state, closed ones leave it (ST-1..7, 17, 18).

    articles: as for online_clusters, t_hours in hours since the epoch.
    initial: open clusters (stock_code, ...OPEN) of a run before, from which
    the stream goes on as if it had never stopped. Rows of a micro-batch are
    taken in order of time and id by the same fold as in batch. A stock's
    failure (its judge's, say) is a row with `error`, and its state stays as
    it was; other stocks go on. Event-time timers free the state of a stock
    whose last cluster has closed and which is silent for `late` more.
    """
    rules = rules or Rules()
    ship(articles.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in articles.schema.fields}
    schema = f"stock_code {kinds['stock_code']}, article_id {kinds['article_id']}, cluster_id {kinds['article_id']}, is_new boolean, similarity double, how string, candidates int, error string"
    timed = articles.withColumn("ts", F.timestamp_millis(((F.col("t_hours") + FIRST_HOUR) * 3_600_000).cast("long"))).withWatermark("ts", late)
    known = initial.select("stock_code", *[x.split(" ")[0] for x in OPEN.split(", ")]).groupBy("stock_code") if initial is not None else None
    return timed.groupBy("stock_code").transformWithStateInPandas(Assigner(rules, judge, kinds["stock_code"], kinds["article_id"]), schema, "Append", "EventTime", known)


def retry_stream(attempts: DataFrame, most: int = 3, wait_ms: int = 600_000) -> DataFrame:
    """(key, state, failures) after each batch; a pending retry that waits too long is due by a timer (ST-10, 11).

    attempts: (key, ok).
    """
    ship(attempts.sparkSession)

    def fold(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        failures = held.get[0] if held.exists else 0
        if held.hasTimedOut:
            yield pd.DataFrame([(key[0], "due", failures)], columns=["key", "state", "failures"])
            held.remove()
            return
        for frame in frames:
            for ok in frame["ok"]:
                failures = 0 if ok else failures + 1
        state = "completed" if failures == 0 else "pending_retry" if failures < most else "failed"
        held.update((failures,))
        if state == "pending_retry":
            held.setTimeoutDuration(wait_ms)
        yield pd.DataFrame([(key[0], state, failures)], columns=["key", "state", "failures"])

    kind = attempts.schema["key"].dataType.simpleString()
    return attempts.groupBy("key").applyInPandasWithState(fold, f"key {kind}, state string, failures int", "failures int", "update", GroupStateTimeout.ProcessingTimeTimeout)


#: Partitions of a stream's state for each core; a checkpoint keeps the number that it began with.
STATE_TASKS = 2


def run_once(stream: DataFrame, checkpoint: str, batch=None, name: str | None = None, mode: str = "append"):
    """Run a stream over what is there and stop: into a function per batch, or a view `name` of Parquet files beside the checkpoint.

    Each batch has a folder of its own that a repeated batch writes anew; in
    complete mode a batch is the table and all have one. No row reaches the driver.
    State lies in STATE_TASKS partitions a core at most: each opens its store
    and, for state in Python, a worker in every batch, however few keys it has.
    """
    rows = f"{checkpoint}-rows"

    def put(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{rows}/{'all' if mode == 'complete' else batch_id}")

    if not batch:
        stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{rows}/{'all' if mode == 'complete' else 0}")
    conf, shuffles = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    # RocksDB is what map states and timers need; the session's own settings come back once the query has read these.
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if not batch:
        own[shuffles] = str(min(int(conf.get(shuffles)), STATE_TASKS * stream.sparkSession.sparkContext.defaultParallelism))
    before = {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode).foreachBatch(batch or put).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            conf.set(k, v) if v else conf.unset(k)
    if not batch:
        stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(rows).createOrReplaceTempView(name)
    return q
