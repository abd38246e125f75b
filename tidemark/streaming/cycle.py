"""A cycle of stages for each micro-batch: every stage commits with its entry in a ledger, and a run goes on at the first open one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.buckets import BucketStore, Snapshot

#: Changes that a stage makes: table -> (rows, keys, arrival).
Changes = dict[str, tuple[DataFrame, list[str], str]]


@dataclass
class Stage:
    """work(batch, read) gives the stage's changes; read(table) is the table as the stages before left it, or None.

    skip(batch, read) true: nothing is done, and that is what the ledger says.
    isolated: a failure is recorded and the next stage goes on.
    """

    name: str
    work: Callable[[DataFrame, Callable[[str], DataFrame | None]], Changes]
    skip: Callable[[DataFrame, Callable[[str], DataFrame | None]], bool] | None = None
    isolated: bool = False


RUNS = "runs"


def cycle(store: BucketStore, stages: list[Stage], before: Callable[[str], None] | None = None):
    """A foreachBatch function that runs the stages in order (ST-12, 25, 32).

    A stage's rows and its entry in the ledger, with its row of the table
    `runs` (batch, stage, status, rows, error: ST-16), are published as one;
    the last stage of a batch moves those rows from the ledger to the table,
    so that a batch merges them once. A batch
    that comes again, since its run was killed, skips the stages that the
    ledger has for it, so each stage's changes are made once. Row counts come
    from observe(), beside the write. before(stage) is called before a stage
    begins.
    """
    spark = store.spark

    def run(batch: DataFrame, batch_id: int) -> None:
        now = store.snapshot()
        if now.ledger.get("batch") != batch_id:
            now = Snapshot(now.number, now.tables, {"batch": batch_id, "done": [], "runs": now.ledger.get("runs", [])})
        for stage in stages:
            if stage.name in now.ledger["done"]:
                continue
            if before:
                before(stage.name)
            read = lambda table, at=now: store.read(table, at)
            changes, seen, status, error = {}, {}, "done", None
            ledger = {"batch": batch_id, "done": [*now.ledger["done"], stage.name]}
            try:
                if stage.skip and stage.skip(batch, read):
                    status = "skipped"
                else:
                    for table, (rows, keys, by) in stage.work(batch, read).items():
                        seen[table] = Observation(f"{stage.name}-{table}-{now.number}")
                        changes[table] = (rows.observe(seen[table], F.count(F.lit(1)).alias("n")), keys, by)
                now = _commit(store, now, ledger, changes, seen, (batch_id, stage.name, status, error), stage is stages[-1])
            except Exception as failure:  # noqa: BLE001
                if not stage.isolated:
                    raise
                now = _commit(store, now, ledger, {}, {}, (batch_id, stage.name, "failed", f"{type(failure).__name__}: {failure}"[:500]), stage is stages[-1])

    def _commit(store: BucketStore, now: Snapshot, ledger: dict, changes: Changes, seen: dict[str, Observation], entry: tuple, last: bool) -> Snapshot:
        staged = {name: store.stage(name, *change, now) for name, change in changes.items()}
        # An observation is there once its rows were written.
        counts = {name: int(o.get["n"]) for name, o in seen.items()}
        runs = [*now.ledger.get("runs", []), [*entry, counts, now.number + 1]]
        if last:
            rows = spark.createDataFrame([tuple(r) for r in runs], "batch long, stage string, status string, error string, rows map<string,long>, number long")
            staged[RUNS], runs = store.stage(RUNS, rows, ["batch", "stage"], "number", now), []
        return store.switch(now, staged, ledger | {"runs": runs})

    return run


def recovery_set(new: DataFrame, open_rows: DataFrame, keys: list[str], ts: str, newest, hours: float = 48.0) -> DataFrame:
    """New rows, and rows still open from the last `hours` before `newest` that are not among them, once each."""
    late = open_rows.where(F.col(ts) >= newest - F.make_dt_interval(hours=F.lit(int(hours))))
    return new.unionByName(late.join(new.select(*keys), keys, "left_anti"))
