"""Tables in buckets of their keys under one manifest: a merge rewrites the buckets that it touches, and all tables switch at once."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import arrivals, latest

#: Parts of a bucket that are merged apart, in tasks of their own where there are many rows.
PARTS = 8


class Conflict(RuntimeError):
    """Another writer has published the number that was to be this one's."""


@dataclass
class Snapshot:
    """One published state: for each table its schema, keys and the version in which each bucket was written last."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    ledger: dict[str, dict] = field(default_factory=dict)


class BucketStore:
    """Tables under a folder that all workers reach. The manifests are small files, `manifest/<number>.json`; the highest number counts.

    A manifest is created only where its number is not taken, so of two
    writers one fails and starts anew. Readers hold a snapshot: files that it
    names are never changed.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def snapshot(self) -> Snapshot:
        at = self._path(f"{self.folder}/manifest")
        if not self._fs.exists(at):
            return Snapshot()
        numbers = [int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json")]
        if not numbers:
            return Snapshot()
        text = "".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest/{max(numbers):012d}.json").collect())
        return Snapshot(**json.loads(text))

    def read(self, table: str, snapshot: Snapshot | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as of the snapshot, or some of its buckets; None where it was never written."""
        known = (snapshot or self.snapshot()).tables.get(table)
        if not known:
            return None
        schema = T.StructType.fromJson(known["schema"])
        paths = [f"{self.folder}/{table}/{version}/bucket={b}" for b, version in known["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, keys: list[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def stage(self, table: str, rows: DataFrame, keys: list[str], arrival: str, base: Snapshot) -> dict:
        """Write the buckets of a table that rows fall into, merged with what the base has there; nothing is published yet.

        Of a key's rows the latest arrival stays. Rows are written once before
        they are looked at twice; only the numbers of touched buckets reach
        the driver, as bits observed beside that write.
        """
        version = uuid.uuid4().hex
        incoming = f"{self.folder}/tmp/{version}"
        words, seen = range(-(-self.buckets // 64)), Observation(f"touched-{version}")
        bits = [F.bit_or(F.when(F.floor(F.col("bucket") / 64) == i, F.expr("shiftleft(1L, bucket % 64)"))).alias(f"w{i}") for i in words]
        rows.withColumn("bucket", self.bucket(keys)).observe(seen, *bits).write.parquet(incoming)
        rows_again = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(incoming)
        held = seen.get
        touched = [b for b in range(self.buckets) if (held.get(f"w{b // 64}") or 0) >> b % 64 & 1]
        known = base.tables.get(table, {"buckets": {}})
        before = self.read(table, base, touched)
        new = rows_again.drop("bucket")
        both = arrivals(before if before is not None else new.limit(0), new)
        # One shuffle by bucket and a part of its keys: whoever meets a key's rows also writes its bucket.
        h = F.xxhash64(*keys)
        placed = both.withColumns({"bucket": self.bucket(keys), "__part": F.pmod(F.shiftright(h, 32), F.lit(PARTS))}).repartition("bucket", "__part")
        merged = latest(placed, ["bucket", "__part", *keys], arrival).drop("__part")
        if touched:
            merged.write.partitionBy("bucket").parquet(f"{self.folder}/{table}/{version}")
        merged = merged.drop("bucket")
        self._fs.delete(self._path(incoming), True)
        return {"schema": merged.schema.jsonValue(), "keys": keys, "buckets": {**known["buckets"], **{str(b): version for b in touched}}}

    def switch(self, base: Snapshot, staged: dict[str, dict], ledger: dict | None = None) -> Snapshot:
        """Publish staged tables, all at once, as the state after the base."""
        after = Snapshot(base.number + 1, {**base.tables, **staged}, base.ledger if ledger is None else ledger)
        self._publish(after)
        return after

    def commit(self, changes: dict[str, tuple[DataFrame, list[str], str]]) -> Snapshot:
        """Merge rows into tables and publish all at once. changes: table -> (rows, keys, arrival)."""
        base = self.snapshot()
        return self.switch(base, {name: self.stage(name, *change, base) for name, change in changes.items()})

    def _publish(self, snapshot: Snapshot) -> None:
        """The manifest's whole text under a name of its own, then renamed, which fails where the number is taken."""
        own, final = (self._path(f"{self.folder}/{x}") for x in (f"tmp/{uuid.uuid4().hex}", f"manifest/{snapshot.number:012d}.json"))
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(vars(snapshot)).encode()))
        out.close()
        taken = self._fs.exists(final) or not self._fs.rename(own, final)
        if taken:
            self._fs.delete(own, False)
            raise Conflict(f"manifest {snapshot.number} is there already")

    def clean(self, keep: int = 2) -> int:
        """Delete bucket files that none of the `keep` newest manifests names; gives their number."""
        at = self._path(f"{self.folder}/manifest")
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(at))
        used, gone = set(), 0
        for name in names[-keep:]:
            held = json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest/{name}").collect()))
            used |= {(t, version, int(b)) for t, x in held["tables"].items() for b, version in x["buckets"].items()}
        for name in names[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/manifest/{name}"), False)
        for t in {t for t, *_ in used}:
            for version in self._fs.listStatus(self._path(f"{self.folder}/{t}")):
                for b in self._fs.listStatus(version.getPath()):
                    name = b.getPath().getName()
                    if name.startswith("bucket=") and (t, version.getPath().getName(), int(name[7:])) not in used:
                        self._fs.delete(b.getPath(), True)
                        gone += 1
        return gone
