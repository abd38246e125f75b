"""Shared helpers: the cluster's shared folder, lineage cuts, column passing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

#: The six ASCII blanks that separate words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java form of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch of whole texts (Spark's default of 10,000 rows can be large with long texts).
TEXT_BATCH_ROWS = 1024

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-llm-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what cut() wrote for df."""
    spark, path = df.sparkSession, getattr(df, "_cut_path", None)
    if path:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def pack(df: DataFrame, keep: list[Column]) -> DataFrame:
    """Columns of df as one struct `row` beside those of `keep`: no name in df can clash with a helper column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *keep)


def unpack(df: DataFrame, names: list[str], added: dict[str, Column]) -> DataFrame:
    """The packed columns again, and `added`; an added column replaces one of the same name."""
    new = {k.lower() for k in added}
    return df.select(*[F.col("row")[c].alias(c) for c in names if c.lower() not in new], *[v.alias(k) for k, v in added.items()])


def with_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], added: list[tuple[str, str]], inputs: list[str | Column]) -> DataFrame:
    """df with the columns that fn computes from Arrow batches of `inputs`.

    All columns of df pass through, whatever their names; an added column
    replaces one of the same name. fn gets an iterator of record batches and yields, for each, the
    list of added Arrow arrays.
    """
    small_batches(df.sparkSession)
    new = {n.lower() for n, _ in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    kept_names = [f.name for f in kept]
    # Inputs travel as columns of their own, so that a replaced column can be an input too.
    # The row's fields are renamed by number: no name in df can clash with the one that keeps the struct from being empty.
    fields = [F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(kept_names)]
    sent = df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"in{i}") for i, c in enumerate(inputs)], F.struct(*fields, F.lit(1).alias("one")).alias("row"))
    schema = T.StructType([T.StructField("row", sent.schema["row"].dataType), T.StructField("add", T._parse_datatype_string(", ".join(f"c{i} {t}" for i, (_, t) in enumerate(added))))])
    n_in = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Array] = []

        def feed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                waiting.append(b.column(n_in))
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n_in)], names=[f"in{i}" for i in range(n_in)])

        for arrays in fn(feed()):
            yield pa.RecordBatch.from_arrays([waiting.pop(0), pa.StructArray.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])], names=["row", "add"])

    out = map_arrow(sent, run, schema)
    return out.select(*[F.col("row")[f"r{i}"].alias(c) for i, c in enumerate(kept_names)], *[F.col("add")[f"c{i}"].alias(n) for i, (n, _) in enumerate(added)])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with this package on the executors' path."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, tag: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): each node of `edges` (a, b: long) with the smallest node that it reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every
    step is a grouped minimum and a merge join on the node, which adaptive
    execution can split where a node is hot; the edges stay in the shared folder
    and only a checksum reaches the driver. Nodes without an edge are not returned.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m0")).select("a", F.least("a", "m0").alias("m"))
        moved = both.join(low.hint("merge"), "a")  # never broadcast: packed ids look small, and the driver would unpack them
        if large:
            return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = low.where("a <> m").select("a", F.col("m").alias("b"))
        return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    seen = None
    for _ in range(rounds):
        after = cut(step(step(now, True), False), tag)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if seen == tuple(mark):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = tuple(mark)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
