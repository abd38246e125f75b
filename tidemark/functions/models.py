"""Outside models as injected functions over batches, and what is decided from their results (UDF-1..8, 16, 19)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..ship import ship
from .vectors import as_column

LABELS = ("positive", "neutral", "negative")
#: Rows that are given back together.
ROWS_OUT = 512


def apply_model(df: DataFrame, column: str, make: Callable[[], Callable[[list], list]], result: str, schema: str, batch: int = 32) -> DataFrame:
    """df with `result`: what the model says of the column, in batches; the model is made once per task.

    A batch that fails is tried row by row, and a row that fails has null, so
    that one bad row does not lose its neighbours. Rows stay as Arrow holds
    them: only one batch of the column at a time becomes Python's values.
    """
    ship(df.sparkSession)
    kind = df.schema
    out = type(kind)(list(kind.fields)).add(result, T.DataType.fromDDL(schema))
    at, names, made = df.columns.index(column), out.names, to_arrow_type(out[result].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()

        def one(x):
            try:
                return model([x])[0]
            except Exception:  # noqa: BLE001  the row's own failure
                return None

        for rows in in_full(batches, some):
            said = []
            for begin in range(0, rows.num_rows, batch):
                part = rows.column(at).slice(begin, batch).to_pylist()
                try:
                    said += model(part)
                except Exception:  # noqa: BLE001
                    said += [one(x) for x in part]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said, made, from_pandas=True)], names=names)

    some = batch * max(1, ROWS_OUT // batch)  # given back together
    return df.mapInArrow(run, out)


def in_full(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows, `size` of them at a time but for the last, however many an Arrow batch of the session holds."""
    waiting, n = [], 0
    for b in batches:
        waiting, n = [*waiting, b], n + b.num_rows
        while n >= size:
            rows = pa.Table.from_batches(waiting)
            yield from rows.slice(0, size).combine_chunks().to_batches()
            waiting, n = rows.slice(size).to_batches(), n - size
    if n:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def hashing_embedder(dim: int = 64) -> Callable[[list], list]:
    """A stand-in for an embedding service: words hashed into a unit vector."""
    import zlib

    def embed(texts: list) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h & 1 << 20 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out

    return embed


def cached(df: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results from a cache table, and computed ones for the keys that it lacks (UDF-16)."""
    lacks = df.join(cache.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return df.join(cache.unionByName(compute(lacks).select(*cache.columns)), keys, "left")


def sentiment(logits) -> Column:
    """(label, score, positive, neutral, negative) from three logits: softmax, the first of the highest wins; null or empty is unknown."""
    x = as_column(logits)
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    p = lambda i: F.get(e, F.lit(i)) / total
    label = F.get(F.array(*[F.lit(z) for z in LABELS]), (F.array_position(x, top) - 1).cast("int"))
    ok = x.isNotNull() & (F.size(x) == 3)
    return F.when(ok, F.struct(label.alias("label"), (F.lit(1.0) / total).alias("score"), p(0).alias("positive"), p(1).alias("neutral"), p(2).alias("negative"))).otherwise(F.struct(F.lit("unknown").alias("label"), *[F.lit(None).cast("double").alias(n) for n in ("score", *LABELS)]))


def shown_sentiment(label, score, least: float = 0.65) -> Column:
    """(label, score, reason) as shown: unknown is null, an unsure direction is neutral without a score (FIL-24)."""
    label, score = as_column(label), as_column(score)
    unsure = label.isin("positive", "negative") & (F.coalesce(score, F.lit(0.0)) < least)
    return F.struct(F.when(unsure, "neutral").when(label != "unknown", label).alias("label"), F.when(~unsure & (label != "unknown"), score).alias("score"), F.when(unsure, "low_confidence").alias("reason"))


def is_current(label, model, version, stored_hash, wanted_model: str, wanted_version: str, now_hash) -> Column:
    """The stored result stands: it has a label, and model, version and input are the same (SCAL-82)."""
    return as_column(label).isNotNull() & as_column(model).eqNullSafe(F.lit(wanted_model)) & as_column(version).eqNullSafe(F.lit(wanted_version)) & as_column(stored_hash).eqNullSafe(as_column(now_hash))
