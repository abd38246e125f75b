"""Exact top-k search by a table of pivot distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import cut

K = 20
SCALE = 64
#: Pivots, drawn by hash from all rows (a documented bound; any pivots give exact results), and those nearest a query, which bound best.
PIVOTS, NEAREST = 256, 8
#: Rows of a part, held by one task; queries pass through it in a stream.
PART_ROWS = 16384
#: Queries that meet a part in one task.
QUERY_ROWS = 8192
#: Candidates scored at a time, in the order of their bounds.
STEP = 512
#: Squared lengths below which products of two rows are exact in single precision, and beyond which a row is kept apart from the table.
SINGLE, APART = 2.0**22, 2.0**60
#: |x|^2 |q|^2 below which no partial sum of a product passes 2^53, so that doubles are exact; below the other, 64-bit integers are.
DOUBLE, WHOLE = 2.0**106, 2.0**124
LONG = (1 << 63) - 1


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x); what overflows a double stays finite (its scores are beyond a long anyway)."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -(2.0**1023), 2.0**1023)


def squared(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x**2).sum(-1)


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows of any size with q, as longs; those beyond a long are its limit."""
    most = float(squared(x).max(initial=0.0)) * float(squared(q))
    if most < DOUBLE:
        return (x @ q).astype(np.int64)
    if most < WHOLE:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = [int(c) for c in q]
    sums = (sum(int(a) * b for a, b in zip(row, whole)) for row in x.tolist())
    return np.array([max(-LONG, min(LONG, s)) for s in sums], np.int64)


class PivotPart:
    """Candidates with their distances to all pivots; very long rows stand apart and are always scored."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        usual = squared(x) < APART
        self.far_ids, self.far_x = ids[~usual], x[~usual]
        self.ids, self.x, self.pivots = ids[usual], x[usual], pivots
        self.norm = squared(self.x)
        # Whole numbers whose sums stay below 2^24 are exact in single precision.
        if float(self.norm.max(initial=0.0)) < SINGLE:
            self.x = self.x.astype(np.float32)
        self.table = distances(self.x, pivots).T.astype(np.float32)  # one row per pivot
        # A float holds 24 bits; the bounds allow for that.
        self.slack = float(np.abs(self.table).max(initial=0.0)) * 2.0**-22 + 1e-6
        self.two = np.zeros((2, len(self.ids)), np.float32)

    def bounds(self, q: np.ndarray, length: float) -> np.ndarray:
        """No score passes its bound: |d(q, p) - d(x, p)| <= d(q, x) for every pivot p, and q.x = (|q|^2 + |x|^2 - d^2) / 2."""
        to_pivot = distances(q[None], self.pivots)[0].astype(np.float32)
        near = np.argsort(to_pivot, kind="stable")[:NEAREST]
        low, one = self.two
        low.fill(0.0)
        for p in near.tolist():
            np.subtract(self.table[p], to_pivot[p], out=one)
            np.abs(one, out=one)
            np.maximum(low, one, out=low)
        far = np.maximum(low.astype(np.float64) - self.slack, 0.0)
        both = length + self.norm
        return (both - far * far) / 2 + both * 2.0**-48

    def search(self, query_id: int, q: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, candidates scored) of the k best, ties to smaller ids; those below `least` may be left out.

        Candidates are scored by falling bound until the k-th score passes the
        next bound. Where doubles would not be exact, all are scored in integers.
        """
        length = float(squared(q))
        other = np.flatnonzero(self.far_ids != query_id)
        ids, scores = self.far_ids[other], exact_products(self.far_x[other], q)
        if length * APART >= DOUBLE:
            mine = np.flatnonzero(self.ids != query_id)
            ids, scores = np.concatenate([ids, self.ids[mine]]), np.concatenate([scores, exact_products(self.x[mine].astype(np.float64), q)])
            best = np.lexsort((ids, -scores))[:k]
            return ids[best], scores[best], len(ids)
        done = len(ids)
        bound = self.bounds(q, length)
        bound[self.ids == query_id] = -np.inf
        left = np.flatnonzero(bound >= least)
        kind = self.x.dtype if length < SINGLE else np.float64
        step = STEP
        while True:
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                left = left[bound[left] >= scores[-1]]  # an equal score with a smaller id may still come
            if not len(left):
                return ids, scores, done
            if len(left) > step:
                part = np.argpartition(-bound[left], step - 1)
                now, left = left[part[:step]], left[part[step:]]
            else:
                now, left = left, left[:0]
            now = now[bound[now] > -np.inf]
            got = self.x[now] @ q.astype(kind) if len(now) < len(self.x) // 2 else (self.x @ q.astype(kind))[now]
            done += len(now)
            ids, scores = np.concatenate([ids, self.ids[now]]), np.concatenate([scores, got.astype(np.int64)])
            step *= 8


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squared(x)[:, None] + squared(pivots)[None] - 2 * (x @ pivots.T.astype(x.dtype)), 0.0))


def exact_top_k(embeddings: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to smaller vec_id.

    Components become floor(SCALE x) of doubles; vectors that are null, hold
    null or non-finite components, or differ in length from most take no
    part; so do rows with a null vec_id. Finite components of any size count:
    products are exact, and a score beyond a long is its limit. Queries are the rows whose vec_id is
    divisible by `every`; candidates all rows but those of the query's own
    vec_id. Rows that repeat a vec_id are candidates of their own; of those
    that repeat a query's the smallest vector asks.

    Rows are dealt to parts of about PART_ROWS by hash, queries to turns of
    about QUERY_ROWS; a task holds one part with its pivot table and one turn,
    so its memory is bounded. There are two passes: the first searches a query's own part alone, the second all
    others, leaving out what scores below the first pass's k-th.
    """
    spark = embeddings.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    clean = embeddings.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    counts = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, vec_id long, score long"
    if counts is None or counts["n"] == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = -(-counts["count"] // PART_ROWS)
    # A hash of id and vector deals out rows that repeat an id as well.
    rows = cut(clean.where(F.size("v") == counts["n"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")), "topk-rows")
    h = F.xxhash64(F.lit(2), "v")
    smallest = [r[0] for r in rows.select(h.alias("h")).distinct().orderBy("h").limit(PIVOTS).collect()]
    drawn = rows.where(h.isin(smallest)).groupBy(h.alias("h")).agg(F.min("v").alias("v")).toPandas().sort_values("h")["v"]
    pivots = scaled(np.array(drawn.tolist()))
    pivots = pivots[squared(pivots) < APART]
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "part")).alias("q")).select("vec_id", "q.v", "q.part")
    turns = max(1, -(-queries.count() // QUERY_ROWS))

    def search(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        kind = np.asarray(group["query"])
        x = scaled(np.asarray(group["v"].combine_chunks().flatten()).reshape(group.num_rows, -1))
        ids, least = np.asarray(group["vec_id"]), np.asarray(group["least"].fill_null(-np.inf))
        part = PivotPart(ids[~kind], x[~kind], pivots)
        who, to, score = [], [], []
        for i in np.flatnonzero(kind).tolist():
            got, s, _ = part.search(int(ids[i]), x[i], k, least[i])
            keep = s >= least[i]
            who.append(np.full(int(keep.sum()), ids[i]))
            to.append(got[keep])
            score.append(s[keep])
        cat = lambda z: np.concatenate(z).astype(np.int64) if z else np.zeros(0, np.int64)
        return pa.table({"query_id": cat(who), "vec_id": cat(to), "score": cat(score)})

    def run(asked: DataFrame) -> DataFrame:
        held = rows.select("part", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "vec_id", "v", F.lit(False).alias("query"), F.lit(None).cast("double").alias("least"))
        sent = asked.select("part", F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(turns)).cast("int").alias("turn"), "vec_id", "v", F.lit(True).alias("query"), "least")
        return held.union(sent).groupBy("part", "turn").applyInArrow(search, schema)

    ship(spark)
    own = cut(run(queries.withColumn("least", F.lit(None).cast("double"))), "topk-own")
    reached = own.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low"))
    others = queries.join(reached, queries["vec_id"] == reached["query_id"], "left").select("vec_id", "v", F.col("part").alias("home"), F.when(F.col("n") >= k, F.col("low")).alias("least"))
    others = others.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where("part <> home")
    every_score = own.union(run(others)) if parts > 1 else own
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every_score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
