"""An inverted-list index of vectors: coarse centroids, residuals as product codes, exact re-ranking, and an exact mode by bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import dot
from ..shared import fresh_path
from ..ship import ship
from .blocks import CANDIDATES, met, top_ranked

#: Rows that the driver fits on (the first by hash), and rows for each centroid of the second level, fitted in tasks.
SAMPLE, SAMPLE_PER = 20_000, 64
#: Lists at most; there are about as many as the root of the vectors.
MOST_LISTS = 1 << 16
#: Components under one code, and codes of such a segment (a byte).
SEGMENT, CODES = 4, 256
#: Lists that a query looks into, and coded candidates that it re-ranks for each hit.
PROBES, RERANK = 64, 4
#: Rows of a list that meet queries at a time; a longer list is several parts.
PART_ROWS = 8192
#: Slack of all bounds for rounding, relative to the lengths.
SLACK = 1e-6


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k centroids: evenly spread rows to begin with, then means of the nearest; empty ones take the farthest rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[np.linspace(0, len(distinct) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near, far = nearest(x, c)
        counts = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], axis=1)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        empty = np.flatnonzero(counts == 0)
        c[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and the squared distance."""
    d = (c * c).sum(1) - 2 * (x @ c.T)
    at = d.argmin(1)
    return at, np.maximum(0, d[np.arange(len(x)), at] + (x * x).sum(1))


def _matrix(array: pa.Array) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


@dataclass
class Model:
    """What vectors are coded by; bounded by MOST_LISTS vectors and one codebook a segment."""

    top: np.ndarray  # (cells, dim)
    lists: np.ndarray  # (lists, dim), those of a cell together
    first: np.ndarray  # (cells + 1,): where a cell's lists begin
    books: list[np.ndarray]  # for each segment (codes, components)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: the nearest centroid of the nearest cell."""
        cell, _ = nearest(x, self.top)
        out = np.empty(len(x), np.int64)
        for c in np.unique(cell):
            rows = cell == c
            out[rows] = self.first[c] + nearest(x[rows], self.lists[self.first[c] : self.first[c + 1]])[0]
        return out

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A byte a segment for each row's residual, and the length of what the codes leave out."""
        rest = x - self.lists[at]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        left = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, m * SEGMENT : m * SEGMENT + book.shape[1]]
            codes[:, m], _ = nearest(part, book)
            left += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, segments, codes): inner products of each query's segments with the codewords."""
        out = np.zeros((len(q), len(self.books), CODES))
        for m, book in enumerate(self.books):
            out[:, m, : len(book)] = q[:, m * SEGMENT : m * SEGMENT + book.shape[1]] @ book.T
        return out


@dataclass
class VectorIndex:
    """codes: (list, part, chunk_id, code, err); sizes and reach: rows of each list, and the farthest of them from its centroid."""

    model: Model
    codes: DataFrame
    vectors: DataFrame
    sizes: np.ndarray
    reach: np.ndarray


def fit(vectors: DataFrame, lists: int | None = None) -> Model:
    """Centroids and codebooks. vectors: (chunk_id, embedding double array), all of one length.

    The driver fits the cells and the codebooks on the SAMPLE rows that come
    first by hash; each cell's own centroids are fitted in a task, on at most
    four times its fair share of the rows.
    """
    n = vectors.count()
    lists = lists or int(min(MOST_LISTS, max(1, round(n**0.5))))
    hashed = vectors.select("embedding", F.xxhash64("embedding").alias("h"))
    rows = hashed.orderBy("h").limit(SAMPLE).select("embedding").toArrow()
    x = _matrix(rows["embedding"].combine_chunks()) if rows.num_rows else np.zeros((0, 1))
    if not len(x):
        return Model(np.zeros((1, 1)), np.zeros((1, 1)), np.array([0, 1]), [np.zeros((1, 1))])
    top = k_means(x, max(1, round(lists**0.5)))
    per = max(1, -(-lists // len(top)))
    share = min(1.0, SAMPLE_PER * lists / n)
    some = hashed.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) <= int(share * (1 << 20)))

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, _ = nearest(_matrix(b.column(0)), top) if b.num_rows else (np.zeros(0, np.int64), None)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), b.column(1)], names=["cell", "embedding", "h"])

    def centroids(t: pa.Table) -> pa.Table:
        c = k_means(_matrix(t["embedding"].combine_chunks()), per)
        return pa.table({"cell": pa.array([t["cell"][0].as_py()] * len(c), pa.int32()), "embedding": pa.array(c.tolist(), pa.list_(pa.float64()))})

    dealt = some.mapInArrow(in_cells, "cell int, embedding array<double>, h long").withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("h"))).where(F.col("nth") <= 4 * SAMPLE_PER * per)
    own = dealt.groupBy("cell").applyInArrow(centroids, "cell int, embedding array<double>").toArrow()
    cells, vecs = own["cell"].to_numpy(), _matrix(own["embedding"].combine_chunks())
    order = np.lexsort([*vecs.T[::-1], cells])
    missing = np.setdiff1d(np.arange(len(top)), cells)  # a cell without a row of the sample is its own list
    cells, vecs = np.concatenate([cells[order], missing]), np.concatenate([vecs[order], top[missing]])
    order = np.argsort(cells, kind="stable")
    cells, vecs = cells[order], vecs[order]
    model = Model(top, vecs, np.searchsorted(cells, np.arange(len(top) + 1)), [])
    rest = x - model.lists[model.assign(x)]
    model.books = [k_means(rest[:, m : m + SEGMENT], CODES) for m in range(0, x.shape[1], SEGMENT)]
    return model


def build(vectors: DataFrame, lists: int | None = None) -> VectorIndex:
    """Index of vectors (chunk_id, embedding); null embeddings are left out. The codes are written in the shared folder, by list."""
    spark = vectors.sparkSession
    ship(spark)
    flat = vectors.where("embedding IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    model = fit(flat, lists)
    kind = flat.schema["chunk_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            at = model.assign(x)
            codes, err = model.encode(x, at)
            away = np.sqrt(((x - model.lists[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array(away)], names=["list", "chunk_id", "code", "err", "away"])

    path = fresh_path(spark, "vector-lists")
    coded = flat.mapInArrow(encode, f"list int, chunk_id {kind.simpleString()}, code binary, err double, away double")
    coded.repartition(F.col("list"), F.pmod(F.xxhash64("chunk_id"), F.lit(16))).sortWithinPartitions("list").write.parquet(path)
    codes = spark.read.schema(coded.schema).parquet(path)
    sizes, reach = np.zeros(len(model.lists), np.int64), np.zeros(len(model.lists))
    for r in codes.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():  # a row a list
        sizes[r["list"]], reach[r["list"]] = r.n, r.away
    parts = F.element_at(F.lit((-(-sizes // PART_ROWS)).tolist()), F.col("list") + 1) if sizes.max(initial=0) > PART_ROWS else F.lit(1)
    return VectorIndex(model, codes.withColumn("part", F.pmod(F.xxhash64("chunk_id"), parts).cast("int")), flat, sizes, reach)


def _probed(queries: DataFrame, index: VectorIndex, probes: int | None) -> DataFrame:
    """(query_id, embedding, floor, list, part, base) for every part that a query looks into: its `probes` best lists by centroid, or all whose bound reaches its floor.

    queries: (query_id, embedding, floor); base is the product with the centroid.
    """
    model, sizes, reach = index.model, index.sizes, index.reach
    parts = -(-sizes // PART_ROWS)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                q, floor = _matrix(some.column(1)), some.column(2).to_numpy(zero_copy_only=False)
                base = q @ model.lists.T
                if probes is None:
                    length = np.sqrt((q * q).sum(1))
                    who, to = np.nonzero((base + length[:, None] * reach * (1 + SLACK) + SLACK * length[:, None] >= floor[:, None]) & (sizes > 0))
                else:
                    full = np.where(sizes > 0, base, -np.inf)
                    best = np.argsort(-full, axis=1, kind="stable")[:, :probes]
                    who, to = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                    who, to = who[sizes[to] > 0], to[sizes[to] > 0]
                times = parts[to]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                who, to = np.repeat(who, times), np.repeat(to, times)
                back = pa.array(who)
                yield pa.RecordBatch.from_arrays([some.column(0).take(back), some.column(1).take(back), some.column(2).take(back), pa.array(to, pa.int32()), pa.array(part, pa.int32()), pa.array(base[who, to])], names=["query_id", "embedding", "floor", "list", "part", "base"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "embedding", "floor").mapInArrow(look, f"query_id {kind}, embedding array<double>, floor double, list int, part int, base double")


def _coded(probed: DataFrame, index: VectorIndex, most: int | None) -> DataFrame:
    """(query_id, chunk_id, coded): candidates of each part, the `most` best by code, or all whose bound reaches the floor."""
    model = index.model
    kinds = [probed.schema["query_id"].dataType, index.codes.schema["chunk_id"].dataType]
    types = [to_arrow_type(kinds[0]), to_arrow_type(kinds[1]), pa.float64()]

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        who, to, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if asked.num_rows and held.num_rows:
            q, base, floor = _matrix(asked["embedding"].combine_chunks()), asked["base"].to_numpy(), asked["floor"].to_numpy()
            codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(held.num_rows, -1)
            err, ids = held["err"].to_numpy(), np.array(held["chunk_id"].to_pylist())
            length = np.sqrt((q * q).sum(1))
            for i in range(0, len(q), 64):
                tables = model.tables(q[i : i + 64])
                near = base[i : i + 64, None] + sum(tables[:, m][:, codes[:, m]] for m in range(codes.shape[1]))
                if most is None:
                    reach = near + length[i : i + 64, None] * (err * (1 + SLACK) + SLACK)
                    a, b = np.nonzero(reach >= floor[i : i + 64, None])
                else:
                    least = np.partition(near, max(0, near.shape[1] - most), axis=1)[:, max(0, near.shape[1] - most)]
                    a, b = np.nonzero(near >= least[:, None])
                    order = np.lexsort((ids[b], -near[a, b], a))
                    a, b = a[order], b[order]
                    first = np.arange(len(a)) - np.searchsorted(a, a) < most
                    a, b = a[first], b[first]
                who.append(a + i)
                to.append(b)
                score.append(near[a, b])
        who, to = np.concatenate(who), np.concatenate(to)
        columns = [asked["query_id"].combine_chunks().take(pa.array(who)), held["chunk_id"].combine_chunks().take(pa.array(to)), pa.array(np.concatenate(score))] if len(who) else [pa.array([], t) for t in types]
        return pa.Table.from_arrays(columns, names=["query_id", "chunk_id", "coded"])

    keys = ["list", "part"]
    return met(index.codes, probed, keys, lambda c, q: meet(q, c), f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, coded double")


def _reranked(found: DataFrame, queries: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """The k best of the candidates by their vectors themselves."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    exact = found.join(index.vectors.select("chunk_id", F.col("embedding").alias("v")), "chunk_id").join(q, "query_id").select("query_id", "chunk_id", dot("q", "v").alias("similarity"))
    return top_ranked(exact, "query_id", _order(), k)


def _order() -> list[Column]:
    return [F.col("similarity").desc(), F.col("chunk_id")]


def search(queries: DataFrame, index: VectorIndex, k: int = CANDIDATES, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): the k nearest by inner product, ties to smaller ids (WIN-1, 8).

    A query looks into its `probes` best lists, about probes / root(n) of all
    rows, scores them by their codes and re-ranks the RERANK * k best of them
    by their vectors. With `exact` that gives a floor, the similarity of its
    k-th hit; then every list is looked into whose centroid and reach, and
    every row re-ranked whose code and error, may reach the floor, so nothing
    is missed. Fewer than k rows give what there is; queries without an
    embedding find nothing; a list too long for one task is dealt in parts.
    """
    ship(queries.sparkSession)
    q = queries.where("embedding IS NOT NULL").select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    if not index.sizes.sum():
        return q.select("query_id", F.lit(None).cast(index.codes.schema["chunk_id"].dataType).alias("chunk_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).where(F.lit(False))
    low = F.lit(float("-inf"))
    most = RERANK * k
    coded = _coded(_probed(q.withColumn("floor", low), index, probes), index, most)
    best = top_ranked(coded, "query_id", [F.col("coded").desc(), F.col("chunk_id")], most).select("query_id", "chunk_id")
    hits = _reranked(best, q, index, k)
    if not exact:
        return hits
    floors = hits.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("similarity")).otherwise(low).alias("floor"))
    floored = q.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", low))
    return _reranked(_coded(_probed(floored, index, None), index, None).select("query_id", "chunk_id"), q, index, k)


def save(index: VectorIndex, path: str) -> None:
    """The index as Parquet folders: model, lists, codes and vectors."""
    spark = index.codes.sparkSession
    m = index.model
    rows = [("top", i, 0, v.tolist()) for i, v in enumerate(m.top)] + [("list", i, 0, v.tolist()) for i, v in enumerate(m.lists)] + [("first", i, int(v), []) for i, v in enumerate(m.first)]
    rows += [("book", s, i, v.tolist()) for s, book in enumerate(m.books) for i, v in enumerate(book)]
    spark.createDataFrame(rows, "kind string, nth int, at int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    spark.createDataFrame([(i, int(n), float(r)) for i, (n, r) in enumerate(zip(index.sizes, index.reach, strict=True))], "list int, n long, reach double").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    index.codes.write.mode("overwrite").parquet(f"{path}/codes")
    index.vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def load(spark: SparkSession, path: str) -> VectorIndex:
    """What save() wrote."""
    of: dict[str, list] = {"top": [], "list": [], "first": [], "book": []}
    for r in spark.read.parquet(f"{path}/model").orderBy("kind", "nth", "at").collect():
        of[r.kind].append((r.nth, r.at, r.vector))
    books: dict[int, list] = {}
    for s, _, v in of["book"]:
        books.setdefault(s, []).append(v)
    model = Model(np.array([v for *_, v in of["top"]]), np.array([v for *_, v in of["list"]]), np.array([at for _, at, _ in of["first"]]), [np.array(books[s]) for s in sorted(books)])
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    return VectorIndex(model, spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"), np.array([r.n for r in lists]), np.array([r.reach for r in lists]))
