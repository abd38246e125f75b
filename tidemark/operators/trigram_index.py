"""An inverted index of trigrams: texts that hold a query or have a stretch similar to it, looked for by the rarest of its trigrams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import arrow
from ..shared import written
from ..ship import ship
from .blocks import CANDIDATES, QUERY_BLOCK, TASKS, TEXT_BLOCK, blocks_of, in_blocks, met, top_ranked

#: Posting lists of one trigram that meet a query in one place; a commoner trigram's lists are dealt to several.
LISTS_PER_SALT = 256
#: Places of the steps in which stretches are bounded, first for all queries, then for those left.
STEPS = 48, 12
#: Texts with more trigrams go without bounds.
MOST_GRAMS = 4096
#: Queries that every text meets without an index, so many in one place; more of them go through the lists.
SCANNED, SCAN_BLOCK = 2048, 256
#: Entries of a block's table of trigrams and queries; a larger one is not laid out.
TABLE = 1 << 25


@dataclass
class TrigramIndex:
    """postings: (gram, salt, ids): the chunks of one batch that hold a trigram; frequency: (gram, n, salts)."""

    postings: DataFrame
    frequency: DataFrame
    chunks: DataFrame


def build(chunks: DataFrame) -> TrigramIndex:
    """Index of chunks (chunk_id, search_text), written in the shared folder; null texts are left out.

    A batch of TEXT_BLOCK chunks gives one list for each of its trigrams, so a
    common trigram has many short lists, which are dealt to salts.
    """
    ship(chunks.sparkSession)
    texts = chunks.where("search_text IS NOT NULL").select("chunk_id", "search_text")
    kind = texts.schema["chunk_id"].dataType

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXT_BLOCK):
                some = b.slice(at, TEXT_BLOCK)
                holders: dict[str, list[int]] = defaultdict(list)
                for i, t in enumerate(some.column(1).to_pylist()):
                    for g in set(arrow.trigrams(t)):
                        holders[g].append(i)
                ends = np.cumsum([0, *map(len, holders.values())])
                ids = some.column(0).take(pa.array([i for x in holders.values() for i in x], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(holders), pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["gram", "ids"])

    postings = written(texts.mapInArrow(lists, f"gram string, ids array<{kind.simpleString()}>"), "postings")
    salts = F.ceil(F.count("*") / F.lit(LISTS_PER_SALT)).cast("int")
    frequency = written(postings.groupBy("gram").agg(F.sum(F.size("ids")).alias("n"), salts.alias("salts")), "trigrams")
    # A salt by what the list holds: the same whenever it is read.
    dealt = postings.join(frequency.select("gram", "salts"), "gram").select("gram", F.pmod(F.xxhash64("ids"), F.col("salts")).cast("int").alias("salt"), "ids")
    return TrigramIndex(dealt, frequency, texts)


def _query_grams(queries: DataFrame, kind: str) -> DataFrame:
    """(query_id, n, gram): the distinct trigrams of each query and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [list(dict.fromkeys(arrow.trigrams(t))) for t in b.column(1).to_pylist()]
            back = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(back), pa.array([len(g) for g in grams for _ in g], pa.int32()), pa.array([x for g in grams for x in g], pa.string())], names=["query_id", "n", "gram"])

    return queries.select("query_id", "query_text").mapInArrow(run, f"query_id {kind}, n int, gram string")


def candidates(queries: DataFrame, index: TrigramIndex, threshold: float) -> DataFrame:
    """(query_id, chunk_id, gate): chunks that may be similar to a query or (gate) hold it; queries without a trigram inside a word are not looked up.

    A stretch as similar as the threshold holds ceil(threshold * n) of a
    query's n distinct trigrams, so also one of the rarest n - that + 1; a text
    that holds the query holds the rarest of its trigrams without a border of
    a word. Only the lists of these are read.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    grams = _query_grams(queries, kind).join(index.frequency.select("gram", F.col("n").alias("held"), "salts"), "gram", "left").fillna({"held": 0})
    w = Window.partitionBy("query_id").orderBy("held", "gram")
    inner = F.instr("gram", " ") == 0
    placed = grams.withColumn("place", F.row_number().over(w)).withColumn("inner_place", F.min(F.when(inner, F.struct("held", "gram"))).over(Window.partitionBy("query_id")))
    need = F.ceil(F.lit(float(threshold)) * F.col("n") - F.lit(1e-9))
    prefix, gate = F.col("place") <= F.col("n") - need + 1, F.coalesce(F.col("gram") == F.col("inner_place.gram"), F.lit(False))
    asked = placed.where((prefix | gate) & F.col("salts").isNotNull()).select("query_id", "gram", gate.alias("gate"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return asked.join(index.postings, ["gram", "salt"]).select("query_id", "gate", F.explode("ids").alias("chunk_id")).groupBy("query_id", "chunk_id").agg(F.max("gate").alias("gate"))


class Needles:
    """A block of queries, to be looked for in texts."""

    def __init__(self, texts: list[str], threshold: float):
        self.texts, self.threshold = [t.lower() for t in texts], threshold
        self.grams = [set(arrow.trigrams(t)) for t in self.texts]
        self.size = np.array([len(g) for g in self.grams], int)
        self.inner = np.array([sum(" " not in x for x in g) for g in self.grams], int)  # those that a text has which holds the query
        self.need = np.ceil(threshold * self.size - 1e-9).astype(int)
        self.known = {g: i for i, g in enumerate(dict.fromkeys(g for grams in self.grams for g in grams))}
        self.flat = np.array([self.known[g] for grams in self.grams for g in grams], int)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.place = np.full(len(self.known) + 1, -1)  # of the block's trigrams in the text at hand
        self.table: np.ndarray | None = None
        if (len(self.known) + 1) * len(texts) <= TABLE:
            self.table = np.zeros((len(self.known) + 1, len(texts)), np.float32)  # the last row: any other trigram
            self.table[self.flat, np.repeat(np.arange(len(texts)), self.size)] = 1

    def found(self, text: str, asked: list[int], gated: list[bool]) -> Iterator[tuple[int, bool, float]]:
        """(query, whether the text holds it, its similarity) of those asked for that count."""
        text, asked = text.lower(), np.array(asked, int)
        grams = Grams(arrow.trigrams(text))
        has = self._has(grams, asked)
        common = has.sum(0)
        exact = {i for i in asked[np.array(gated, bool) & (common >= self.inner[asked])].tolist() if self.texts[i] in text}
        near = set(asked.tolist()) if self.threshold <= 0 else set(self._may_be_near(grams, asked, has, common).tolist())
        for i in sorted(exact | near):
            score = grams.similarity(self.grams[i]) if self.grams[i] else 0.0
            if i in exact or score >= self.threshold:
                yield i, i in exact, score

    def _may_be_near(self, grams: Grams, asked: np.ndarray, has: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Those asked for that a stretch may be similar to: no other can reach the threshold t.

        A stretch that shares c of a query's n distinct trigrams and has u
        others is as similar as t where c - t u >= t n. One that begins in one
        step of places and ends in another shares no more than both steps and
        all between them, and has at least the others that lie between them.
        """
        some = (common >= self.need[asked]) & (self.need[asked] > 0)
        asked, has = asked[some], has[:, some]
        if len(grams.at) > MOST_GRAMS:
            return asked
        for step in STEPS:
            if not len(asked):
                break
            shared, others = grams.in_steps(step, has)
            shared[1:, :-1] -= self.threshold * others[:-1, 1:]
            left = shared.max((0, 1)) >= self.threshold * self.size[asked] - 1e-3
            asked, has = asked[left], has[:, left]
        return asked

    def _has(self, grams: Grams, asked: np.ndarray) -> np.ndarray:
        """(kinds, queries): 1 where a query has that trigram of the text."""
        if self.table is not None:
            rows = self.table[[self.known.get(g, len(self.known)) for g in grams.kinds]]
            return rows if len(asked) == len(self.texts) and (asked == np.arange(len(asked))).all() else rows[:, asked]
        known = [(self.known[g], i) for g, i in grams.kinds.items() if g in self.known]
        has = np.zeros((len(grams.kinds), len(asked)), np.float32)
        if known and len(asked):
            here = np.array(known)
            self.place[here[:, 0]] = here[:, 1]
            size = self.size[asked]
            row = np.repeat(np.arange(len(asked)), size)
            at = self.place[self.flat[np.arange(len(row)) + np.repeat(self.begin[asked] - (np.cumsum(size) - size), size)]]
            has[at[at >= 0], row[at >= 0]] = 1
            self.place[here[:, 0]] = -1
        return has


class Grams:
    """A text's trigrams in order."""

    def __init__(self, grams: list[str]):
        self.grams = grams
        self.kinds = {g: i for i, g in enumerate(dict.fromkeys(grams))}
        self.at = np.array([self.kinds[g] for g in grams], int)
        self.before = np.full(len(grams), -1)  # the place of the same one before
        order = np.argsort(self.at, kind="stable")
        same = self.at[order][1:] == self.at[order][:-1]
        self.before[order[1:][same]] = order[:-1][same]
        self.distinct: np.ndarray | None = None

    def first_in_stretch(self, starts: np.ndarray) -> np.ndarray:
        """(starts, places): whether a place is the first of its kind in a stretch from that start on."""
        starts = starts[:, None]
        return (self.before[None] < starts) & (np.arange(len(self.at))[None] >= starts)

    def in_steps(self, step: int, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last step, first step, queries): distinct trigrams from the first to the last step that each query has, and that it has not; has: (kinds, queries)."""
        n = -(-len(self.at) // step)
        new = np.zeros((n, n * step), np.float32)
        new[:, : len(self.at)] = self.first_in_stretch(np.arange(0, len(self.at), step))
        hits = np.zeros((n * step, has.shape[1]), np.float32)
        hits[: len(self.at)] = has[self.at]
        by = new.reshape(n, n, step).transpose(1, 0, 2)
        shared = np.cumsum(by @ hits.reshape(n, step, -1), axis=0)
        return shared, np.cumsum(by.sum(2), axis=0)[:, :, None] - shared

    def similarity(self, query: set[str]) -> float:
        """Greatest share of common trigrams over all stretches, as arrow.similarity_within has it; best stretches begin and end with a trigram of the query."""
        if len(self.at) > MOST_GRAMS:
            return arrow.similarity_within(query, self.grams)
        wanted = np.zeros(len(self.kinds), bool)
        wanted[[self.kinds[g] for g in query if g in self.kinds]] = True
        hits = np.flatnonzero(wanted[self.at])
        if not len(hits):
            return 0.0
        if self.distinct is None:
            self.distinct = np.cumsum(self.first_in_stretch(np.arange(len(self.at))), axis=1, dtype=np.int16)
        shared = np.cumsum((self.before[hits][None] < hits[:, None]) & (hits[None] >= hits[:, None]), axis=1, dtype=np.int16)
        return float((shared / (len(query) + self.distinct[np.ix_(hits, hits)] - shared)).max())


def _looked_through(needles: Needles, asked: pa.Table, held: list[tuple]) -> list[tuple]:
    """(query_id, chunk_id, exact, lexical) of held: (chunk_id, text, places of queries, whether each may be held)."""
    ids = asked["query_id"].to_pylist()
    return [(ids[i], c, exact, score) for c, t, some, gated in held for i, exact, score in needles.found(t, some, gated)]


def _kinds(queries: DataFrame, chunks: DataFrame) -> tuple[list[pa.DataType], str]:
    """Arrow types of the columns of pairs, and their schema."""
    kinds = [queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType]
    return [to_arrow_type(kinds[0]), to_arrow_type(kinds[1]), pa.bool_(), pa.float64()], f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, exact boolean, lexical double"


def _pairs(out: list[tuple], types: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], names=["query_id", "chunk_id", "exact", "lexical"])


def scanned_pairs(queries: DataFrame, chunks: DataFrame, threshold: float) -> DataFrame:
    """What lexical_pairs gives, without an index: every text meets every block of queries, whose bounds leave few pairs to compare. Null texts are left out."""
    ship(chunks.sparkSession)
    types, schema = _kinds(queries, chunks)

    def look(asked: pa.Table, held: pa.Table) -> pa.Table:
        rows = list(zip(held["chunk_id"].to_pylist(), held["search_text"].to_pylist(), strict=True))
        out = []
        for at in range(0, asked.num_rows if rows else 0, SCAN_BLOCK):
            some = asked.slice(at, SCAN_BLOCK)
            every = list(range(some.num_rows))
            out += _looked_through(Needles(some["query_text"].to_pylist(), threshold), some, [(c, t, every, [True] * len(every)) for c, t in rows])
        return _pairs(out, types)

    texts = chunks.where("search_text IS NOT NULL").select("chunk_id", "search_text")
    return in_blocks(queries.where("query_text IS NOT NULL").select("query_id", "query_text"), texts, TEXT_BLOCK, look, schema)


def lexical_pairs(queries: DataFrame, index: TrigramIndex, threshold: float) -> DataFrame:
    """(query_id, chunk_id, exact, lexical) of every chunk that holds a query or is as similar to it.

    Candidates come from the index; a chunk's text meets the block of queries
    that it is a candidate of. Queries that no list can give (no trigram inside
    a word, or a threshold of zero) meet all chunks in blocks.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    types, schema = _kinds(queries, index.chunks)
    q = queries.where("query_text IS NOT NULL").select("query_id", "query_text")
    ship(q.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inside = [threshold > 0 and any(" " not in g for g in arrow.trigrams(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(inside, pa.bool_())], names=["query_id", "query_text", "listed"])

    q = q.mapInArrow(mark, f"query_id {kind}, query_text string, listed boolean")

    def look(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return _pairs([], types)
        place = {x: i for i, x in enumerate(asked["query_id"].to_pylist())}
        rows = zip(held["chunk_id"].to_pylist(), held["search_text"].to_pylist(), held["asked"].to_pylist(), strict=True)
        return _pairs(_looked_through(Needles(asked["query_text"].to_pylist(), threshold), asked, [(c, t, [place[x["query_id"]] for x in some], [x["gate"] for x in some]) for c, t, some in rows]), types)

    known = q.where("listed")
    blocks, slots = blocks_of(q, QUERY_BLOCK), blocks_of(index.chunks, TEXT_BLOCK, 8 * TASKS)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    slot = F.pmod(F.xxhash64("chunk_id"), F.lit(slots)).cast("int").alias("slot")
    found = written(candidates(known, index, threshold).select("query_id", "chunk_id", "gate", block, slot), "candidates")
    of_chunk = found.groupBy("slot", "block", "chunk_id").agg(F.collect_list(F.struct("query_id", "gate")).alias("asked"))  # a block's queries at most
    held = of_chunk.join(index.chunks, "chunk_id").select("slot", "block", "chunk_id", "search_text", "asked")
    texts = found.select("slot", "block", "query_id").distinct().join(known.select("query_id", "query_text"), "query_id").select("slot", "block", "query_id", "query_text").toDF("slot", "block", "query_id", "query_text")
    pairs = met(held, texts, ["slot", "block"], look, schema)
    rest = q.where("NOT listed").drop("listed")
    return pairs if rest.isEmpty() else pairs.union(scanned_pairs(rest, index.chunks, threshold))


def lexical_rank(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES, threshold: float = 0.6, exact_first: bool = True, index: TrigramIndex | None = None) -> DataFrame:
    """(query_id, chunk_id, exact, lexical, rank): chunks that hold the query or are trigram-similar to it (WIN-2, 9).

    queries: (query_id, query_text), chunks: (chunk_id, search_text), or an
    index of them that is there. SCANNED queries at most meet all texts; for
    more of them, or where one is given, an index says which. Every chunk counts that holds the query,
    whatever the case of its letters, or has a stretch whose similarity reaches
    the threshold; exact substrings rank first, then by trigram similarity.
    Empty and null queries and null texts count for nothing.
    """
    order = [F.col("exact").desc()] * exact_first + [F.col("lexical").desc(), F.col("chunk_id")]
    asked = queries.where("query_text <> ''")
    few = index is None and asked.limit(SCANNED + 1).count() <= SCANNED
    pairs = scanned_pairs(asked, chunks, threshold) if few else lexical_pairs(asked, index or build(chunks), threshold)
    return top_ranked(pairs, "query_id", order, k)
