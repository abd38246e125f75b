"""Divergence of sources: pair tasks merge the sorted (term id, count) arrays of two groups' terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, cut, forget, map_arrow, small_batches, text_bytes

#: Shares are counted in billionths.
UNIT = 1_000_000_000
#: Bytes of a text that are no part of a term become blanks, A-Z become small letters, bytes from 0x80 on stay.
TERM_BYTES = bytes(c + 32 if chr(c) in UPPER else c if c >= 0x7B and not 0x7B <= c <= 0x7F or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 300_000
#: Rows (group, term) that one bucket of terms has on average, and sources of one side of a pair task.
BUCKET_ROWS, SIDE = 1 << 18, 8


def share(count: np.ndarray | int, total: np.ndarray | int, kinds: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kinds)), exact in 64 bits: three digits of base 1,000, one after another."""
    left, by = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * np.asarray(kinds, np.int64)
    out = left // by
    left = left % by
    for _ in range(3):
        out, left = out * 1000 + left * 1000 // by, left * 1000 % by
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so the square fits."""
    return (p - q) * (p - q) // (p + q)


def merge(a: tuple, b: tuple, kinds: int) -> tuple[int, int]:
    """Price over all terms of two groups' sorted (ids, counts) arrays that either has, and the number of those terms.

    a, b: (ids, counts, total of the group). The shorter array gallops through
    the longer one: a binary search for each id; terms that one side lacks
    have a count of zero there.
    """
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids, counts, total), (ids2, counts2, total2) = a, b
    at = np.searchsorted(ids2, ids)
    both = np.zeros(len(ids), bool)
    inside = at < len(ids2)
    both[inside] = ids2[at[inside]] == ids[inside]
    met = np.zeros(len(ids2), bool)
    met[at[both]] = True
    p, p2 = share(counts, total, kinds), share(counts2, total2, kinds)
    none, none2 = share(0, total, kinds), share(0, total2, kinds)
    value = price(p[both], p2[at[both]]).sum() + price(p[~both], none2).sum() + price(none, p2[~met]).sum()
    return int(value), len(ids) + len(ids2) - int(both.sum())


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, in_docs): occurrences and rows of documents for each term of each group; counted in the tasks first."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in counts.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    part = terms[i : i + 50_000]
                    columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string())]
                    columns += [pa.array([n[x] for x in part], pa.int64()), pa.array([seen[x] for x in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "in_docs"])
            counts.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), strict=True):
                terms = text.translate(TERM_BYTES).split()
                if terms:
                    n, seen = counts.setdefault((lang, source), (Counter(), Counter()))
                    of_text = Counter(terms)
                    n.update(of_text)
                    seen.update(of_text.keys())
            if sum(len(n) for n, _ in counts.values()) > HELD_TERMS:
                yield from handed()
        yield from handed()

    parts = map_arrow(docs, run, "lang string, source string, term string, n long, in_docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("in_docs").alias("in_docs"))


def _share(count: str, total: str, kinds: str) -> Column:
    """share() as an expression, in decimals."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({total} + 2 * {kinds} as decimal(20,0))")


_PRICE = "((p - q) * (p - q)) div (p + q)"


def audit_sources(docs: DataFrame, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's words are from the other sources of its language, and by which terms.

    Terms are stretches of ASCII letters and non-ASCII signs, A-Z lower-cased;
    a language keeps those that `min_docs` of its documents or more hold. A
    kept term's share in a group is 1 + floor(10**9 * (n + 2) / (N + 2 V)), N
    the group's occurrences of kept terms and V the language's kept terms; the
    price of two shares is floor((p - q)**2 / (p + q)). Part `pair` has for
    each group every other source of its language with the prices summed over
    all kept terms; part `term` the `top_terms` terms of the group that it
    uses more than its language does. Ranks go by value, then item in UTF-8.

    Counts combine within tasks and then by (lang, source, term). Terms are
    dealt to buckets by hash, of about 2**18 (group, term) rows whatever the
    corpus holds, and numbered within them. A pair task is one bucket and two
    blocks of eight sources; it merges the arrays of each unordered pair once,
    for both directions. Terms that both lack are priced once for all.

    Null text, lang and source count as ''. Empty texts have no terms, but
    their group appears. Rows that repeat a doc_id are documents each; doc_id
    is not read. Texts are whole, however long. A language without kept terms
    has pairs of value 0; ties go by item. An empty table gives an empty one;
    extra columns, whatever their names, are not read.
    """
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = cut(term_counts(plain), "terms")
    buckets = counts.count() // BUCKET_ROWS + 1
    of_term = Window.partitionBy("lang", "bucket", "term")
    dealt = counts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("lang", "bucket")
    wide = dealt.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("lang_docs", F.sum("in_docs").over(of_term)).where(F.col("lang_docs") >= min_docs)
    numbered = wide.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "bucket").orderBy("term")))
    kept = cut(numbered.select("lang", "bucket", "source", "term", "id", "n", "lang_n"), "kept-terms")
    forget(counts)

    # A row per group, with all that is summed over terms.
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_bucket = kept.groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.max("id").cast("long").alias("kinds"))
    langs = by_bucket.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("kinds").alias("kinds"))
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "kinds"])
    groups = groups.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / SIDE).cast("int"))
    groups = cut(groups.withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1), "groups")

    # Every group has an array in every bucket of its language, so that what its partners alone have is priced too.
    arrays = kept.groupBy("lang", "bucket", "source").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms"))
    everywhere = groups.join(by_bucket.select("lang", "bucket"), "lang").join(arrays, ["lang", "bucket", "source"], "left")
    everywhere = everywhere.select("lang", "bucket", "source", "total", "kinds", "block", "blocks", F.coalesce("terms.id", F.array().cast("array<int>")).alias("ids"), F.coalesce("terms.n", F.array().cast("array<long>")).alias("ns"))
    task = ["lang", "bucket", "one_block", "two_block"]
    left, right = _both_sides(everywhere)
    merged = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(_pair_task, "lang string, one string, two string, value long, met long")
    merged = merged.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))

    one, two = _both_sides(groups)
    one = one.select("lang", "one_block", "two_block", F.col("source").alias("one"), F.col("total").alias("p_total"), "kinds")
    two = two.select("lang", "one_block", "two_block", F.col("source").alias("two"), F.col("total").alias("q_total"))
    pairs = one.join(two, ["lang", "one_block", "two_block"]).where("one < two").join(merged, ["lang", "one", "two"], "left").fillna(0, ["value", "met"])
    some = pairs.where("kinds > 0").withColumns({"p": _share("0", "p_total", "kinds"), "q": _share("0", "q_total", "kinds")})
    some = some.select("lang", "one", "two", F.expr(f"value + (kinds - met) * ({_PRICE})").alias("value"))
    valued = some.unionByName(pairs.where("kinds = 0").select("lang", "one", "two", F.lit(0).cast("long").alias("value")))
    ways = valued.select("lang", "value", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("way"))
    of_pairs = ways.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    shares = kept.join(groups.select("lang", "source", "total", "lang_total", "kinds"), ["lang", "source"]).withColumns({"p": _share("n", "total", "kinds"), "q": _share("lang_n", "lang_total", "kinds")})
    of_terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_PRICE).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = of_terms.withColumn("rank", place).where(F.col("rank") <= top_terms)
    return of_pairs.withColumn("rank", place).unionByName(best)


def _both_sides(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of groups for every pair task (one_block <= two_block) that they are a side of: as the first and as the second."""
    first = groups.withColumn("two_block", F.explode(F.sequence("block", F.col("blocks") - 1))).withColumnRenamed("block", "one_block")
    second = groups.withColumn("one_block", F.explode(F.sequence(F.lit(0), "block"))).withColumnRenamed("block", "two_block")
    return first, second.toDF(*second.columns)


def _side(t: pa.Table) -> list[tuple[str, tuple, int]]:
    """(source, its arrays and total, kept terms of the language) of each row."""
    ids, ns = t.column("ids").combine_chunks(), t.column("ns").combine_chunks()
    names, total, kinds = (t.column(c).to_pylist() for c in ("source", "total", "kinds"))
    return [(names[i], (np.asarray(ids[i].values), np.asarray(ns[i].values), total[i]), kinds[i]) for i in range(t.num_rows)]


def _pair_task(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each unordered pair of a source on the left and one on the right (blocks are in the order of names, equal ones pair within)."""
    lang, second = left.column("lang")[0].as_py(), _side(right)
    out = [(lang, name, name2, *merge(a, b, kinds)) for name, a, kinds in _side(left) for name2, b, _ in second if name < name2]
    kind = [pa.string()] * 3 + [pa.int64()] * 2
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kind, strict=True)], names=["lang", "one", "two", "value", "met"])
