"""SimHash near-dedup: fingerprints, pigeonring candidates, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, pack, text_bytes, unpack, with_batches
from .simhash_fp import fingerprint

MOST_BITS = 4
#: Segment widths; one more than the bits that may differ, so the first of a chain must be equal.
WIDTHS = (13, 13, 13, 13, 12)
#: Keys with more fingerprints of their own than this are linked through midpoints, not pairs.
HOT_KEY = 1024


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `fingerprint` (long, the 64 bits); a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            yield [pa.array([int.from_bytes(fingerprint(x), "big", signed=True) for x in text_bytes(b.column(0))], type=pa.int64())]

    return with_batches(docs, run, [("fingerprint", "long")], [text])


def _offset(i: int) -> int:
    return 64 - sum(WIDTHS[: i + 1])


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, _offset(i)).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def chain_budgets(most: int = MOST_BITS, parts: int = len(WIDTHS)) -> list[int]:
    """Differences that the first 1, 2, ... segments of a chain may have: their share of `most`, rounded down."""
    return [most * n // parts for n in range(1, parts + 1)]


def own_keys(fp: Column) -> Column:
    """array<long>: the fingerprint's own key at each start of the ring."""
    return F.array(*[F.shiftleft(_segment(fp, i), 13).bitwiseOR(_segment(fp, (i + 1) % len(WIDTHS))).bitwiseOR(F.lit(i << 40)) for i in range(len(WIDTHS))])


def chain_keys(fp: Column) -> Column:
    """array<struct<start, key, own>>: for each start of the ring, the segment there and the next, and each key that differs from it by one bit of the next.

    By the pigeonring principle, fingerprints that differ in `most` bits or
    fewer have a start from which every prefix of segments keeps to its
    budget; here the first may differ by 0 and the first two by 1. So a key
    of one side is the other side's own key.
    """
    out = []
    for i in range(len(WIDTHS)):
        j = (i + 1) % len(WIDTHS)
        key = F.shiftleft(_segment(fp, i), 13).bitwiseOR(_segment(fp, j)).bitwiseOR(F.lit(i << 40))
        out.append(F.struct(F.lit(i).alias("start"), key.alias("key"), F.lit(True).alias("own")))
        out += [F.struct(F.lit(i).alias("start"), key.bitwiseXOR(F.lit(1 << b)).alias("key"), F.lit(False).alias("own")) for b in range(WIDTHS[j])]
    return F.array(*out)


def chain_holds(a: Column, b: Column, start: int) -> Column:
    """The chain from `start` keeps to its budgets after every segment; cheap tests before the full Hamming distance."""
    differ, holds, total = a.bitwiseXOR(b), None, None
    for n, most in enumerate(chain_budgets()):
        bits = F.bit_count(_segment(differ, (start + n) % len(WIDTHS)))
        total = bits if total is None else total + bits
        holds = (total <= most) if holds is None else holds & (total <= most)
    return holds


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a > b: pairs of distinct fingerprints (column fp) at MOST_BITS or fewer, or a chain of such links between them.

    Below HOT_KEY, fingerprints meet by chain key, pass the chain's budgets
    and then the full distance, all within the join. A key with more
    fingerprints goes another exact way that makes no pairs: two fingerprints
    differ by 4 bits or fewer if and only if some value differs from both by
    2 or fewer, so each emits the values around it and is linked to the
    smallest that shares one (a linear count; at most 2,081 share a value).
    """
    keyed = fps.select("fp", F.explode(chain_keys(F.col("fp"))).alias("k")).select("fp", "k.start", "k.key", "k.own")
    hot = fps.select(F.explode(own_keys(F.col("fp"))).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY).select("key")
    hot = cut(hot, "simhash-hot")
    if hot.isEmpty():
        cool, close = keyed, None
    else:
        cool = keyed.join(hot, "key", "left_anti")
        crowd = keyed.join(hot, "key", "left_semi").select("fp").distinct()
        masks = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
        signed = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in masks])
        around = crowd.select("fp", F.explode(F.transform(signed, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
        close = around.withColumn("low", F.min("fp").over(Window.partitionBy("mid"))).where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    own = cool.where("own").select(F.col("fp").alias("a"), "key", "start")
    other = cool.select(F.col("fp").alias("b"), "key", F.col("own").alias("b_own"))
    a, b = F.col("a"), F.col("b")
    chain = F.lit(False)
    for i in range(len(WIDTHS)):
        chain = chain | ((F.col("start") == i) & chain_holds(a, b, i))
    # A pair with equal keys meets once (a > b); one that differs by a bit meets from either side.
    found = own.hint("merge").alias("x").join(other.alias("y"), (F.col("x.key") == F.col("y.key")) & ((b < a) | ~F.col("b_own") & (b != a)) & chain & (F.bit_count(a.bitwiseXOR(b)) <= MOST_BITS)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return found if close is None else found.union(close.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def near_duplicates(docs: DataFrame, carry: list[str] | None = None, root: str | None = None) -> DataFrame:
    """docs with `fingerprint` (long) and `component_id` (the smallest doc_id reachable, itself included).

    Documents link when their fingerprints differ in MOST_BITS bits or fewer;
    texts without words have fingerprint 0 and link like any other. Equal
    fingerprints are grouped first, so that copies make no pairs. Tables of
    fingerprints grow with docs, so they are merged, never broadcast. A null
    doc_id takes part; its rows get the smallest doc_id of their component,
    null if there is none. Rows that repeat a doc_id are compared by their own
    texts. Columns pass through (only those of `carry`, if it is given); those
    named like an added one are replaced. `root` names a further column, the
    component's smallest fingerprint, which tells components apart where a
    doc_id repeats. Very long texts are whole; an empty table gives an empty one.
    """
    names = docs.columns if carry is None else carry
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))
    marked = fingerprints(docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("text_in")), "text_in").select("row", "id", F.col("fingerprint").alias("fp"))
    marked = cut(marked, "simhash-docs")  # fingerprints are computed once
    fps = cut(marked.select("fp", "id").groupBy("fp").agg(F.min("id").alias("low")), "simhash-fps")
    comps = components(links(fps.select("fp")), "simhash-links")
    by_fp = fps.join(comps.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = by_fp.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = by_fp.select("fp", "root").join(lowest.hint("merge"), "root").select("fp", "component_id", "root")
    return unpack(marked.join(classes.hint("merge"), "fp"), names, {"fingerprint": F.col("fp"), "component_id": F.col("component_id")} | ({root: F.col("root")} if root else {}))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one whose doc_id is the component's smallest.

    Of rows that repeat it, the one with the smallest hash of the text stays,
    and of rows equal in both, the first by all columns written as JSON. Null
    doc_ids stay only in groups without any other; null and empty texts are
    one group; an empty table gives an empty one.

    Components are found on (doc_id, hash of the text) alone; whole rows are
    shuffled once, to meet the keys that stay.
    """
    names, th = docs.columns, F.xxhash64(F.coalesce("text", F.lit("")))
    slim = docs.select("doc_id", "text", th.alias("th"))
    marked = near_duplicates(slim, carry=["doc_id", "th"], root="root").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = marked.groupBy("root").agg(F.min("th").alias("stay_th"), F.first("component_id").alias("id")).select(F.coalesce("id", F.lit(0)).alias("stay_id"), F.col("id").isNull().alias("stay_null"), "stay_th")
    keyed = pack(docs, [F.coalesce("doc_id", F.lit(0)).alias("stay_id"), F.col("doc_id").isNull().alias("stay_null"), th.alias("stay_th")])
    keys = ["stay_id", "stay_null", "stay_th"]
    order = F.to_json(F.struct(*[F.col("row")[c].alias(f"c{i}") for i, c in enumerate(names) if c.lower() != "text"]))
    one = keyed.join(first.distinct().hint("merge"), keys, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("nth = 1")
    return one.select(*[F.col("row")[c].alias(c) for c in names])
