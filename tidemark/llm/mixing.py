"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, pack, unpack, whole_text

#: Signs that are rare in prose; their share lowers a document's quality weight.
SIGNS = "!#$%&*|<>{}[]\\^~=@_+"


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: 1 less five times the share of SIGNS among the code points."""
    n = F.char_length(text)
    signs = n - F.char_length(F.translate(text, SIGNS, ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * signs / n))


#: Ranges of keys: so many to each doubling of -ln(key), over so many doublings from 2^FIRST_DOUBLING on.
PER_DOUBLING, DOUBLINGS, FIRST_DOUBLING = 146, 28, -20
BUCKETS = PER_DOUBLING * DOUBLINGS


def key_bucket(u: Column, w: Column) -> Column:
    """Range of the key u^(1/w), the highest keys in the first.

    -ln(u) / w is exponential with rate w, so no doubling of it holds more
    than a quarter of the keys and no range more than a few thousandths,
    whatever the weights are.
    """
    place = F.floor((F.log2(-F.log(u) / w) - FIRST_DOUBLING) * PER_DOUBLING)
    return F.greatest(F.lit(0), F.least(place, F.lit(BUCKETS - 1))).cast("int")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", quality=quality_weight, keep: list[str] | None = None) -> DataFrame:
    """Adds to every document: size, source_size, target, taken (words the mix takes) and copies.

    Sizes are words. Sources in code-point order, null last, weigh `weights`
    in turn; targets share all words by weight, stop at `most` times their
    source's size, and the excess is shared again by weight (solved in closed
    form: one level for all uncapped sources). A source is taken in whole as
    often as its target holds it (complete epochs); the rest goes by keys
    u^(1/w) in falling order, w the document's quality weight and u from a
    hash of doc_id, until the budget is met; the document at the boundary is
    taken if more than half of it fits. So copies <= `most`.

    Null texts have size 0; documents of size 0 get copies like any other and
    take no words. A null doc_id hashes as an empty string. Rows that repeat a
    doc_id are rows of their own. Columns pass through (only those of `keep`, if it is given); those named like
    an added one are replaced. Reruns agree.

    The order within a source is never sorted as a whole: keys fall into
    BUCKETS ranges, the sums of which are prefix-summed in a small table; rows
    meet it by (source, bucket), so that a source with a third of all rows is
    dealt to as many groups, and only a bucket's own rows are sorted. Very
    long texts are measured whole; an empty table gives an empty one.
    """
    names = docs.columns if keep is None else keep
    text = whole_text()
    # "0" and the source, or "1" for null: code-point order, null last.
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *[F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("src"), F.col("doc_id").alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), quality(text).alias("w"), ((bits + 0.5) / float(2**52)).alias("u"), F.xxhash64(text).alias("th")])
    keyed = sized.withColumn("key", F.pow("u", F.lit(1.0) / F.col("w"))).withColumn("bucket", key_bucket(F.col("u"), F.col("w")))
    if keep is not None:  # narrow rows: texts are read once
        keyed = cut(keyed, "mix-keys")
    slim = keyed.select("src", "bucket", "size")
    sums = slim.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    plan = source_targets(sums.groupBy("src").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    falling = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    table = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(falling), F.lit(0))).join(plan, "src").select("src", "bucket", "before", "source_size", "target", "epochs", "budget")
    met = keyed.join(table, ["src", "bucket"])
    own = Window.partitionBy("src", "bucket").orderBy(F.col("key").desc(), F.col("id").asc_nulls_last(), "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    placed = met.withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    extra = ((F.col("budget") - F.col("upto")) * 2 > F.col("size")).cast("long")
    done = placed.withColumn("copies", F.col("epochs") + F.when(F.col("budget") > 0, extra).otherwise(0))
    return unpack(done, names, {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("copies") * F.col("size"), "copies": F.col("copies")})


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(src, source_size, target, epochs, budget) from one row per source (the table of sources is a catalogue, not data)."""
    ordered = Window.orderBy("src")
    by_ratio = Window.orderBy("ratio", "src")
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(ordered) - 1) % len(weights))).withColumn("most", F.col("source_size") * float(most))
    t = t.withColumn("ratio", F.col("most") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_weight", F.sum("weight").over(everything))
    # With the sources of smaller ratio capped, the level for this one and all after it.
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source in that order that its level does not cap sets the level; those before it are capped.
    t = t.withColumn("nth", F.row_number().over(by_ratio)).withColumn("line", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everything))
    t = t.withColumn("target", F.when(F.col("line").isNull() | (F.col("nth") < F.col("line.nth")), F.col("most")).otherwise(F.col("weight") * F.col("line.level")))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    return t.select("src", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    mixed = mix_sources(pack(docs, [F.col("doc_id"), F.col("source"), F.col("text")]), **options)
    taken = mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns])
