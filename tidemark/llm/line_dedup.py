"""Line dedup: lines that many documents share stay in one of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, unpack, whole_text


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents without the lines that `min_docs` documents or more share.

    A line's key is the line without blanks at both ends, A-Z lower-cased. A
    key of at least `min_chars` code points that at least `min_docs` distinct
    doc_id hold loses its lines everywhere but in the largest doc_id. Adds
    `n_lines` (before) and `n_dropped`; `text` holds what stays and `n_chars`,
    where there is one, follows it.

    A null or empty text is one empty line. Rows with a null doc_id count for
    no key and stay as they are. Rows that repeat a doc_id count as one
    document. Extra columns pass through; one named n_lines or n_dropped (in
    any case) is replaced. Very long texts are whole. An empty table gives an
    empty one.

    Only (doc_id, hash of the text, position, 128-bit hash of the key) is
    shuffled per line, never the line. The counts combine on the map side
    (distinct document and key first), so that a line held by a third of all
    documents is no hot group; its join is a plain one that adaptive execution
    splits. Positions that go come back as one array per document.
    """
    names = docs.columns
    text = whole_text()
    lines = (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(F.split(ascii_lower(text), "\n", -1)).alias("pos", "line"))
        .select("doc_id", "th", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    common = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    gone = lines.join(common, ["h1", "h2"]).where("doc_id <> keeper").groupBy(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).agg(F.collect_set("pos").alias("gone"))
    # The text travels once, beside the other columns that stay.
    others = [c for c in names if c.lower() not in ("text", "n_lines", "n_dropped")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("doc_id").alias("key_id"), F.xxhash64(text).alias("key_th"), text.alias("whole"))
    joined = packed.join(gone, (F.col("key_id") == F.col("gone_id")) & (F.col("key_th") == F.col("gone_th")), "left")
    cut_up = joined.select("row", "whole", "gone", F.split("whole", "\n", -1).alias("all_lines"))
    counted = cut_up.select("row", "whole", "gone", "all_lines", F.size("all_lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    stay = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("gone"))
    done = counted.select("row", "n_lines", F.when(F.col("gone").isNull(), 0).otherwise(F.col("n_dropped")).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("all_lines", i)), "\n")).alias("kept"))
    added = {"text": F.col("kept"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")}
    if "n_chars" in names:
        added["n_chars"] = F.char_length("kept").cast("long")
    return unpack(done, names, added)
