"""Results of requests over landed pages: refresh hop, AMP page and publisher reply as joins by address (SRC-3..5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import pages as P
from ..functions import text
from ..shared import written
from ..sources.files import robots_allowed
from . import merge

LEAST, LEAST_SHORT = 250, 80


def _host(url: Column) -> Column:
    """Host as written, in lower case, with www."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def read_pages(pages: DataFrame) -> DataFrame:
    """What every page holds, why it can't be used (`fault`) and its body, numbered by `place`; written as it is scanned, without a shuffle.

    pages: (url, status, content_type, html). A page without an address goes.
    """
    kind, status = F.lower(F.coalesce("content_type", F.lit(""))), F.coalesce("status", F.lit(0))
    fault = F.when(~status.between(200, 399), F.concat(F.lit("HTTP "), status.cast("string"))).when(~kind.contains("html"), F.concat(F.lit("not HTML: "), kind))
    one = pages.where("url IS NOT NULL").select("url", "status", "html", fault.alias("fault"))
    f = one.select("url", "status", "fault", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), P.found("url", F.when(F.col("fault").isNull(), F.col("html"))).alias("f"))
    read = f.select(text.canonical_url("url").alias("key"), "url", "status", "fault", "digest", "f.title", "f.image", text.canonical_url("f.refresh").alias("refresh"), text.canonical_url("f.amp").alias("amp"), P.best_body(F.col("f")).alias("body"))
    return written(read.select("*", F.char_length("body").alias("size"), F.monotonically_increasing_id().alias("place")), "crawl-pages")


def addresses(read: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per address, without bodies, and whether rules allow it; written, since three joins read it.

    Of pages of one address the one with the smallest url and digest stays.
    """
    one = merge.keep_first(read.drop("body"), ["key"], [F.col("url"), F.col("digest"), F.col("place")]).drop("digest")
    if rules is None:
        return written(one.withColumn("allowed", F.lit(True)), "crawl-addresses")
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = one.select("url", _host(F.col("url")).alias("host"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("path"))
    return written(one.join(robots_allowed(asked, rules).select("url", "allowed"), "url", "left"), "crawl-addresses")


def _met(rows: DataFrame, key: Column, right: DataFrame) -> DataFrame:
    """rows with what `right` (_met, ...) holds for a key; a row without one gets a key of its own that meets none, so that such rows spread."""
    left = rows.withColumn("_key", F.coalesce(key, F.concat(F.lit(" "), F.xxhash64("r").cast("string"))))
    return left.join(right, left["_key"] == right["_met"], "left").drop("_key", "_met")


def _with_page(rows: DataFrame, key: Column, at: DataFrame, name: str) -> DataFrame:
    """rows with the page of an address as a struct."""
    return _met(rows, key, at.select(F.col("key").alias("_met"), F.struct(*at.columns).alias(name)))


def reply_text(body: Column) -> Column:
    """Article text of a publisher's reply: the content field, else the synopsis (SRC-5)."""
    field = lambda f: F.nullif(text.clean_body(P.strip_lines(F.get_json_object(body, f"$.clip.info.{f}"))), F.lit(""))
    return F.coalesce(field("contentdata"), field("synopsis"))


def reply_address(url: Column) -> Column:
    """Address of the publisher's reply for an article's address; null where there is none."""
    base = F.create_map(*[F.lit(x) for pair in V.PUBLISHER_REPLIES.items() for x in pair])
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(F.try_element_at(base, _host(url)), F.nullif(F.regexp_extract(path, r"/article(?:_hub)?/(\d+)(?:/|$)", 1), F.lit("")))


def crawl(requests: DataFrame, pages: DataFrame, rules: DataFrame | None = None, replies: DataFrame | None = None, least: int = LEAST) -> DataFrame:
    """requests with (outcome, error, final_url, status, title, image, body), one row for each of theirs (SRC-3, 5).

    requests: (url, ...), columns named like the result's are replaced. pages:
    (url, status, content_type, html). rules: (host, prefix, allow). replies:
    (url, body), JSON.

    A page that points elsewhere by meta refresh stands for its target. A body
    under `least` signs gives way to a longer one of the AMP page, then of the
    publisher's reply. Success needs `least` signs, on a few fixed hosts 80.
    Requests that rules forbid are skipped. Null addresses and addresses
    without a page fail; empty tables give empty or failed results.
    """
    made = ("outcome", "error", "final_url", "status", "title", "image", "body")
    read = read_pages(pages)
    at = addresses(read, rules)
    rows = requests.select(F.struct(*[c for c in requests.columns if c not in made]).alias("r"))
    rows = _with_page(rows, text.canonical_url("r.url"), at, "p")
    on = F.col("p.allowed") & F.col("p.fault").isNull() & F.col("p.refresh").isNotNull() & (F.col("p.refresh") != F.col("p.key"))
    rows = _with_page(rows.withColumn("hop", F.coalesce(on, F.lit(False))), F.when(F.col("hop"), F.col("p.refresh")), at, "h")
    rows = rows.select("r", F.when(F.col("hop"), F.col("h")).otherwise(F.col("p")).alias("p"))
    usable = lambda s: F.col(f"{s}.allowed") & F.col(f"{s}.fault").isNull()
    rows = _with_page(rows, F.when(usable("p") & (F.col("p.size") < least), F.col("p.amp")), at, "a")
    longer = F.coalesce(usable("a") & (F.col("a.size") > F.col("p.size")), F.lit(False))
    either = lambda c: F.when(longer, F.coalesce(f"a.{c}", f"p.{c}")).otherwise(F.col(f"p.{c}")).alias(c)
    rows = rows.select("r", F.col("p.key").alias("met"), F.col("p.allowed").alias("allowed"), F.col("p.fault").alias("fault"), *map(either, ("url", "status", "title", "image", "size", "place")))
    said = F.lit(None).cast("string")
    if replies is not None:
        texts = replies.where("url IS NOT NULL").select(F.col("url").alias("_met"), reply_text(F.col("body")).alias("said")).groupBy("_met").agg(F.max_by("said", F.struct(F.char_length("said"), F.col("said"))).alias("said"))
        rows = _met(rows, F.when(F.col("allowed") & F.col("fault").isNull() & (F.col("size") < least), reply_address(F.col("url"))), texts)
        said = F.when(F.char_length("said") > F.col("size"), F.col("said"))
    rows = rows.withColumn("said", said).withColumn("size", F.coalesce(F.char_length("said"), "size"))
    enough = F.col("size") >= F.when(_host(F.col("url")).isin(*V.SHORT_ARTICLE_HOSTS), LEAST_SHORT).otherwise(least)
    error = F.when(F.col("met").isNull(), "no page").when(~F.col("allowed"), "forbidden by rules").when(F.col("fault").isNotNull(), F.col("fault")).when(~enough, F.concat(F.lit("body too short: "), F.col("size").cast("string")))
    outcome = F.when(F.col("met").isNotNull() & ~F.col("allowed"), "skipped").when(error.isNull(), "success").otherwise("failed")
    done = rows.select("r", outcome.alias("outcome"), error.alias("error"), F.col("url").alias("final_url"), "status", "title", "image", "said", "place")
    # Bodies are met once, by the number of the page that gives them.
    bodies = read.select(F.col("place").cast("string").alias("_met"), F.col("body").alias("_body"))
    done = _met(done, F.when(F.col("error").isNull() & F.col("said").isNull(), F.col("place").cast("string")), bodies)
    return done.select("r.*", "outcome", "error", "final_url", "status", "title", "image", F.coalesce("_body", F.when(F.col("error").isNull(), F.col("said"))).alias("body"))
