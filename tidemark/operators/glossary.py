"""Glossary terms and contents from the spans and lines of laid-out pages: gaps and islands over (page, column, line) (SRC-25, 26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def _trimmed(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _holds(font: Column, hint: str) -> Column:
    return F.coalesce(font, F.lit("")).contains(hint)


def ordered_spans(spans: DataFrame) -> DataFrame:
    """Spans in reading order within their page (`pos`), left column first, without page heads, numbers, initials and tiny signs.

    spans: (doc_id, page, ord, text, font, size, x0, y0, width). A title spans
    both columns and counts as left. Lines are two points high; `ord`, the
    place in the file, decides between equals. Spans without text or size go.
    """
    font, size = F.col("font"), F.col("size")
    title = (_holds(font, V.TITLE_FONT) | _holds(font, V.TITLE_LATIN_FONT)) & (size >= V.TITLE_SIZE)
    related = _holds(font, V.RELATED_FONT) & size.between(*V.RELATED_SIZES)
    t = spans.withColumn("text", _trimmed("text"))
    kept = t.where((F.col("text") != "") & (size >= V.LEAST_SIZE) & ~_holds(font, V.HEAD_FONT) & ~_holds(font, V.NUMBER_FONT) & ~F.rlike("text", F.lit("^[ㄱ-ㅎ]$")))
    column = F.when(title | (F.col("x0") < F.col("width") / 2), 0).otherwise(1)
    w = Window.partitionBy("doc_id", "page").orderBy(column, F.rint(F.col("y0") / 2), "x0", "ord")
    latin = _holds(font, V.TITLE_LATIN_FONT)
    return kept.select("doc_id", "page", F.row_number().over(w).alias("pos"), "text", "x0", "y0", title.alias("title"), related.alias("related"), latin.alias("latin"))


def title_lines(ordered: DataFrame) -> DataFrame:
    """One row (doc_id, page, pos, text) per title line: neighbouring title spans within five points of the line's first, from left to right.

    Runs of title spans are islands between other spans of a page; a run is
    folded in place, so its length is that of a page's titles.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("pos")
    runs = ordered.withColumn("run", F.sum(F.when(F.col("title"), 0).otherwise(1)).over(w)).where("title")
    piece = F.struct("pos", "y0", "x0", "text", "latin")
    whole = runs.groupBy("doc_id", "page", "run").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    # Each piece gets its line's first height by one pass, then lines are grouped by the place of their first piece.
    first = F.aggregate(
        "p",
        F.expr("named_struct('y', CAST(NULL AS DOUBLE), 'at', 0, 'out', CAST(array() AS array<int>))"),
        lambda a, x: F.when(F.abs(x["y0"] - a["y"]) < 5, F.struct(a["y"].alias("y"), a["at"].alias("at"), F.array_append(a["out"], a["at"]).alias("out"))).otherwise(F.struct(x["y0"].cast("double").alias("y"), x["pos"].alias("at"), F.array_append(a["out"], x["pos"]).alias("out"))),
        lambda a: a["out"],
    )
    pieces = whole.select("doc_id", "page", F.explode(F.arrays_zip("p", first.alias("at"))).alias("z")).select("doc_id", "page", F.col("z.at").alias("at"), "z.p.*")
    lines = pieces.groupBy("doc_id", "page", F.col("at").alias("line")).agg(F.array_sort(F.collect_list(F.struct("x0", "pos", "text", "latin"))).alias("p"))
    gap = lambda a, x: F.when(x["latin"] & F.rlike(a, F.lit(r"\p{L}$")), " ").otherwise("")
    return lines.select("doc_id", "page", F.col("line").alias("pos"), F.aggregate("p", F.lit(""), lambda a, x: F.concat(a, gap(a, x), x["text"])).alias("text"))


def islands(ordered: DataFrame) -> DataFrame:
    """(doc_id, term_page, term_pos, page, pos, text, title, related): every span under the last title line at or before it; those before the first go.

    Inside a page the title is found by a window of the page; across pages by
    a window over one narrow row a page, so no window holds a document's spans.
    """
    rows = ordered.where("NOT title").select("doc_id", "page", "pos", "text", "title", "related").unionByName(title_lines(ordered).withColumns({"title": F.lit(True), "related": F.lit(False)}))
    within = Window.partitionBy("doc_id", "page").orderBy("pos")
    here = rows.withColumn("_own", F.last(F.when(F.col("title"), F.col("pos")), True).over(within))
    ends = title_lines(ordered).groupBy("doc_id", "page").agg(F.max("pos").alias("at"))
    pages = ordered.select("doc_id", "page").distinct().join(ends, ["doc_id", "page"], "left")
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = pages.select("doc_id", "page", F.last(F.when(F.col("at").isNotNull(), F.struct(F.col("page").alias("page"), "at")), True).over(before).alias("_open"))
    out = here.join(carried, ["doc_id", "page"])
    own = F.col("_own").isNotNull()
    placed = out.select("doc_id", F.when(own, F.col("page")).otherwise(F.col("_open.page")).alias("term_page"), F.when(own, F.col("_own")).otherwise(F.col("_open.at")).alias("term_pos"), "page", "pos", "text", "title", "related")
    return placed.where("term_pos IS NOT NULL")


def split_name(raw: Column) -> tuple[Column, Column]:
    """(name before the first brackets with Latin letters, what stands in them or an empty text)."""
    pattern = r"\(([^()]*[A-Za-z][^()]*)\)"
    before = F.when(F.rlike(raw, F.lit(pattern)), _trimmed(F.regexp_extract(raw, rf"(?s)^(.*?){pattern}", 1))).otherwise(raw)
    return F.coalesce(F.nullif(before, F.lit("")), raw), _trimmed(F.regexp_extract(raw, pattern, 1))


def english_names(inside: Column) -> tuple[Column, Column]:
    """(first full name or null, short forms) of what stands in brackets; a short form is one word, mostly capitals. Hangul makes it neither."""
    parts = F.filter(F.transform(F.split(F.when(F.rlike(inside, F.lit("[가-힣]")), "").otherwise(inside), "[;:]"), _trimmed), lambda p: p != "")
    capitals = lambda p: F.regexp_count(p, F.lit(r"\p{Lu}")) >= 0.6 * F.regexp_count(p, F.lit(r"\p{L}"))
    is_short = lambda p: ~p.contains(" ") & F.rlike(p, F.lit(r"\p{L}")) & capitals(p)
    return F.try_element_at(F.filter(parts, lambda p: ~is_short(p)), F.lit(1)), F.filter(parts, is_short)


def _clean(names: Column) -> Column:
    clean = F.transform(names, lambda x: F.regexp_replace(F.regexp_replace(x, "[\\x00-\\x1f\\u200b-\\u200f\\ufeff]", ""), "^[ ·*•\t]+|[ ·*•\t]+$", ""))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def _key(c: Column) -> Column:
    return F.regexp_replace(split_name(c)[0], r"(?U)\s", "")


def contents(pages: DataFrame) -> DataFrame:
    """(doc_id, key, term, printed_page) of contents lines with leaders, the first of each key (SRC-26).

    pages: (doc_id, page, text). Lines that only continue a long name, which
    begin with no Hangul syllable or capital, and names over 40 signs go.
    """
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("nth", "line")).withColumn("line", _trimmed("line"))
    pattern = r"(?U)^(.*?)[·.\s]{3,}(\d{1,4})$"
    met = lines.where(F.rlike("line", F.lit(pattern))).select("doc_id", "page", "nth", _trimmed(F.regexp_extract("line", pattern, 1)).alias("term"), F.regexp_extract("line", pattern, 2).cast("int").alias("printed_page"))
    good = met.where((F.char_length("term") <= 40) & F.rlike("term", F.lit(r"^(?:[가-힣]|\p{Lu})"))).withColumn("key", _key(F.col("term")))
    return good.groupBy("doc_id", "key").agg(F.min(F.struct("page", "nth", "term", "printed_page")).alias("m")).select("doc_id", "key", "m.term", "m.printed_page")


def glossary_terms(spans: DataFrame, listed: DataFrame | None = None, offset: int = 0) -> DataFrame:
    """(doc_id, page, term, english_name, definition, aliases, related_terms, search_text, source_page), one row per title with a definition (SRC-25).

    spans as in ordered_spans, `page` from 1. A definition is what follows a
    title up to its label of related terms; behind the label only spans in the
    related font count. The printed page is that of the contents (`listed`, as
    contents() gives it) under the term's key, else under its first part
    between slashes that is there, else page less `offset`.
    """
    at = lambda x: F.struct(x["page"], x["pos"])
    label = F.col("related") & (F.col("text") == V.RELATED_LABEL)
    said = F.when(~F.col("title") & ~label, F.struct("page", "pos", "text", "related"))
    terms = islands(ordered_spans(spans)).groupBy("doc_id", "term_page", "term_pos").agg(F.max(F.when(F.col("title"), F.col("text"))).alias("raw"), F.min(F.when(label, F.struct("page", "pos"))).alias("label"), F.array_sort(F.collect_list(said)).alias("s"))
    texts = lambda keep: F.transform(F.filter("s", keep), lambda x: x["text"])
    behind = lambda x: F.coalesce(at(x) > F.col("label"), F.lit(False))
    related = F.flatten(F.transform(texts(lambda x: behind(x) & x["related"]), lambda t: F.transform(F.split(t, ","), _trimmed)))
    name, inside = split_name(F.col("raw"))
    t = terms.select("doc_id", F.col("term_page").alias("page"), F.col("term_pos").alias("pos"), name.alias("term"), inside.alias("inside"), _squeezed(F.array_join(texts(lambda x: ~behind(x)), " ")).alias("definition"), _clean(related).alias("related_terms")).where("definition <> ''")
    full, short = english_names(F.col("inside"))
    slashed = F.when(F.contains("term", F.lit("/")), F.filter(F.transform(F.split("term", "/"), _trimmed), lambda x: x != "")).otherwise(F.expr("CAST(array() AS array<string>)"))
    base = F.element_at(F.transform(F.split("term", "/"), _trimmed), 1)
    head = F.left("definition", F.lit(250))
    spot = F.when(base != "", F.instr(head, F.concat(base, F.lit("(")))).otherwise(0)
    repeated = F.when(spot > 0, F.regexp_extract(F.substring(head, spot + F.char_length(base), F.lit(250)), r"^\(([^()]*[A-Za-z][^()]*)\)", 1)).otherwise("")
    t = t.withColumns({"full": full, "short": short, "slashed": slashed, "repeated": repeated})
    full2, short2 = english_names(F.col("repeated"))
    t = t.withColumn("english_name", F.coalesce("full", full2))
    t = t.withColumn("aliases", _clean(F.concat("short", F.when(F.col("full").isNull(), short2).otherwise(F.expr("CAST(array() AS array<string>)")), "slashed")))
    counted = F.concat_ws(" ", F.col("term"), F.col("english_name"), F.array_join("aliases", " "), F.col("definition"))
    for i, sign in enumerate("①②③④⑤⑥⑦", 1):
        counted = F.replace(counted, F.lit(sign), F.lit(f"{i}."))
    t = t.withColumn("search_text", F.lower(_squeezed(counted)))
    own = F.col("page") - offset
    if listed is None:
        return t.select("doc_id", "page", "term", "english_name", "definition", "aliases", "related_terms", "search_text", own.alias("source_page"))
    keys = t.select("doc_id", "page", "pos", F.posexplode(F.concat(F.array("term"), "slashed")).alias("nth", "name")).withColumn("key", _key(F.col("name")))
    printed = keys.join(listed.select("doc_id", "key", "printed_page"), ["doc_id", "key"]).groupBy("doc_id", "page", "pos").agg(F.min_by("printed_page", "nth").alias("printed"))
    return t.join(printed, ["doc_id", "page", "pos"], "left").select("doc_id", "page", "term", "english_name", "definition", "aliases", "related_terms", "search_text", F.coalesce("printed", own).alias("source_page"))
