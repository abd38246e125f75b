"""Functions that no built-in expresses, as Arrow-batched pandas UDFs around small helpers."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import canonical_url, normal_lines
from .vectors import as_column


def _strings(fn, returns=T.StringType()):  # noqa: B008
    """A pandas UDF of one text column; null stays null."""

    def apply(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    apply.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, returns)


# Unicode (SCAL-7, 10) -----------------------------------------------------------------------------

nfkc = _strings(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))
fold_case = _strings(lambda t: unicodedata.normalize("NFKC", t).casefold())


def normalize_content(c) -> Column:
    """Unicode compatibility form, then the native steps."""
    return normal_lines(nfkc(F.coalesce(as_column(c), F.lit(""))))


# URLs (SCAL-1, 31..33) ----------------------------------------------------------------------------


def form_encoded(c: Column) -> Column:
    """A part of a query string, decoded where it can be and encoded again in the form style (blanks as plus signs)."""
    again = F.url_encode(F.coalesce(F.try_url_decode(c), c))
    return F.replace(F.replace(again, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize_url(url) -> Column:
    """canonical_url with every parameter in one percent-encoding, so that spellings of one address agree. Native."""
    plain = canonical_url(url)
    params = F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&")
    again = F.transform(params, lambda p: F.concat(form_encoded(F.substring_index(p, "=", 1)), F.lit("="), form_encoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1))))
    return F.when(plain.contains("?"), F.concat(F.substring_index(plain, "?", 1), F.lit("?"), F.array_join(again, "&"))).otherwise(plain)


# HTML (SCAL-2) ------------------------------------------------------------------------------------


class _Text(HTMLParser):
    """Text of a page, without scripts and styles; blocks end a line."""

    BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 article section td".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag) -> None:
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.parts.append(data)


def _page_text(page: str) -> str:
    p = _Text()
    p.feed(page)
    p.close()
    return "".join(p.parts)


page_text = _strings(_page_text)
strip_html = _strings(lambda t: " ".join(_page_text(html.unescape(t)).split()))


# Chunks (SCAL-12, 13) -----------------------------------------------------------------------------

WHOLE, SHORT, LONG, OVERLAP, MOST = 1200, 500, 900, 100, 3


def chunk_spans(ends: list[int], text: str) -> Iterator[tuple[int, int]]:
    """Slices of a text whose paragraphs end at `ends` (two line feeds between them).

    A slice takes the paragraphs that end within LONG of its start, found by
    bisection; the next begins OVERLAP before its end. A paragraph beyond LONG
    that begins a slice is dealt out at a fixed step instead.
    """
    nth, start = 0, 0
    while nth < len(ends):
        begins = ends[nth - 1] + 2 if nth else 0
        if start >= begins and ends[nth] - begins > LONG:
            yield from ((at, min(at + LONG, ends[nth])) for at in range(begins, ends[nth], LONG - OVERLAP))
            nth, start = nth + 1, ends[nth] + 2
            continue
        last = max(nth, bisect_right(ends, start + LONG) - 1)
        yield start, ends[last]
        tail = text[max(start, ends[last] - OVERLAP) : ends[last]]
        nth, start = last + 1, ends[last] - len(tail.lstrip())


def split_long(text: str) -> list[str]:
    """One piece up to WHOLE signs; else the slices of chunk_spans, short ones joined to what is before where both fit; the first MOST stay."""
    if len(text) <= WHOLE:
        return [text] if text else []
    paragraphs = [p for p in map(str.strip, text.split("\n\n")) if p]
    joined = "\n\n".join(paragraphs)
    ends = [size - 2 for size in accumulate(len(p) + 2 for p in paragraphs)]
    groups: list[list[tuple[int, int]]] = []
    filled = WHOLE  # signs in the last group, its inner line feeds included
    for lo, hi in chunk_spans(ends, joined):
        if hi - lo < SHORT and filled + hi - lo <= WHOLE and groups:
            groups[-1].append((lo, hi))
            filled += hi - lo + 2
        elif len(groups) == MOST:
            break
        else:
            groups.append([(lo, hi)])
            filled = hi - lo
    return ["\n\n".join(joined[lo:hi] for lo, hi in g) for g in groups]


chunks = _strings(split_long, T.ArrayType(T.StringType()))


def event_chunks(title, explanation, body) -> Column:
    parts = [F.nullif(normalize_content(c), F.lit("")) for c in (title, explanation, body)]
    return chunks(F.trim(F.concat_ws("\n\n", *parts)))


# Trigrams (SCAL-75) -------------------------------------------------------------------------------


def trigrams(text: str) -> list[str]:
    """Trigrams in order: of every word in lower case, with two spaces before and one behind."""
    return [w[i : i + 3] for word in re.findall(r"\w+", text.lower()) for w in [f"  {word} "] for i in range(len(w) - 2)]


def similarity_within(query: set[str], text: list[str], least: float = 0.0) -> float:
    """Greatest share of common trigrams over all stretches of the text's trigrams.

    A best stretch begins and ends with a trigram of the query, so only those
    ends are tried; distinct trigrams of a stretch are counted as it grows,
    until it is too long for the best so far. Below `least` the result is 0.
    """
    hits = [i for i, t in enumerate(text) if t in query]
    best = least * (1 - 1e-12)
    for n, start in enumerate(hits):
        if len(hits) - n <= best * len(query):
            break
        seen: set[str] = set()
        common, at = 0, start
        for end in hits[n:]:
            for t in text[at : end + 1]:
                if t not in seen:
                    seen.add(t)
                    common += t in query
            at = end + 1
            best = max(best, common / (len(query) + len(seen) - common))
            if len(seen) > len(query) / max(best, 1e-9):
                break
    return best if best >= least else 0.0


def word_similarity(query, text, least: float = 0.0) -> Column:
    """Trigram similarity of a query to the best stretch of a text; 0 below `least`."""

    def apply(q: pd.Series, t: pd.Series) -> pd.Series:
        kept: dict[str, list[str]] = {}
        out = []
        for a, b in zip(q, t):
            if not a or not b:
                out.append(0.0)
                continue
            for x in (a, b):
                if x not in kept:
                    kept[x] = trigrams(x)
            out.append(similarity_within(set(kept[a]), kept[b], least) if kept[a] else 0.0)
        return pd.Series(out, dtype=float)

    apply.__annotations__ = {"q": pd.Series, "t": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, "double")(as_column(query), as_column(text))
