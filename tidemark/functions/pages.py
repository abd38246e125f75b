"""What an article page holds, read from one tree a page (SCAL-30..36); the choice among its texts is native."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .arrow import _strings
from .text import clean_body
from .vectors import as_column

#: Pages whose texts go back to Spark at once.
PAGES = 64
FOUND = "struct<title:string,image:string,refresh:string,amp:string,preferred:string,bodies:array<string>>"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
_ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Tree(HTMLParser):
    """Elements of a page in document order, each with the range of text pieces that it spans.

    A block's start ends an open paragraph, as browsers do; an end without a
    start is passed over; what stays open ends with the page.
    """

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []  # tag, attributes, first piece, piece behind the last, parent
        self.pieces: list[str] = []
        self.shown: list[bool] = []
        self._open: list[int] = []
        self._hidden = 0
        self._same = False  # the last piece still grows
        self.feed(page)
        self.close()
        self._leave(0)

    def _leave(self, depth: int) -> None:
        """End all elements from a depth on."""
        for at in self._open[depth:]:
            self.elements[at][3] = len(self.pieces)
            self._hidden -= self.elements[at][0] in _HIDDEN
        del self._open[depth:]

    def _depth(self, tag: str) -> int | None:
        return next((d for d in range(len(self._open) - 1, -1, -1) if self.elements[self._open[d]][0] == tag), None)

    def handle_starttag(self, tag, attrs) -> None:
        self._same = False
        if tag in _ENDS_PARAGRAPH and (d := self._depth("p")) is not None:
            self._leave(d)
        here = len(self.pieces)
        self.elements.append([tag, {k: v or "" for k, v in reversed(attrs)}, here, here, self._open[-1] if self._open else -1])
        if tag not in _VOID:
            self._open.append(len(self.elements) - 1)
            self._hidden += tag in _HIDDEN

    def handle_endtag(self, tag) -> None:
        self._same = False
        if (d := self._depth(tag)) is not None:
            self._leave(d)

    def handle_comment(self, data) -> None:
        self._same = False

    def handle_data(self, data) -> None:
        if self._same:
            self.pieces[-1] += data
        else:
            self.pieces.append(data)
            self.shown.append(not self._hidden)
        self._same = True

    def text(self, at: int, between: str) -> str:
        """Shown pieces of an element, trimmed, empty ones left out."""
        lo, hi = self.elements[at][2:4]
        trimmed = (p.strip() for p, s in zip(self.pieces[lo:hi], self.shown[lo:hi]) if s)
        return between.join(p for p in trimmed if p)

    def raw(self, at: int) -> str:
        lo, hi = self.elements[at][2:4]
        return "".join(self.pieces[lo:hi])

    def all(self, tag: str, **attrs: str) -> Iterator[int]:
        for at, e in enumerate(self.elements):
            if e[0] == tag and all(e[1].get(k.replace("_", "-")) == v for k, v in attrs.items()):
                yield at

    def first(self, selector: str) -> int | None:
        """First element that a simple selector fits: a tag, #id and .classes in one word."""
        tag, name = re.match(r"[\w-]*", selector)[0], re.findall(r"#([\w-]+)", selector)
        classes = set(re.findall(r"\.([\w-]+)", selector))
        for at, (t, attrs, *_) in enumerate(self.elements):
            if (not tag or t == tag) and all(attrs.get("id") == n for n in name) and classes <= set(attrs.get("class", "").split()):
                return at
        return None


def _plain(markup: str, between: str) -> str:
    t = Tree(f"<body>{markup}</body>")
    return t.text(0, between)


strip_lines = _strings(lambda t: _plain(t, "\n"))


def _decoded(raw: str, at: int = 0):
    """The JSON value that begins at a place, else None."""
    try:
        return json.JSONDecoder().raw_decode(raw, at + len(raw[at:]) - len(raw[at:].lstrip()))[0]
    except (ValueError, RecursionError):
        return None


def _objects(value, keys: tuple[str, ...] | None = None) -> Iterator[dict]:
    """Objects inside a JSON value, parents before children, in order; under an object only `keys`, if given."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield x
            inner = x.values() if keys is None else [x.get(k) for k in keys]
        elif isinstance(x, list):
            inner = x
        else:
            continue
        stack.extend(reversed(list(inner)))


def _filled(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


def element_text(tree: Tree) -> str:
    """Texts, headers and quotes of an article's content elements in its page state (SCAL-36)."""
    at = tree.first("#fusion-metadata")
    raw = tree.raw(at) if at is not None else ""
    mark = raw.find(V.ELEMENTS_MARK)
    state = _decoded(raw, mark + len(V.ELEMENTS_MARK)) if mark >= 0 else None
    top = state.get("content_elements") if isinstance(state, dict) else None
    said = (_plain(o["content"], " ") for o in _objects(top, ("content_elements", "items")) if o.get("type") in V.ELEMENT_KINDS and _filled(o.get("content")))
    return "\n".join(s for s in said if s)


def state_text(tree: Tree) -> str:
    """Longest article text in JSON state: whole scripts of JSON and what is pushed onto queues (SCAL-35)."""
    best = ""
    for at in tree.all("script"):
        raw = tree.raw(at)
        if not any(f in raw for f in V.STATE_FIELDS):
            continue
        values = [_decoded(raw, m.end()) for m in re.finditer(r"\.push\(", raw)]
        if tree.elements[at][1].get("type") == "application/json":
            values.insert(0, _decoded(raw))
        for o in (o for v in values for o in _objects(v)):
            for field in V.STATE_FIELDS:
                x = o.get(field)
                if isinstance(x, list):
                    x = "\n".join(i["content"] for i in x if isinstance(i, dict) and i.get("type") == "text" and _filled(i.get("content"))) if field == V.STATE_LIST else ""
                elif _filled(x) and field != V.STATE_LIST:
                    x = _plain(x, "\n")
                else:
                    continue
                best = x if len(x) > len(best) else best
    return best


def linked_text(tree: Tree) -> str:
    """Longest articleBody of the page's linked data (SCAL-35)."""
    found = (o["articleBody"] for at in tree.all("script", type="application/ld+json") for o in _objects(_decoded(tree.raw(at))) if _filled(o.get("articleBody")))
    return max(found, key=len, default="")


def paragraph_text(tree: Tree) -> str:
    """Paragraphs of at least 30 signs."""
    return "\n".join(t for at in tree.all("p") if len(t := tree.text(at, " ")) >= 30)


def densest_text(tree: Tree) -> str:
    """Paragraphs of the one parent whose paragraphs hold the most signs outside links; those mostly of links go."""
    linked = [0] * (len(tree.pieces) + 1)
    for at in tree.all("a"):
        for i in range(*tree.elements[at][2:4]):
            linked[i] = 1
    held: dict[int, list[str]] = {}
    for at in tree.all("p"):
        lo, hi, parent = tree.elements[at][2:]
        whole = tree.text(at, " ")
        free = sum(len(tree.pieces[i].strip()) for i in range(lo, hi) if tree.shown[i] and not linked[i])
        if 2 * free > len(whole):
            held.setdefault(parent, []).append(whole)
    return "\n".join(max(held.values(), key=lambda ps: sum(map(len, ps)), default=[]))


def _meta(tree: Tree, **attrs: str) -> str:
    return next((c for at in tree.all("meta", **attrs) if (c := tree.elements[at][1].get("content", "").strip())), "")


def _seen_from(base: str, link: str) -> str | None:
    """A link's address on the web, else None."""
    try:
        to = urljoin(base, link.strip()) if link.strip() else ""
    except ValueError:
        return None
    return to if to.startswith(("http://", "https://")) else None


def read_page(url: str, page: str) -> dict:
    """Title, addresses and texts of one page; addresses are absolute."""
    tree = Tree(page)
    title = _meta(tree, property="og:title") or _meta(tree, name="twitter:title") or next((tree.raw(at) for at in tree.all("title")), "")
    image = next((i for how in ({"property": "og:image"}, {"property": "og:image:url"}, {"name": "twitter:image"}) if (i := _seen_from(url, _meta(tree, **how)))), None)
    heads = (e[1] for e in tree.elements if e[0] == "meta" and e[1].get("http-equiv", "").lower() == "refresh")
    to = re.search(r"(?i)url\s*=\s*['\"]?([^'\";]+)", next((h.get("content", "") for h in heads), ""))
    amp = next((e[1].get("href", "") for e in tree.elements if e[0] == "link" and "amphtml" in e[1].get("rel", "").split()), "")
    picked = [tree.text(at, "\n") for s in V.ARTICLE_SELECTORS if (at := tree.first(s)) is not None]
    try:
        selector = V.PREFERRED_SELECTORS.get(urlsplit(url).netloc.lower())
    except ValueError:
        selector = None
    at = tree.first(selector) if selector else None
    bodies = [densest_text(tree), element_text(tree), state_text(tree), linked_text(tree), *picked, paragraph_text(tree)]
    lines = lambda t: "\n".join(t.replace("\u00a0", " ").splitlines())
    return {
        "title": " ".join(title.split()) or None, "image": image, "refresh": _seen_from(url, to[1]) if to else None, "amp": _seen_from(url, amp),
        "preferred": lines(tree.text(at, "\n")) if at is not None else None, "bodies": [lines(b) for b in bodies if b],
    }


def found(url, html) -> Column:
    """FOUND of a page; null where it has no text at all. Pages of a batch go back PAGES at a time, so that few trees' texts are held at once."""

    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        nothing = dict.fromkeys(("title", "image", "refresh", "amp", "preferred"), None) | {"bodies": []}
        for u, h in batches:
            for at in range(0, len(h), PAGES):
                yield pd.DataFrame([read_page(a or "", b) if b else nothing for a, b in zip(u[at : at + PAGES], h[at : at + PAGES])], columns=[*nothing])

    apply.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(apply, FOUND)(as_column(url), as_column(html))


def best_body(f: Column) -> Column:
    """Of FOUND: the preferred element's text, if cleaning leaves any; else the longest cleaned text, the first of equals; else empty."""
    cleaned = F.transform(f["bodies"], lambda b: clean_body(b))
    longest = F.array_max(F.transform(cleaned, lambda x, i: F.struct(F.char_length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    return F.coalesce(F.nullif(clean_body(f["preferred"]), F.lit("")), longest, F.lit(""))
