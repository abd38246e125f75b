"""Text functions as native columns: cleaning, keys, rules, parsing and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .vectors import as_column


def any_of(c: Column, words) -> Column:
    """True if the text holds any of the words."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def blank_to_null(c) -> Column:
    c = F.trim(as_column(c))
    return F.when(c != "", c)


# Cleaning (SCAL-2, 4, 10, 11, 16, 21, 37) --------------------------------------------------------


def compact_whitespace(c) -> Column:
    """No-break spaces become spaces, runs of blanks one, three line feeds or more two."""
    t = F.regexp_replace(as_column(c), " ", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def unescape(c) -> Column:
    """The six entities that stored text keeps."""
    out = as_column(c)
    for entity, sign in list(V.ENTITIES.items())[1:]:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def normal_lines(c) -> Column:
    """Normalised content without the Unicode step: one kind of line end, trimmed lines, single spaces, two line feeds at most."""
    t = F.regexp_replace(unescape(F.coalesce(as_column(c), F.lit(""))), "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t ]+", " ")
    t = F.regexp_replace(t, "(?m)^ | $", "")
    return F.trim(F.regexp_replace(t, "\n{3,}", "\n\n"), F.lit(" \n"))


def search_text(*parts) -> Column:
    joined = F.concat_ws(" ", *[blank_to_null(normal_lines(p)) for p in parts])
    return F.lower(F.trim(F.regexp_replace(joined, r"\s+", " ")))


def strip_tags(c) -> Column:
    """Tags become spaces, white space is collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(as_column(c), "(?s)<[^>]*>", " ")), r"\s+", " "))


def markup_to_text(c) -> Column:
    """Filing markup: instructions and comments go, block ends become line feeds, other tags spaces."""
    t = F.regexp_replace(as_column(c), r"(?s)<\?.*?\?>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</(p|tr|div|li|table|title|section-\d)>|<br\s*/?>", "\n")
    t = F.regexp_replace(unescape(F.regexp_replace(t, "(?s)<[^>]+>", " ")), "[ \t ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def sentiment_text(c) -> Column:
    """Text for a sentiment model: link texts stay, markdown and tags go."""
    t = F.coalesce(as_column(c), F.lit(""))
    t = F.regexp_replace(t, r"!\[([^\]]*)\]\([^)]+\)", "$1")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    t = F.regexp_replace(t, r"(?m)^\s{0,3}(?:#{1,6}|>|[-+*]|\d+[.)])\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[*_~`]+", ""), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_body(c, boilerplate: list[str] = V.BOILERPLATE) -> Column:
    """Lines trimmed; those under two signs or with one of the boilerplate patterns go; a line stays once, where it first stood."""
    lines = F.transform(F.split(as_column(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: (F.char_length(x) >= 2) & ~F.rlike(x, F.lit("|".join(f"(?:{p})" for p in boilerplate))))), "\n")


# URLs (SCAL-1, 5, 6, FIL-12) ---------------------------------------------------------------------


def host(url) -> Column:
    """Lower-case host without port or www."""
    authority = F.regexp_extract(F.trim(as_column(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, "^.*@", "")), r":\d+$", ""), r"^www\.", "")


def canonical_url(url) -> Column:
    """Scheme and host lower-cased, www., fragment, trackers and slashes at the end dropped, parameters sorted.

    Keys and values stay in the encoding they came in.
    """
    u = F.trim(as_column(url))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    at = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.when(path == "", "/").otherwise(path), "/{2,}", "/"), "(.)/+$", "$1")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    trackers = F.array(*[F.lit(x) for x in V.TRACKING])
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(trackers, F.lower(F.substring_index(p, "=", 1))))
    # A parameter without a sign of equality has an empty value; order is by key, then value.
    pairs = F.transform(kept, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")
    return F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), at, path, F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))


def host_suffixes(h: Column) -> Column:
    """The host and every domain that it lies under, longest first."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


# Keys and hashes (SCAL-15, 17, 22) ---------------------------------------------------------------


def content_hash(c) -> Column:
    return F.sha2(as_column(c), 256)


def record_key(source_api, rcept_no, fields) -> Column:
    """sha256 of compact JSON with sorted keys: fields (a map), filing number, source."""
    quote = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    entries = F.array_sort(F.filter(F.map_entries(as_column(fields)), lambda e: F.coalesce(e["value"], F.lit("")) != ""))
    body = F.array_join(F.transform(entries, lambda e: F.concat(quote(e["key"]), F.lit(":"), quote(e["value"]))), ",")
    return F.sha2(F.concat(F.lit('{"fields":{'), body, F.lit('},"rcept_no":'), quote(F.coalesce(as_column(rcept_no), F.lit(""))), F.lit(',"source_api":'), quote(as_column(source_api)), F.lit("}")), 256)


# Rules (SCAL-8, 9, 38..40, 43, 48, 80, 81, FIL-18) ------------------------------------------------


def market_score(title, description) -> Column:
    t, d = (F.coalesce(as_column(x), F.lit("")) for x in (title, description))
    both = F.concat(t, d)
    add = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    return add(any_of(t, V.MARKET_SUBJECT), 1.0) + add(any_of(d, V.MARKET_SUBJECT), 0.5) + add(any_of(t, V.MARKET_MOVE), 1.0) + add(any_of(d, V.MARKET_MOVE), 0.5) + add(any_of(both, V.MARKET_FLOW), 0.5) + add(any_of(both, V.COMPANY_EVENT), -1.5)


def info_score(title) -> Column:
    """Number of patterns that the text matches; a pattern is tried only where one of its words stands."""
    t = F.coalesce(as_column(title), F.lit(""))
    tried = [any_of(t, words) & F.rlike(t, F.lit(p)) for p, words in zip([*V.INFO_PATTERNS, V.NAME_LIST], [*V.INFO_WORDS, ("·", ",")], strict=True)]
    return reduce(lambda a, b: a + b, [x.cast("int") for x in tried])


def is_info(title, description) -> Column:
    both = F.concat(F.coalesce(as_column(title), F.lit("")), F.coalesce(as_column(description), F.lit("")))
    return ~any_of(both, V.COMPANY_EVENT) & (info_score(title) >= 1)


def kind(title, description, threshold: float = 2.0) -> Column:
    """market before info before company."""
    return F.when(market_score(title, description) >= threshold, "market").when(is_info(title, description), "info").otherwise("company")


def is_opinion(title) -> Column:
    """The title marks an opinion piece (FIL-18)."""
    return F.rlike(F.coalesce(as_column(title), F.lit("")), F.lit(V.OPINION))


def relevance_text(c) -> Column:
    """Lower case, dashes, underscores and slashes to spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(as_column(c), F.lit(""))), "[-‐‑‒–—_/]+", " "), r"\s+", " "))


def mentions(c, terms) -> Column:
    """Number of non-overlapping mentions, the longest term first where several begin; digits need a border."""
    quoted = lambda t: r"(?<!\d)" + t + r"(?!\d)" if t.isdecimal() else r"\Q" + t + r"\E"
    pattern = "|".join(quoted(t.lower()) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_count(relevance_text(c), F.lit(pattern))


def query_plan(question, stock_code=None, current_stock_code=None) -> dict[str, Column]:
    """What a question asks for, and which stock: the one given, else the current document's, else six digits in the text."""
    q = F.coalesce(as_column(question), F.lit(""))
    none = F.lit(None).cast("string")
    asks = {k: any_of(F.lower(q), words) for k, words in (("financials", V.ASKS_NUMBER), ("reports", V.ASKS_REPORT), ("terms", V.ASKS_TERM), ("price", V.ASKS_PRICE), ("correction", V.ASKS_CORRECTION))}
    nothing = ~(asks["financials"] | asks["reports"] | asks["terms"] | asks["correction"])
    code = F.regexp_extract(q, r"\b(\d{6})\b", 1)
    return {
        "stock_code": F.coalesce(blank_to_null(stock_code) if stock_code is not None else none, blank_to_null(current_stock_code) if current_stock_code is not None else none, blank_to_null(code)),
        **{f"need_{k}": v for k, v in asks.items()},
        "need_documents": any_of(F.lower(q), V.ASKS_EXPLAIN) | asks["correction"] | nothing,
        "need_disclosure_values": asks["correction"] | any_of(F.lower(q), V.ASKS_FILING),
    }


def tokens(c) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(as_column(c), F.lit(""))), "[^0-9a-z가-힣]+"), lambda x: x != ""))


def value_similarity(a, b) -> Column:
    """1 if equal, 0.9 if one of four signs or more holds the other, else Jaccard of the tokens."""
    x, y = (F.array_join(F.filter(F.split(F.lower(F.coalesce(as_column(c), F.lit(""))), "[^0-9a-z가-힣]+"), lambda t: t != ""), " ") for c in (a, b))
    tx, ty = tokens(a), tokens(b)
    jaccard = F.size(F.array_intersect(tx, ty)) / F.greatest(F.lit(1), F.size(F.array_union(tx, ty)))
    held = (F.least(F.char_length(x), F.char_length(y)) >= 4) & (x.contains(y) | y.contains(x))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(held, 0.9).otherwise(jaccard)


def signature_similarity(left: dict, right: dict) -> tuple[Column, Column]:
    """(weighted similarity over the fields that both have, fields of 0.5 or more); fields: subjects, topic, anchors."""
    weights = {"core_subjects": 0.30, "core_topic": 0.35, "unique_anchors": 0.35}
    total, base, hits = F.lit(0.0), F.lit(0.0), F.lit(0)
    for name, w in weights.items():
        both = (F.coalesce(as_column(left[name]), F.lit("")) != "") & (F.coalesce(as_column(right[name]), F.lit("")) != "")
        s = value_similarity(left[name], right[name])
        total, base = total + F.when(both, s * w).otherwise(0.0), base + F.when(both, w).otherwise(0.0)
        hits = hits + F.when(both & (s >= 0.5), 1).otherwise(0)
    return F.when(base > 0, total / base).otherwise(0.0), hits


# Parsing (SCAL-3, 18..20, 41, 44, 51, 64, 67..69, 79, 86) -------------------------------------------


def flexible_date(c) -> Column:
    """yyyymmdd, or year, month and day with separators or signs; midnight UTC; null if no such day."""
    t = F.trim(as_column(c))
    part = lambda i: F.regexp_extract(t, r"(\d{4})\s*[.년/-]\s*(\d{1,2})\s*[.월/-]\s*(\d{1,2})", i)
    made = F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
    return F.try_to_timestamp(F.when(F.rlike(t, F.lit(r"^\d{8}$")), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).otherwise(made), F.lit("yyyy-MM-dd"))


def amount(c) -> Column:
    """Whole amounts with commas; dashes, blanks and all else are null."""
    t = F.replace(F.trim(as_column(c)), F.lit(","), F.lit(""))
    return F.when(F.rlike(t, F.lit(r"^-?\d+$")), t.try_cast("bigint"))


def rfc2822(c) -> Column:
    return F.try_to_timestamp(F.regexp_replace(as_column(c), r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def first_sentence(c) -> Column:
    """The first sentence without its opening; a full stop counts before an exclamation and that before a question mark."""
    t = F.trim(F.regexp_replace(F.replace(F.coalesce(as_column(c), F.lit("")), F.lit("**"), F.lit("")), r"\s+", " "))
    for opening in V.BRIEF_OPENINGS:
        t = F.when(t.startswith(opening), F.trim(F.substring(t, len(opening) + 1, 1 << 30))).otherwise(t)
    out = t
    for mark in ("? ", "! ", ". "):
        out = F.when(F.instr(t, mark) > 0, F.concat(F.trim(F.substring_index(t, mark, 1)), F.lit(mark[0]))).otherwise(out)
    return out


def first_sentences(c, count: int = 2) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.trim(as_column(c)), r"(?<=[.!?])\s+"), lambda x: x != ""), 1, count), " ")


def clamp(c, limit: int = 500) -> Column:
    c = as_column(c)
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def normal_title(c) -> Column:
    return F.regexp_replace(F.regexp_replace(as_column(c), r"^(?:\[[^\]]+\]\s*)+", ""), r"\s+", "")


def first_submission_date(c) -> Column:
    pattern = r"정정대상\s*공시서류의\s*최초제출일\s*[:：]?\s*(\d{4})\s*(?:년|[./-])\s*(\d{1,2})\s*(?:월|[./-])\s*(\d{1,2})\s*일?"
    part = lambda i: F.regexp_extract(F.coalesce(as_column(c), F.lit("")), pattern, i)
    return F.when(part(1) != "", F.to_date(F.try_to_timestamp(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), F.lit("yyyy-MM-dd"))))


def is_correction(title, raw_text, flag) -> Column:
    t, raw = (F.coalesce(as_column(x), F.lit("")) for x in (title, raw_text))
    head = F.regexp_replace(F.substring(raw, 1, 5000), r"\s+", "")
    return F.rlike(F.trim(t), F.lit(r"^(?:\[[^\]]+\]\s*)+")) | first_submission_date(raw).isNotNull() | head.contains("정정신고(보고)") | head.contains("정정신고서") | ((raw == "") & F.coalesce(as_column(flag), F.lit(False)))


def json_object(raw, schema: str) -> Column:
    """An object parsed from the whole text or else from its first brace to its last (SCAL-44..47)."""
    raw = as_column(raw)
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(F.rlike(F.trim(raw), F.lit(r"(?s)^\{.*\}$")), F.from_json(raw, schema)), F.when(inner != "", F.from_json(inner, schema)))


def bad_citations(answer, source_count) -> Column:
    """Numbers in [n] outside 1..source_count, sorted."""
    found = F.transform(F.regexp_extract_all(as_column(answer), F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n < 1) | (n > as_column(source_count)))))


def is_abbreviation(c) -> Column:
    """One token of which 60 % of the letters or more are capitals."""
    t = F.trim(as_column(c))
    letters = F.char_length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return ~t.contains(" ") & (letters > 0) & (F.char_length(F.regexp_replace(t, "[^A-Z]", "")) / letters >= 0.6)


def term_candidates(question) -> Column:
    """The term that a question asks for, else the question without its end marks, then its forms without a particle, in order (SCAL-49)."""
    q = F.coalesce(as_column(question), F.lit(""))
    t = F.coalesce(blank_to_null(F.regexp_extract(q, V.ASKED_TERM, 1)), F.trim(F.regexp_replace(q, r"[?!.\s]+$", "")))
    forms = [F.when(t.endswith(p) & (F.char_length(t) > len(p)), F.regexp_replace(t, p + "$", "")) for p in V.PARTICLES]
    return F.array_distinct(F.filter(F.array(t, *forms), lambda x: x.isNotNull() & (x != "")))


def event_signature(raw) -> Column:
    """An event's signature as (core_subjects, core_topic, unique_anchors, story_relation) from JSON of this or the older form (SCAL-42).

    A single value counts as a list of one; texts are trimmed and empty ones left out.
    """
    raw = as_column(raw)
    field = lambda k: F.get_json_object(raw, f"$.{k}")

    def listed(k: str) -> Column:
        v = field(k)
        found = F.when(v.startswith("["), F.from_json(v, "array<string>")).when(v.isNotNull(), F.array(v))
        return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))

    new = reduce(lambda a, b: a | b, [field(k).isNotNull() for k in ("core_subjects", "core_topic", "unique_anchors", "story_relation")])
    relation = F.trim(F.coalesce(field("story_relation"), F.lit("unknown")))
    topic = F.concat_ws(" ", *[blank_to_null(field(k)) for k in ("action", "object", "product_or_project")])
    anchors = F.array_distinct(F.concat(*[listed(k) for k in ("amount", "event_date", "identifiers", "product_or_project")]))
    return F.struct(
        F.when(new, listed("core_subjects")).otherwise(listed("subject")).alias("core_subjects"),
        F.when(new, blank_to_null(field("core_topic"))).otherwise(blank_to_null(topic)).alias("core_topic"),
        F.when(new, listed("unique_anchors")).otherwise(anchors).alias("unique_anchors"),
        F.when(new & relation.isin(*V.STORY_RELATIONS), relation).otherwise("unknown").alias("story_relation"),
    )


# Formats (SCAL-54, 55, 70, 71, 92, 93) ------------------------------------------------------------


def _printed(x: Column, digits: int) -> Column:
    """A number from 1 to 2^43 with one or two digits behind the point, as C prints it: by its exact binary value, halves to even.

    Java's formatter rounds the shortest decimal instead, so its 1.15 becomes
    1.2. Behind the point there are 52 bits at most, which a long holds.
    """
    whole = F.floor(x)
    scaled = ((x - whole) * float(2**52)).cast("bigint") * 10**digits
    down, rest = F.shiftright(scaled, 52), scaled.bitwiseAND(F.lit(2**52 - 1))
    up = (rest > 2**51) | ((rest == 2**51) & (down % 2 == 1))
    n = whole * 10**digits + down + up.cast("bigint")
    return F.concat(((n - n % 10**digits) / 10**digits).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def format_won(value) -> Column:
    v = as_column(value).cast("bigint")
    n, sign = F.abs(v), F.when(v < 0, "-").otherwise("")
    return F.when(n >= 10**12, F.concat(sign, _printed(n / 1e12, 2), F.lit("조원"))).when(n >= 10**8, F.concat(sign, _printed(n / 1e8, 1), F.lit("억원"))).otherwise(F.concat(F.format_number(v, 0), F.lit("원")))


def format_won_eok(value) -> Column:
    """Whole units of a hundred million, halves to even."""
    v = as_column(value).cast("bigint")
    eok = F.bround(F.abs(v) / F.lit(1e8)).cast("bigint")
    jo, rest, sign = F.floor(eok / 10000).cast("bigint"), eok % 10000, F.when(v < 0, "-").otherwise("")
    number = lambda c: F.format_number(c, 0)
    return F.when((jo > 0) & (rest > 0), F.concat(sign, number(jo), F.lit("조 "), number(rest), F.lit("억원"))).when(jo > 0, F.concat(sign, number(jo), F.lit("조원"))).otherwise(F.concat(sign, number(rest), F.lit("억원")))


def change_rate(now, before) -> Column:
    """Change in percent with two digits, null without a value before or from zero; halves of the scaled double go away from zero."""
    now, before = as_column(now), as_column(before)
    return F.when(before != 0, F.round((now - before) / before * 100 * 100) / 100)


def half_hour(ts) -> Column:
    """Start of the half hour."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(as_column(ts).cast("timestamp")) / 1800) * 1800)


def kst_day(ts) -> Column:
    return F.date_format(F.from_utc_timestamp(as_column(ts).cast("timestamp"), "Asia/Seoul"), "yyyy-MM-dd")


def relative_time(ts, now) -> Column:
    minutes = F.floor((F.unix_seconds(as_column(now).cast("timestamp")) - F.unix_seconds(as_column(ts).cast("timestamp"))) / 60)
    return F.when(minutes < 60, F.concat(F.greatest(minutes, F.lit(0)).cast("string"), F.lit(" min"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d")))


def token_cost(prompt, completion) -> Column:
    return ((as_column(prompt) * V.PROMPT_PRICE + as_column(completion) * V.COMPLETION_PRICE) / 1e6).cast("decimal(12,6)")


# Filings (FIL-9..11, SCAL-23, 29) and table cells (SCAL-59..62) --------------------------------------


def document_priority(title, truncated, disclosed_at, correction, now) -> Column:
    t = F.coalesce(as_column(title), F.lit(""))
    old = as_column(disclosed_at) < as_column(now) - F.expr("INTERVAL 365 DAYS")
    return F.when(any_of(t, V.LOW_PRIORITY_PATTERNS), "low").when(as_column(truncated), "required").when(any_of(t, V.CORE_TITLES), "required").when(old, "skip").when(any_of(t, V.IMPORTANT_PATTERNS) | as_column(correction), "important").otherwise("skip")


def has_business_content(fields) -> Column:
    meta, empty = (F.array(*[F.lit(x) for x in xs]) for xs in (V.NON_BUSINESS_FIELDS, V.EMPTY_VALUES))
    return F.exists(F.map_entries(as_column(fields)), lambda e: ~F.array_contains(meta, e["key"]) & ~F.array_contains(empty, F.trim(F.coalesce(e["value"], F.lit("")))))


def summary_text(head, fields) -> Column:
    meta = F.array(*[F.lit(x) for x in V.META_FIELDS])
    kept = F.filter(F.map_entries(as_column(fields)), lambda e: ~F.array_contains(meta, e["key"]) & ~F.trim(F.coalesce(e["value"], F.lit(""))).isin("", "-"))
    return F.concat_ws(" / ", as_column(head), blank_to_null(F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]))), ", ")))


def labelled(c, labels, value: str, group: int = 1, within: int = 120) -> Column:
    """The first of the labels that a value follows within so many signs; its value."""
    c = as_column(c)
    found = [blank_to_null(F.regexp_extract(c, r"(?s)\Q" + label + r"\E.{0," + str(within) + "}?" + value, group)) for label in labels]
    return F.coalesce(*found)


def narrative_table(cells) -> Column:
    """A table of text: under 15 % of its cells hold a number, or one is longer than 120 signs; so is one without cells."""
    flat = F.filter(F.flatten(as_column(cells)), lambda x: x != "")
    numbers = F.size(F.filter(flat, lambda x: F.rlike(x, F.lit(r"\d"))))
    return (F.size(flat) == 0) | (numbers / F.greatest(F.size(flat), F.lit(1)) < 0.15) | F.exists(flat, lambda x: F.char_length(x) > 120)


def column_kinds(headers) -> Column:
    """actual, estimate or forecast by the letter after a year; guidance by its words; else unknown."""
    letters = F.create_map(*[F.lit(x) for pair in V.KIND_OF_LETTER.items() for x in pair])
    letter = lambda h: blank_to_null(F.regexp_extract(F.coalesce(h, F.lit("")), V.YEAR_KIND, 2))
    guided = lambda h: F.when(F.rlike(F.coalesce(h, F.lit("")), F.lit(V.GUIDANCE)), "guidance").otherwise("unknown")
    return F.transform(as_column(headers), lambda h: F.coalesce(F.try_element_at(letters, letter(h)), guided(h)))


def table_kind(kinds) -> Column:
    k = as_column(kinds)
    past, ahead = F.array_contains(k, "actual"), F.arrays_overlap(k, F.array(*[F.lit(x) for x in ("estimate", "forecast", "guidance")]))
    return F.when(past & ahead, "mixed").when(past, "actual").when(ahead, "forecast").otherwise("unknown")


def units(c, most: int = 8) -> Column:
    """The units that a table's text names, each once, in the order of their first places (SCAL-62)."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(as_column(c), F.lit("")), F.lit(V.UNITS), 1)), 1, most)


def fixed_chunks(c, width: int = 1000) -> Column:
    """Pieces of that many signs, in order; none of an empty text (SCAL-14)."""
    c = as_column(c)
    n = F.ceil(F.char_length(c) / F.lit(width)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(c, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))
