"""Filings and statements: what to fetch, which statement counts, typed fields, facts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text
from .merge import keep_first
from .timeseries import asof_before

#: fixed values: standard accounts, their ids, names and nature
ACCOUNTS = [
    ("매출액", ["ifrs-full_Revenue"], ["매출액", "수익(매출액)", "영업수익"], "income"),
    ("영업이익", ["dart_OperatingIncomeLoss"], ["영업이익", "영업이익(손실)"], "income"),
    ("당기순이익", ["ifrs-full_ProfitLoss"], ["당기순이익", "당기순이익(손실)"], "income"),
    ("자산총계", ["ifrs-full_Assets"], ["자산총계"], "balance"),
    ("부채총계", ["ifrs-full_Liabilities"], ["부채총계"], "balance"),
    ("자본총계", ["ifrs-full_Equity"], ["자본총계"], "balance"),
    ("영업활동현금흐름", ["ifrs-full_CashFlowsFromUsedInOperatingActivities"], ["영업활동현금흐름", "영업활동으로 인한 현금흐름"], "cashflow"),
    ("투자활동현금흐름", ["ifrs-full_CashFlowsFromUsedInInvestingActivities"], ["투자활동현금흐름", "투자활동으로 인한 현금흐름"], "cashflow"),
    ("재무활동현금흐름", ["ifrs-full_CashFlowsFromUsedInFinancingActivities"], ["재무활동현금흐름", "재무활동으로 인한 현금흐름"], "cashflow"),
]
STATEMENT = ["stock_code", "bsns_year", "reprt_code"]


def needing_text(filings: DataFrame, now: Column) -> DataFrame:
    """Filings whose document is to be fetched, the required first, then the newest (SRC-11, 40).

    filings: (rcept_no, title, truncated, disclosed_at, is_correction, raw_text, parse_status).
    """
    p = text.document_priority("title", "truncated", "disclosed_at", "is_correction", now)
    lacks = F.col("truncated") | (F.trim(F.coalesce("raw_text", F.lit(""))) == "") | ~F.coalesce(F.col("parse_status") == "success", F.lit(False))
    wanted = filings.withColumn("priority", p).where(F.col("priority").isin("required", "important") & lacks & ~F.coalesce(F.col("parse_status") == "unavailable", F.lit(False)))
    return wanted.orderBy((F.col("priority") != "required").cast("int"), F.desc("disclosed_at"), "rcept_no")


def consolidated_first(rows: DataFrame) -> DataFrame:
    """Rows of the consolidated statement, of the separate one where there is none (SRC-12, 13)."""
    best = F.min(F.when(F.col("fs_div") == "CFS", 0).otherwise(1)).over(Window.partitionBy(*STATEMENT))
    return rows.withColumn("__best", best).where(F.col("__best") == F.when(F.col("fs_div") == "CFS", 0).otherwise(1)).drop("__best")


def company_profile(raw: DataFrame) -> DataFrame:
    """Profile fields from a JSON payload: blanks are null, dates are dates, the payload stays (SRC-17, 18).

    raw: (stock_code, payload).
    """
    get = lambda k: text.blank_to_null(F.get_json_object("payload", f"$.{k}"))
    return raw.select("stock_code", get("corp_name").alias("corp_name"), get("ceo_nm").alias("ceo"), get("hm_url").alias("homepage"), F.to_date(F.try_to_timestamp(get("est_dt"), F.lit("yyyyMMdd"))).alias("est_dt"), F.col("payload").alias("raw_data"))


def merge_company(master: DataFrame, profile: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of the market master, else of the profile; an address without a scheme gets one (SRC-22, 42)."""
    j = master.alias("m").join(profile.alias("p"), "stock_code", "full_outer")
    pick = lambda f: F.coalesce(text.blank_to_null(f"m.{f}"), text.blank_to_null(f"p.{f}"))
    repair = lambda c: F.when(F.rlike(c, F.lit("(?i)^https?://")), c).otherwise(F.concat(F.lit("https://"), c))
    return j.select("stock_code", *[(repair(pick(f)) if f == "homepage" else pick(f)).alias(f) for f in fields])


def market_overview(quotes: DataFrame, closes: DataFrame) -> DataFrame:
    """The latest quote of each symbol with its change from the close of the day before (SRC-19, 20).

    quotes: (symbol, day, at, price), closes: (symbol, day, close).
    """
    latest = keep_first(quotes, ["symbol"], [F.col("at").desc(), F.col("price")])
    joined = asof_before(latest, closes, ["symbol"], "day", "close", "previous")
    return joined.select("symbol", "price", "previous", (F.col("price") - F.col("previous")).alias("change"), text.change_rate("price", "previous").alias("rate"))


def statement_rows(rows: DataFrame) -> DataFrame:
    """Standard accounts of API rows: by id, else by name, the first match; income as quarter and cumulative (SCAL-27, 28).

    rows: STATEMENT, fs_div, ord, account_id, account_nm, thstrm_amount,
    thstrm_add_amount, frmtrm_amount, frmtrm_q_amount, frmtrm_add_amount.
    """
    spec = rows.sparkSession.createDataFrame([(a, c, x, p) for a, ids, names, c in ACCOUNTS for p, xs in ((0, ids), (1, names)) for x in xs], "account string, nature string, key string, priority int")
    by = rows.withColumn("__m", F.explode(F.array(F.struct(F.col("account_id").alias("key"), F.lit(0).alias("priority")), F.struct(F.col("account_nm").alias("key"), F.lit(1).alias("priority")))))
    met = by.withColumn("key", F.col("__m.key")).withColumn("priority", F.col("__m.priority")).drop("__m").join(F.broadcast(spec), ["key", "priority"])  # the list above
    one = keep_first(met, [*STATEMENT, "fs_div", "account"], [F.col("priority"), F.col("ord")])
    n = {c: text.amount(c) for c in ("thstrm_amount", "thstrm_add_amount", "frmtrm_amount", "frmtrm_q_amount", "frmtrm_add_amount")}
    row = lambda now, before, kind: F.struct(now.alias("thstrm_amount"), before.alias("frmtrm_amount"), F.lit(kind).alias("amount_type"))
    income, add = F.col("nature") == "income", n["thstrm_add_amount"].isNotNull()
    made = F.array(
        F.when(income & add & n["thstrm_amount"].isNotNull(), row(n["thstrm_amount"], n["frmtrm_q_amount"], "quarter")),
        F.when(income & add, row(n["thstrm_add_amount"], n["frmtrm_add_amount"], "cumulative")),
        F.when((income & ~add | (F.col("nature") == "cashflow")) & n["thstrm_amount"].isNotNull(), row(n["thstrm_amount"], n["frmtrm_amount"], "cumulative")),
        F.when((F.col("nature") == "balance") & n["thstrm_amount"].isNotNull(), row(n["thstrm_amount"], n["frmtrm_amount"], "point_in_time")),
    )
    return one.select(*STATEMENT, "fs_div", F.col("account").alias("account_nm"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("r")).select(*STATEMENT, "fs_div", "account_nm", "r.*")


def map_fields(fields: Column, numeric: dict, dates: dict, texts: dict, required: list[str]) -> Column:
    """(values map, missing array): named fields of a row under standard keys; what the row lacks is not invented (SCAL-24)."""
    get = lambda k: text.blank_to_null(F.try_element_at(fields, F.lit(k)))
    pairs = [(v, text.amount(get(k)).cast("string")) for k, v in numeric.items()]
    pairs += [(v, F.date_format(text.flexible_date(get(k)), "yyyy-MM-dd")) for k, v in dates.items()]
    pairs += [(v, F.when(get(k) != "-", get(k))) for k, v in texts.items()]
    kept = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull())
    values = F.map_from_entries(kept)
    return F.struct(values.alias("values"), F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(values)).alias("missing"))


def typed_fields(fields: Column) -> Column:
    """Every field with its kind: date, number or text; empty ones go (SCAL-25)."""
    kept = F.filter(F.map_entries(fields), lambda e: ~F.trim(F.coalesce(e["value"], F.lit(""))).isin("", "-"))
    date = lambda e: (e["key"].endswith("_dt") | e["key"].endswith("_de") | F.rlike(e["value"], F.lit(r"\d{4}\s*년"))) & text.flexible_date(e["value"]).isNotNull()
    kind = lambda e: F.when(date(e), "date").when(text.amount(e["value"]).isNotNull(), "number").otherwise("text")
    return F.transform(kept, lambda e: F.struct(e["key"].alias("key"), kind(e).alias("kind"), F.trim(e["value"]).alias("value")))


def default_amount_type(account: Column, annual: Column) -> Column:
    """The amount that a question means: a balance at a time, a year's total, else a quarter (FIL-17)."""
    balance = F.array(*[F.lit(a) for a, _, _, c in ACCOUNTS if c == "balance"])
    flow = F.array(*[F.lit(a) for a, _, _, c in ACCOUNTS if c == "cashflow"])
    return F.when(F.array_contains(balance, account), "point_in_time").when(F.array_contains(flow, account) | annual, "cumulative").otherwise("quarter")


def financial_facts(rows: DataFrame, stock: str, accounts: list[str], year: str | None = None, code: str | None = None, amount_type: str | None = None, limit: int = 20) -> DataFrame:
    """Facts of a stock, the newest first; rows without an amount go after the limit (FIL-15, 16, UDF-10).

    A year without a period asks for the annual report. No other period
    stands in for one that is missing.
    """
    code = "11011" if year and not code else code
    out = rows.where((F.col("stock_code") == stock) & F.col("account_nm").isin(accounts))
    for c, v in (("bsns_year", year), ("reprt_code", code), ("amount_type", amount_type)):
        out = out.where(F.col(c) == v) if v else out
    top = out.orderBy(F.desc("bsns_year"), F.desc("reprt_code"), "account_nm", "fs_div", "amount_type").limit(limit)
    return top.where("thstrm_amount IS NOT NULL").withColumn("shown", text.format_won("thstrm_amount"))


def structured_values(rows: DataFrame, stock: str, event_types: list[str], limit: int = 10) -> DataFrame:
    """Structured filings of some kinds, the newest first (FIL-14, UDF-12)."""
    return rows.where((F.col("stock_code") == stock) & F.col("event_type").isin(event_types)).orderBy(F.desc("rcept_no")).limit(limit)


def grade_amount(answer: Column, value: Column) -> Column:
    """An answer holds the amount: its digits, or the head of its shown form (AGG-42)."""
    digits, shown = F.regexp_replace(answer, r"[^\d]", ""), text.format_won(value)
    return digits.contains(F.abs(value).cast("string")) | answer.contains(shown) | answer.contains(F.regexp_extract(shown, r"^-?[\d,.]+", 0))


def _after(c: Column, labels: tuple[str, ...], pattern: str, within: int, value) -> Column:
    """Of the labels in order, the first whose next match within so many signs gives a value; `value` makes it of the groups.

    Patterns are tried only on texts that hold their label, and from its first place on.
    """
    rest = lambda x: F.substr(c, F.instr(c, x))
    return F.coalesce(*[F.when(F.contains(c, F.lit(label)), value(lambda i, x=label: F.regexp_extract(rest(x), rf"(?sU)\Q{x}\E.{{0,{within}}}?{pattern}", i))) for label in labels])


def event_type(title: Column) -> Column:
    """Kind of a company event by the first pattern that a title without blanks holds; else null."""
    kinds = lambda compact: F.coalesce(*[F.when(reduce(or_, [F.contains(compact, F.lit(p)) for p in patterns]), kind) for kind, patterns in V.EVENT_TITLES])
    # A lambda's argument is made once for all patterns.
    return F.get(F.transform(F.array(F.regexp_replace(title, r"(?U)\s+", "")), kinds), 0)


def event_rows(rows: DataFrame) -> DataFrame:
    """Company events of filings: rows with event_type, event_date, event_end_date, start_time, location, amount, status and a map of what was found (SCAL-29).

    rows: (title, raw_text, ...); columns of those names are replaced. Rows
    whose title names no event go. A label followed by no day of the calendar
    gives way to the next. A title in brackets is a change; a word of
    withdrawal in the title or the first 5,000 signs cancels.
    """
    made = ("event_type", "event_date", "event_end_date", "start_time", "location", "amount", "status", "normalized")
    r = rows.drop(*made).withColumns({"title": F.coalesce("title", F.lit("")), "raw_text": F.coalesce("raw_text", F.lit(""))})
    r = r.withColumn("event_type", event_type(F.col("title"))).where("event_type IS NOT NULL")
    raw = F.col("raw_text")
    day = lambda g: F.try_to_timestamp(F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lpad(g(3), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    minute = lambda g: F.lpad(F.when(g(2) == "", "0").otherwise(g(2)), 2, "0")
    clock = lambda g: F.when(g(1).try_cast("int").between(0, 23) & minute(g).try_cast("int").between(0, 59), F.concat(F.lpad(g(1), 2, "0"), F.lit(":"), minute(g), F.lit(":00")))
    begins = F.coalesce(*[F.when(F.col("event_type") == kind, _after(raw, labels, V.EVENT_DATE, 120, day)) for kind, labels in V.EVENT_DATES.items()])
    place, said = F.lit(None).cast("string"), lambda x: rf"(?U)\Q{x}\E\s*[:：]?\s*([^\n]{{2,240}})"
    for label in reversed(V.EVENT_PLACES):
        found = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, said(label), 1), r"(?U)\s+", " "), "^[ :-]+|[ :-]+$", "")
        place = F.when(F.contains(raw, F.lit(label)) & F.rlike(raw, F.lit(said(label))), F.nullif(found, F.lit(""))).otherwise(place)
    paid = F.when(F.col("event_type") == "dividend", text.amount(F.regexp_extract(raw, "(?sU)" + V.DIVIDEND, 1)))
    head = F.concat_ws(" ", F.col("title"), F.substring(raw, 1, 5000))
    status = F.when(head.contains("철회") | head.contains("취소"), "cancelled").when(F.col("title").startswith("["), "changed").otherwise("scheduled")
    r = r.withColumns({"event_date": begins, "event_end_date": _after(raw, V.EVENT_ENDS, V.EVENT_DATE, 120, day), "start_time": _after(raw, V.EVENT_TIMES, V.EVENT_TIME, 160, clock), "location": place, "amount": paid, "status": status})
    names = ("event_date", "event_end_date", "start_time", "location", "amount")
    return r.withColumn("normalized", F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names]), lambda e: e["value"].isNotNull())))
