"""Read-only tools as table functions of SQL: rows found for questions in, one envelope a question out (UDF-10..14).

    SELECT * FROM search_news(TABLE(hits), 5, array('rumours'))

A tool takes a table with query_id, rank and whatever of its fields is there,
and asks Spark to partition it by question and sort it by rank, so a question
is one partition of the call and only the first rows of it are held. A
question without rows comes as one row whose key is null (a left join does it).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from . import fixed_values as V
from ..ship import ship

MOST, WIDTH = 12, 500
_SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("source_id", "source_type", "title")])


def clamped(text: str | None, width: int = WIDTH) -> str:
    t = (text or "").strip()
    return t if len(t) <= width else t[:width] + "…"


class Tool:
    """What tools share. KEY is the column that names a source; of FIELDS those that the table has are given, TEXTS cut to a width."""

    KIND = KEY = TITLE = EMPTY = ""
    FIELDS: tuple[str, ...] = ()
    TEXTS: tuple[str, ...] = ()
    ALWAYS: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.question, self.rows, self.said = None, [], []

    @classmethod
    def plan(cls, table: AnalyzeArgument, limit: AnalyzeArgument | None) -> AnalyzeResult:
        """Result schema from the table's; an error if it lacks what every tool needs, or the limit is out of bounds."""
        if not table.isTable:
            raise ValueError("the first argument must be a table: TABLE(name)")
        types = {f.name: f.dataType for f in table.dataType.fields}
        if missing := [c for c in ("query_id", "rank", cls.KEY) if c not in types]:
            raise ValueError(f"the table lacks {', '.join(missing)}")
        if limit is not None and not (isinstance(limit.value, int) and 1 <= limit.value <= MOST):
            raise ValueError(f"a limit is from 1 to {MOST}")
        fields = [f for f in cls.FIELDS if f in types]
        item = T.StructType([T.StructField(f, T.StringType() if f in cls.TEXTS else types[f]) for f in fields])
        schema = T.StructType().add("query_id", types["query_id"]).add("status", "string").add("items", T.ArrayType(item)).add("sources", T.ArrayType(_SOURCE)).add("warnings", T.ArrayType(T.StringType()))
        read = dict.fromkeys(["query_id", "rank", cls.KEY, *fields, *([cls.TITLE] if cls.TITLE in types else [])])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("query_id")], orderBy=[OrderingColumn("rank")], select=[SelectedColumn(c) for c in read])

    def take(self, row: T.Row, limit: int, said: list[str]) -> None:
        self.question, self.said = row["query_id"], said
        if len(self.rows) < limit and row[self.KEY] is not None:
            self.rows.append(row)

    def terminate(self):
        if self.question is None:
            return
        have = self.rows[0].__fields__ if self.rows else ()
        fields = [f for f in self.FIELDS if f in have]
        items = [tuple(clamped(r[f]) if f in self.TEXTS else r[f] for f in fields) for r in self.rows]
        sources = [(str(r[self.KEY]), self.KIND, r[self.TITLE] if self.TITLE in have else None) for r in self.rows]
        yield self.question, "ok" if items else "no_data", items, sources, [*self.said, *self.ALWAYS] if items else [self.EMPTY]


class SearchNews(Tool):
    """News of a question; topics are told to the reader, not filtered (UDF-11)."""

    KIND, KEY, TITLE, EMPTY = "news_event", "chunk_id", "title", V.NO_NEWS
    FIELDS, TEXTS = ("title", "snippet", "published_at", "publisher"), ("snippet",)

    @staticmethod
    def analyze(hits: AnalyzeArgument, limit: AnalyzeArgument = None, exclude: AnalyzeArgument = None, include: AnalyzeArgument = None) -> AnalyzeResult:
        return SearchNews.plan(hits, limit)

    def eval(self, hits: T.Row, limit: int = 5, exclude: list = (), include: list = ()) -> None:
        said = [V.EXCLUDED.format(list(exclude))] if exclude else []
        self.take(hits, limit, said + ([V.INCLUDED.format(list(include))] if include else []))


def _plain(kind: str, key: str, title: str, empty: str, fields: str, texts: str = "", always: tuple[str, ...] = ()) -> type[Tool]:
    """A tool of a table and a limit."""

    class Plain(Tool):
        KIND, KEY, TITLE, EMPTY, ALWAYS = kind, key, title, empty, always
        FIELDS, TEXTS = tuple(fields.split()), tuple(texts.split())

        @staticmethod
        def analyze(hits: AnalyzeArgument, limit: AnalyzeArgument = None) -> AnalyzeResult:
            return Plain.plan(hits, limit)

        def eval(self, hits: T.Row, limit: int = 5) -> None:
            self.take(hits, limit, [])

    return Plain


#: Tools by their names in SQL.
TOOLS = {
    "search_news": SearchNews,
    "search_disclosures": _plain("dart_document", "rcept_no", "title", V.NO_FILINGS, "rcept_no title disclosed_at correction_status is_latest"),
    "get_disclosure_values": _plain("structured_disclosure", "rcept_no", "event_type", V.NO_VALUES, "rcept_no event_type announced_at summary normalized_data", "summary"),
    "search_research_reports": _plain("research_report", "chunk_id", "title", V.NO_REPORTS, "title broker report_date investment_opinion snippet page table_value_kinds", "snippet", (V.FORECASTS,)),
    "get_financial_facts": _plain("financial", "fact_id", "label", V.NO_FACTS, "label value_won value_display unit period basis value_kind"),
    "lookup_financial_term": _plain("term", "term", "term", V.NO_TERM, "term english_name official_definition easy_definition", "official_definition easy_definition"),
}


def register(spark: SparkSession) -> None:
    """Make the tools callable from this session's SQL."""
    ship(spark)
    for name, tool in TOOLS.items():
        spark.udtf.register(name, udtf(tool))
