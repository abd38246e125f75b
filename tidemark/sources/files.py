"""File sources: delimited text, JSON lines, XML, archives, an inventory of binaries, and rows of API pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import canonicalize_url, strip_html
from ..functions.text import blank_to_null, rfc2822
from ..ship import ship


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Delimited text with a header, a byte order mark allowed; a schema is given, never guessed (SRC-27, 28, 34)."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; lines that do not parse are kept in _corrupt (SRC-35)."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of an XML file (SRC-8)."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def corp_codes(spark: SparkSession, path: str) -> DataFrame:
    """(stock_code, corp_code, corp_name) of listed companies: those with six digits (SRC-8, 10)."""
    rows = read_xml(spark, path, "list", "corp_code string, corp_name string, stock_code string")
    return rows.select(F.trim("stock_code").alias("stock_code"), F.trim("corp_code").alias("corp_code"), F.trim("corp_name").alias("corp_name")).where(F.rlike("stock_code", F.lit(r"^\d{6}$")))


def sync_codes(stocks: DataFrame, register: DataFrame) -> DataFrame:
    """(stock_code, corp_code, outcome): what a register says of stocks: changed (to be written), same, or missing (SRC-10).

    stocks and register: (stock_code, corp_code); of codes that a register
    gives twice the greatest counts. A stock without a code is missing.
    """
    known = register.where("stock_code IS NOT NULL").groupBy("stock_code").agg(F.max("corp_code").alias("found"))
    met = stocks.select("stock_code", "corp_code").join(known, "stock_code", "left")
    outcome = F.when(F.coalesce("found", F.lit("")) == "", "missing").when(F.equal_null("found", "corp_code"), "same").otherwise("changed")
    return met.select("stock_code", F.coalesce(F.nullif("found", F.lit("")), "corp_code").alias("corp_code"), outcome.alias("outcome"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, content) of ZIP files; another payload is one row with a null member and its bytes (SRC-7)."""
    ship(spark)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if zipfile.is_zipfile(io.BytesIO(data)):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for name in z.namelist():
                            yield pa.RecordBatch.from_pylist([{"path": at, "member": name, "content": z.read(name)}], schema=kind)
                else:
                    yield pa.RecordBatch.from_pylist([{"path": at, "member": None, "content": data}], schema=kind)

    kind = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary())])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(members, "path string, member string, content binary")


@F.pandas_udf(T.StringType())
def _decoded(data: pd.Series) -> pd.Series:
    def text(x: bytes) -> str:
        for name in ("utf-8", "euc-kr", "cp949"):
            try:
                return x.decode(name)
            except UnicodeDecodeError:
                continue
        return x.decode("utf-8", "replace")

    return data.map(text, na_action="ignore")


def document_text(members: DataFrame) -> DataFrame:
    """(path, text): the member named like the archive first, then the other XML ones, decoded as UTF-8 or else as EUC-KR or CP949 (SRC-41)."""
    ship(members.sparkSession)
    text = _decoded("content")
    stem = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    order = (~F.col("member").startswith(stem)).cast("int")
    rows = members.where(F.lower("member").endswith(".xml")).select("path", F.struct(order.alias("o"), F.col("member").alias("m"), text.alias("t")).alias("x"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))


def inventory(spark: SparkSession, path: str, pattern: str = r"^(\d{6,8})_([^_]+)_([^_]+)_(.+)\.\w+$") -> DataFrame:
    """Files with name parts, size, hash and the first path of the same content (SRC-36, 37, SCAL-64)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = spark.read.format("binaryFile").load(path).select("path", name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    part = lambda i: blank_to_null(F.regexp_extract("name", pattern, i))
    first = F.min("path").over(Window.partitionBy("sha256"))
    return files.select("*", part(1).alias("date"), part(2).alias("stock"), part(3).alias("broker"), part(4).alias("title"), F.when(first != F.col("path"), first).alias("duplicate_of"))


def search_rows(pages: DataFrame) -> DataFrame:
    """Rows of search API pages (column body, JSON), bad ones dropped, one per canonical URL, the first (SRC-1, 2).

    pages: (page long, body string).
    """
    kind = "struct<items:array<struct<title:string,originallink:string,link:string,description:string,pubDate:string>>>"
    rows = pages.select("page", F.posexplode(F.from_json("body", kind)["items"]).alias("pos", "i"))
    url = F.coalesce(blank_to_null("i.originallink"), blank_to_null("i.link"))
    parsed = rows.select("page", "pos", url.alias("url"), strip_html("i.title").alias("title"), strip_html("i.description").alias("description"), rfc2822("i.pubDate").alias("published_at"))
    good = parsed.where(F.rlike("url", F.lit("(?i)^https?://")) & F.col("published_at").isNotNull()).withColumn("canonical_url", canonicalize_url("url"))
    w = Window.partitionBy("canonical_url").orderBy("page", "pos")
    return good.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "page", "pos")


def api_status(body, schema: str):
    """(kind, rows) of a filing API reply: ok, no_data, rate_limited, auth_error or error (SRC-6, 9, 14, 16)."""
    status = F.get_json_object(body, "$.status")
    kind = F.when(status == "000", "ok").when(status == "013", "no_data").when(status == "020", "rate_limited").when(status.isin("010", "011", "012", "901"), "auth_error").otherwise("error")
    return F.struct(kind.alias("kind"), F.from_json(F.get_json_object(body, "$.list"), f"array<{schema}>").alias("rows"))


def filing_list(rows: DataFrame) -> DataFrame:
    """Filings from list rows (rcept_no, report_nm, rm, rcept_dt): date, correction flag and viewer address (SRC-9)."""
    flag = F.coalesce(F.col("rm"), F.lit("")).contains("정") | F.coalesce(F.col("rm"), F.lit("")).contains("철") | F.trim("report_nm").startswith("[")
    return rows.select("rcept_no", F.trim("report_nm").alias("title"), F.try_to_timestamp("rcept_dt", F.lit("yyyyMMdd")).alias("disclosed_at"), flag.alias("is_correction"), F.concat(F.lit("viewer?rcpNo="), "rcept_no").alias("viewer"))


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url, host, path) with `allowed`: no rule of the host, or the longest matching one allows (SRC-4).

    rules: (host, prefix, allow). Missing rules allow.
    """
    met = pages.join(rules, "host", "left").where(F.col("prefix").isNull() | F.col("path").startswith(F.col("prefix")))
    best = met.groupBy("url").agg(F.max_by("allow", F.struct(F.char_length("prefix"), F.col("allow").cast("int"))).alias("verdict"))
    return pages.join(best, "url", "left").withColumn("allowed", F.coalesce("verdict", F.lit(True))).drop("verdict")


def page_text_layout(pages: DataFrame) -> DataFrame:
    """(path, page, text) of layout text whose pages a form feed divides (SRC-37)."""
    return pages.select("path", F.posexplode(F.split("text", "\f")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("page"), "text")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of PDF files; needs a PDF library on the executors (SRC-24..26)."""
    try:
        import pypdf  # noqa: F401
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs pypdf on driver and executors") from missing

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pypdf

        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [(at, n, p.extract_text()) for n, p in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(pages, "path string, page int, text string")


def read_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A database table, read in parallel ranges of a numeric column (SRC-29..33)."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()
