"""A filing API as a data source: one partition for each request of a registry, its status, waits and failures as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..shared import fresh_path

#: Columns of the source: a row for each request (row null), and one for each of the rows that its reply lists.
SCHEMA = "corp_code string, source_api string, request_key string, result_status string, api_status string, row_count long, attempts int, error string, row string"
#: Replies that a request waits for at most when it is told to come later, and the longest wait.
ATTEMPTS, LONGEST_WAIT = 4, 8.0


def registry(spark: SparkSession) -> DataFrame:
    """(event_type, source_api, name, nth): the kinds of major events (SRC-15)."""
    return spark.createDataFrame([(*x, i) for i, x in enumerate(V.MAJOR_EVENTS)], "event_type string, source_api string, name string, nth int")


def filings_source():
    """The data source's class, complete in itself, so that workers need nothing of this package.

    Options: requests, a folder of JSON lines (corp_code, source_api,
    request_key); replies, a folder with `<source_api>/<corp_code>`, whose
    n-th line is the answer to the n-th attempt; wait, seconds before the
    second attempt, doubled for each further one up to LONGEST_WAIT. Folders
    are addresses that pyarrow can open on every worker.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    schema, most, longest = SCHEMA, ATTEMPTS, LONGEST_WAIT

    class Request(InputPartition):
        def __init__(self, corp_code: str, source_api: str, request_key: str):
            self.corp_code, self.source_api, self.request_key = corp_code, source_api, request_key

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.requests, self.replies, self.wait = options["requests"], options["replies"], float(options.get("wait", "1"))

        def partitions(self):
            import json

            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(self.requests)
            out = []
            for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
                if info.is_file and "/part-" in info.path and info.size:
                    with system.open_input_stream(info.path) as f:
                        out += [Request(**json.loads(line)) for line in f.read().decode().splitlines() if line]
            return out

        def answer(self, request, attempt: int) -> str:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(f"{self.replies}/{request.source_api}/{request.corp_code}")
            with system.open_input_stream(path) as f:
                lines = f.read().decode().splitlines()
            return lines[min(attempt, len(lines) - 1)]

        def read(self, partition):
            import json
            import time

            if partition is None or not isinstance(partition, Request):
                return
            key = (partition.corp_code, partition.source_api, partition.request_key)
            attempts, status, rows, error = 0, None, [], None
            try:
                while attempts < most:
                    reply = json.loads(self.answer(partition, attempts))
                    attempts, status = attempts + 1, reply.get("status")
                    if status != "020":
                        break
                    if attempts < most:
                        time.sleep(min(longest, self.wait * 2 ** (attempts - 1)))
                rows, error = reply.get("list") or [], reply.get("message")
            except (OSError, ValueError) as failure:
                error = f"{type(failure).__name__}: {failure}"
            if status in ("010", "011", "012", "901"):
                raise PermissionError(f"request {key}: status {status}")
            result = "success" if status == "000" and rows else "no_data" if status in ("000", "013") else "failed"
            listed = rows if result == "success" else []
            yield (*key, result, status, len(listed), attempts, error if result == "failed" else None, None)
            for row in listed:
                yield (*key, result, status, len(listed), attempts, None, json.dumps(row, ensure_ascii=False, sort_keys=True))

    class Filings(DataSource):
        @classmethod
        def name(cls):
            return "filings_api"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    return Filings


def collect(wanted: DataFrame, done: DataFrame, replies: str, wait: float = 1.0) -> DataFrame:
    """SCHEMA for all wanted requests (corp_code, source_api, request_key) that are not done yet (SRC-6, 14, 16).

    done: (corp_code, source_api, request_key, result_status); requests that
    ended in success or no_data are not made again, failed ones are. A request
    that may not be made at all (a refused key) ends the run; any other failure
    is a row. One request is one partition, so a slow one holds up no other.
    """
    spark = wanted.sparkSession
    keys = ["corp_code", "source_api", "request_key"]
    left = wanted.select(*keys).distinct().join(done.where(F.col("result_status").isin("success", "no_data")).select(*keys).distinct(), keys, "left_anti")
    requests = fresh_path(spark, "requests")
    left.write.json(requests)
    spark.dataSource.register(filings_source())
    return spark.read.format("filings_api").options(requests=requests, replies=replies, wait=str(wait)).load()


def write_replies(replies: DataFrame, folder: str) -> None:
    """(source_api, corp_code, nth, body) as the files that the source reads; each reply is small."""

    def put(rows) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for r in rows:
            system.create_dir(f"{root}/{r.source_api}", recursive=True)
            with system.open_output_stream(f"{root}/{r.source_api}/{r.corp_code}") as f:
                f.write("\n".join(r.bodies).encode())

    one = replies.groupBy("source_api", "corp_code").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "body"))), lambda x: x["body"]).alias("bodies"))
    one.foreachPartition(put)
