"""The filing API as a data source: status dispatch, waits, resumption; replies come from files."""

import json

import pytest

from tidemark.sources import filings_api

KEYS = "corp_code string, source_api string, request_key string"


@pytest.fixture()
def api(spark, tmp_path):
    def put(replies):
        folder = f"file://{tmp_path}/replies"
        rows = [(a, c, i, b if isinstance(b, str) else json.dumps(b)) for (a, c), bodies in replies.items() for i, b in enumerate(bodies)]
        filings_api.write_replies(spark.createDataFrame(rows, "source_api string, corp_code string, nth int, body string"), folder)
        return folder

    return put


def asked(spark, *apis):
    return spark.createDataFrame([("7", a, "k") for a in apis], KEYS)


def audit(df):
    return {r.source_api: (r.result_status, r.api_status, r.row_count, r.attempts, r.error) for r in df.where("row IS NULL").collect()}


OK = {"status": "000", "list": [{"rcept_no": "1", "x": "é"}, {"rcept_no": "2"}]}


def test_every_status_is_a_row(spark, api):
    folder = api({("good", "7"): [OK], ("empty", "7"): [{"status": "013", "message": "none"}], ("blank", "7"): [{"status": "000", "list": []}], ("later", "7"): [{"status": "020"}, {"status": "020"}, OK], ("never", "7"): [{"status": "020", "message": "slow"}], ("odd", "7"): [{"status": "800", "message": "bad"}], ("junk", "7"): ["{no json"]})
    done = spark.createDataFrame([], KEYS + ", result_status string")
    got = filings_api.collect(asked(spark, "good", "empty", "blank", "later", "never", "odd", "junk", "lost", "good"), done, folder, wait=0.0).collect()
    assert sorted(json.loads(r.row)["rcept_no"] for r in got if r.row and r.source_api == "later") == ["1", "2"]
    by = {r.source_api: (r.result_status, r.row_count, r.attempts) for r in got if r.row is None}
    assert by == {"good": ("success", 2, 1), "empty": ("no_data", 0, 1), "blank": ("no_data", 0, 1), "later": ("success", 2, 3), "never": ("failed", 0, 4), "odd": ("failed", 0, 1), "junk": ("failed", 0, 0), "lost": ("failed", 0, 0)}
    errors = {r.source_api: r.error for r in got if r.row is None}
    assert errors["odd"] == "bad" and errors["never"] == "slow" and "Error" in errors["junk"] and errors["lost"] and errors["good"] is None


def test_only_what_is_not_done_is_asked_again(spark, api):
    folder = api({(a, "7"): [OK] for a in "abcd"})
    done = spark.createDataFrame([("7", "a", "k", "success"), ("7", "b", "k", "no_data"), ("7", "c", "k", "failed"), ("7", "d", "older", "success")], KEYS + ", result_status string")
    assert set(audit(filings_api.collect(asked(spark, *"abcd"), done, folder, wait=0.0))) == {"c", "d"}
    everything = spark.createDataFrame([("7", a, "k", "success") for a in "abcd"], KEYS + ", result_status string")
    assert filings_api.collect(asked(spark, *"abcd"), everything, folder).count() == 0


def test_a_refused_key_ends_the_run(spark, api):
    folder = api({("a", "7"): [{"status": "011"}]})
    with pytest.raises(Exception, match="status 011"):
        filings_api.collect(asked(spark, "a"), spark.createDataFrame([], KEYS + ", result_status string"), folder).collect()


def test_registry(spark):
    rows = filings_api.registry(spark).collect()
    assert len(rows) == len({r.source_api for r in rows}) == len({r.event_type for r in rows}) == 36
