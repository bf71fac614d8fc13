import datetime as dt
import json

import pytest
import zstandard

from gatelens.operators import providers as P
from gatelens.operators import reports as R
from gatelens.sources import archive, readers, writers
from gatelens.streaming import store

HEADER = (
    "timestamp,provider_type,provider_name,latency_ms,is_streaming,time_to_first_token_ms,"
    "input_tokens,output_tokens,cached_tokens\n"
)


def test_request_stats_csv(spark, tmp_path):
    path = tmp_path / "request_stats.csv"
    path.write_text(
        HEADER
        + "2024-01-01T00:00:00Z,openai,p,150.5,False,,10,20,5\n"
        + "2024-01-01T00:00:00.250000Z,anthropic,q,500.75,True,50.25,1,2,0\n"
        + "not a time,openai,p,1,False,,1,2,3\n"
    )
    df = readers.read_request_stats(spark, str(path), corrupt_column="_bad")
    good, bad = readers.split_corrupt(df.cache(), "_bad")
    rows = good.orderBy("timestamp").collect()
    assert [(r.latency_ms, r.is_streaming, r.time_to_first_token_ms) for r in rows] == [
        (150.5, False, None),
        (500.75, True, 50.25),
    ]
    assert rows[1].timestamp == dt.datetime(2024, 1, 1, 0, 0, 0, 250000)
    assert [r["_bad"] for r in bad.collect()] == ["not a time,openai,p,1,False,,1,2,3"]


def test_missing_and_header_only(spark, tmp_path):
    missing = readers.read_request_stats(spark, str(tmp_path / "none.csv"))
    assert missing.count() == 0
    only = tmp_path / "h.csv"
    only.write_text(HEADER)
    df = readers.read_request_stats(spark, str(only))
    assert df.count() == 0 and df.schema == missing.schema
    assert R.provider_summary(df, dt.datetime(2024, 1, 1)).collect() == []
    assert readers.read_router_events(spark, str(tmp_path / "no-log")).count() == 0


def test_csv_text_shapes(spark, tmp_path):
    rows = [
        (dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), "openai", "p", 1.5, True, None, 1, 2, 3),
        (dt.datetime(2024, 1, 1, 0, 0, 1, 5, tzinfo=dt.timezone.utc), "openai", "p", 1.5, False, 2.5, 1, 2, 3),
    ]
    df = readers.read_request_stats(spark, str(tmp_path / "x"))
    writers.write_request_stats(spark.createDataFrame(rows, df.schema).coalesce(1), str(tmp_path / "out"), "csv")
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines()[0] + "\n" == HEADER
    assert "2024-01-01T00:00:00Z,openai,p,1.5,True,,1,2,3" in text.replace('""', "")
    assert "2024-01-01T00:00:01.000005Z,openai,p,1.5,False,2.5,1,2,3" in text


def _event(type_, n, **fields):
    return json.dumps(
        {"timestamp": f"2024-01-01T00:00:{n:02d}.000001Z", "type": type_, "session_id": "abcd1234", "request_id": f"r{n}"}
        | fields
    )


def test_event_log(spark, tmp_path):
    lines = [
        _event("request", 1, provider="p", stream=True, user_agent=None, full_request={"messages": [1, 2]}),
        _event("error", 2, provider="p", status_code=429, error_type="rate_limit_error", error_message="slow"),
        _event("provider_selection", 3, available_providers=[{"name": "p", "priority": 1}]),
        _event("configuration", 4, config_type="router_start", details={"provider_count": 2}),
    ]
    name = "router_20240101_000000_abcd1234"
    (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / f"{name}_errors.jsonl").write_text(lines[1] + "\n")
    (tmp_path / "request_stats.csv").write_text(HEADER)
    packed = zstandard.ZstdCompressor().compress((_event("retry", 5, attempt=1, retry_after=0.1) + "\n").encode())
    (tmp_path / "router_20231201_101112_ffff0000.jsonl.zst").write_bytes(packed)
    events = readers.with_log_file(readers.read_router_events(spark, str(tmp_path)))
    rows = {r.request_id: r for r in events.collect()}
    assert sorted(rows) == ["r1", "r2", "r3", "r4", "r5"]  # the error copy is not read
    assert rows["r5"].retry_after == 0.1
    assert rows["r5"].log_started_at == dt.datetime(2023, 12, 1, 10, 11, 12)
    assert rows["r1"].log_session == "abcd1234"
    assert [rows[f"r{n}"].seq for n in (1, 2, 3, 4)] == sorted(rows[f"r{n}"].seq for n in (1, 2, 3, 4))
    assert rows["r3"].available_providers[0].name == "p"
    details = events.filter("type = 'configuration'").selectExpr("variant_get(details, '$.provider_count', 'int') n")
    assert details.first().n == 2


def test_broken_event_lines(spark, tmp_path):
    (tmp_path / "router_20240101_000000_abcd1234.jsonl").write_text(_event("request", 1) + "\n{broken\n")
    events = readers.read_router_events(spark, str(tmp_path), corrupt_column="_bad").cache()
    good, bad = readers.split_corrupt(events, "_bad")
    assert [r.type for r in good.collect()] == ["request"]
    assert [r["_bad"] for r in bad.collect()] == ["{broken"]
    plain = readers.read_router_events(spark, str(tmp_path))
    assert sorted(str(r.type) for r in plain.collect()) == ["None", "request"]


def test_event_table_is_pruned_by_type(spark, tmp_path):
    from helpers import log

    events = log(spark, [{"type": t, "request_id": t, "details": '{"a":1}'} for t in ("request", "error", "retry")])
    writers.write_router_events(events, str(tmp_path / "t"))
    stored = readers.read_router_events_table(spark, str(tmp_path / "t"))
    errors = stored.filter("type = 'error'")
    assert [r.request_id for r in errors.collect()] == ["error"]
    assert "PartitionFilters: [isnotnull(type" in errors._jdf.queryExecution().toString()
    assert stored.count() == 3 and stored.selectExpr("variant_get(details, '$.a', 'int') a").first().a == 1
    assert readers.read_router_events_table(spark, str(tmp_path / "none")).schema == stored.select(
        *readers.read_router_events_table(spark, str(tmp_path / "none")).columns
    ).schema


def test_line_order_across_splits(spark, tmp_path):
    n = 4000
    text = "".join(_event("request", 1, message_count=i, model="m" * (i % 50)) + "\n" for i in range(n))
    (tmp_path / "router_20240101_000000_abcd1234.jsonl").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        events = readers.read_router_events(spark, str(tmp_path))
        assert events.rdd.getNumPartitions() > 3
        order = [r.message_count for r in events.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert order == list(range(n))


def test_providers(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(
        json.dumps(
            {
                "openai": [
                    {"api_key": "sk-12345678", "priority": 2, "model_mapping": {"gpt-4": "gpt-4-x"}, "provider_name": ""},
                    {"api_key": "abc", "priority": 2, "provider_name": "mine", "base_url": "https://x"},
                ],
                "anthropic": {"api_key": "only"},
            }
        )
    )
    df = readers.read_providers(spark, str(path))
    rows = {(r.provider_type, r.position): r for r in P.with_names(df).collect()}
    first, second, third = rows["openai", 0], rows["openai", 1], rows["anthropic", 0]
    assert (first.provider, first.api_key, first.effective_base_url) == (
        "openai-priority-2",
        "********5678",
        "https://api.openai.com/v1",
    )
    assert (second.provider, second.api_key, second.effective_base_url) == ("mine", "************", "https://x")
    assert (third.priority, third.timeout, third.max_retries, third.base_url, third.model_mapping) == (1, 30, 3, None, {})
    assert [tuple(r) for r in P.validate_providers(df).collect()] == [("openai", "duplicate_priority", None)]
    path.write_text(json.dumps({"openai": [{"priority": 1}]}))
    with pytest.raises(Exception, match="api_key"):
        readers.read_providers(spark, str(path)).collect()


def test_archive(spark, tmp_path, monkeypatch):
    as_of = dt.datetime(2024, 1, 20, 12, tzinfo=dt.timezone.utc)
    rows = [(dt.datetime(2024, 1, d, 5, tzinfo=dt.timezone.utc), f"r{d}{x}") for d in [1, 12, 13, 14, 19] for x in "ab"]
    rows.append((dt.datetime(2024, 1, 12, 5, tzinfo=dt.timezone.utc), None))
    events = spark.createDataFrame(rows, "timestamp timestamp, request_id string")
    out = str(tmp_path / "archive")
    assert archive.with_archive(events, out).count() == len(rows)
    assert archive.archive_events(events.filter("request_id in ('r1a', 'r12a', 'r19a')"), out, as_of) == {"2024-01-01": 1, "2024-01-12": 1}

    def die(self):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:  # files of some dates are there, the record is not
        broken.setattr(store.Batch, "commit", die)
        with pytest.raises(KeyboardInterrupt):
            archive.archive_events(events, out, as_of)
    assert archive.read_archive(spark, out).count() == 2
    assert archive.with_archive(events, out).count() == len(rows)
    # what came late for archived dates is added, what is there is not
    assert archive.archive_events(events, out, as_of) == {"2024-01-01": 1, "2024-01-12": 2}
    assert archive.archive_events(events, out, as_of) == {}
    found = archive.read_archive(spark, out)
    assert sorted(r.request_id or "" for r in found.collect()) == ["", "r12a", "r12b", "r1a", "r1b"]
    assert archive.with_archive(events, out).count() == len(rows)
    # live rows that were removed after they were archived come from the archive
    assert archive.with_archive(events.filter("timestamp > '2024-01-13'"), out).count() == len(rows)
    assert archive.archived_dates(spark, out).filter("bytes > 0").agg({"rows": "sum"}).first()[0] == 5
    assert any(".zstd." in f.name for f in (tmp_path / "archive").rglob("*.parquet"))
    assert "PartitionFilters: [isnotnull(date" in found.filter("date = '2024-01-12'")._jdf.queryExecution().toString()
    events.write.option("compression", "none").parquet(str(tmp_path / "plain"))
    report = writers.archive_report(spark, str(tmp_path / "plain"), out).first()
    assert report.bytes_before > 0 and report.bytes_after > 0
    (tmp_path / "nothing").mkdir()
    empty = writers.archive_report(spark, str(tmp_path / "nothing"), str(tmp_path / "nothing")).first()
    assert tuple(empty) == (0, 0, 0.0)


def test_partitioned_table_is_pruned(spark, tmp_path):
    df = readers.read_request_stats(spark, str(tmp_path / "x"))
    rows = [
        (dt.datetime(2024, 1, d, 5, tzinfo=dt.timezone.utc), "openai", "p", 1.0, True, None, 1, 2, 3) for d in range(1, 20)
    ]
    writers.write_request_stats(spark.createDataFrame(rows, df.schema), str(tmp_path / "t"))
    stored = readers.read_request_stats_table(spark, str(tmp_path / "t"))
    late = R.requests_over_time(stored, dt.datetime(2024, 1, 19, 12), "day", 48)
    assert [r["count"] for r in late.collect()] == [0, 1, 1]
    plan = late._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "2024-01-17" in plan


def test_json_rows(spark):
    df = spark.createDataFrame([("a", None, 1)], "x string, y string, n int")
    assert writers.to_json_rows(df).first().json == '{"x":"a","y":null,"n":1}'


def test_one_order_over_many_files(spark, tmp_path):
    """Two gateways log in the same microseconds: numbers are unique and follow files and lines under any partitioning."""
    at = "2024-01-01T00:00:00.000001"
    for folder in ("b", "a b"):  # names repeat in several folders
        (tmp_path / "logs" / folder).mkdir(parents=True)
        for n in range(2):
            lines = [json.dumps({"type": "error", "timestamp": at, "request_id": f"{folder}{n}-{i}", "provider": "p"}) for i in range(300)]
            (tmp_path / "logs" / folder / f"router_20240101_00000{n}_s.jsonl").write_text("\n".join(lines) + "\n")
    orders = []
    for size in ("2k", "7k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = readers.read_router_events(spark, str(tmp_path / "logs" / "*")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len({r.seq for r in rows}) == len(rows) == 1200
        orders.append([r.request_id for r in sorted(rows, key=lambda r: (r.timestamp, r.seq))])
    assert orders[0] == orders[1] == orders[2] == [f"{f}{n}-{i}" for f in ("a b", "b") for n in range(2) for i in range(300)]
