import datetime as dt

import pytest
from helpers import T0, log, usage
from pyspark.sql import functions as F

from gatelens import schemas
from gatelens.operators import chains, facts, providers, stats
from gatelens.plans import publish


def attempt(rid, provider, at, outcome, tokens=(10, 20, 5), stream=False, ms=100.0, endpoint="openai", **more):
    start = {"type": "request", "request_id": rid, "provider": provider, "at": at, "stream": stream, "endpoint": endpoint}
    end = {"request_id": rid, "provider": provider, "at": at + 1, "endpoint": endpoint}
    if outcome == "ok":
        return [start, end | {"type": "response", "duration_ms": ms, "usage": usage(*tokens), "model": "m"} | more]
    if outcome == "open":
        return [start]
    return [start, end | {"type": "error", "error_type": outcome, "error_message": "boom"} | more]


def stat_rows(spark, rows):
    return spark.createDataFrame(rows, schemas.REQUEST_STATS)


def one(df):
    return df.collect()[0]


def test_join_keeps_copies_single(spark):
    rows = attempt("r1", "p", 0, "ok", stream=True) + attempt("r1", "p", 0, "ok", stream=True)[:1] * 3
    done = facts.attempts_finished(log(spark, rows)).collect()
    assert len(done) == 1 and done[0].stream is True
    assert facts.in_flight(log(spark, rows)).count() == 0


def test_request_stats_from_log(spark):
    rows = (
        attempt("r1", "p", 0, "ok", ms=12.345, stream=True)
        + attempt("r2", "p", 5, "rate_limit_error", status_code=429)
        + attempt("r3", "p", 9, "open")
        + attempt("r4", "q", 12, "ok", endpoint="somewhere")
        + attempt("r5", "p", 20, "ok", endpoint="anthropic/count_tokens", usage=None, input_tokens=42)
    )
    built = facts.build_request_stats(log(spark, rows)).orderBy("request_id").collect()
    assert [(r.request_id, r.provider_type, r.latency_ms, r.is_streaming) for r in built] == [
        ("r1", "openai", round(12.345, 2), True),
        ("r4", "unknown", 100.0, False),
    ]
    assert [r.request_id for r in facts.in_flight(log(spark, rows)).collect()] == ["r3"]
    ttft = spark.createDataFrame([("r1", "p", 3.0)], "request_id string, provider string, time_to_first_token_ms double")
    with_ttft = facts.build_request_stats(log(spark, rows), ttft).orderBy("request_id").collect()
    assert [r.time_to_first_token_ms for r in with_ttft] == [3.0, None]


def test_usage_from_documents(spark):
    rows = [
        {
            "type": "response",
            "request_id": "r",
            "provider": "p",
            "endpoint": "anthropic",
            "full_response": '{"model":"m","stop_reason":"end_turn","usage":{"input_tokens":10,"cache_read_input_tokens":5,"output_tokens":8}}',
        },
        {"type": "response", "request_id": "c", "provider": "p", "endpoint": "anthropic", "full_response": '{"input_tokens":42}'},
    ]
    filled = facts.with_usage(log(spark, rows)).orderBy("request_id").collect()
    assert filled[0].input_tokens == 42 and filled[0].usage is None
    assert tuple(filled[1].usage) == (15, 8, 23, 5) and filled[1].finish_reason == "end_turn"


def counters(spark, total, ok, failed):
    rows = []
    for n in range(total):
        outcome = "ok" if n < ok else "provider_error" if n < ok + failed else "open"
        rows += attempt(f"r{n}", "p", 10 * n, outcome)
    return one(stats.provider_stats(log(spark, rows), stat_rows(spark, [])))


def test_rates(spark):
    r = counters(spark, 10, 5, 2)
    assert (r.total_requests, r.in_progress_requests, r.successful_requests, r.failed_requests) == (10, 3, 5, 2)
    assert r.success_rate == pytest.approx(71.428571, abs=1e-5)
    assert r.failure_rate == pytest.approx(28.571428, abs=1e-5)
    r = counters(spark, 10, 7, 3)
    assert (r.success_rate, r.failure_rate) == (70.0, 30.0)
    r = counters(spark, 3, 0, 0)
    assert (r.success_rate, r.failure_rate, r.average_latency_ms, r.tokens_per_second) == (0.0, 0.0, 0.0, 0.0)


def test_streaming_and_ttft(spark):
    events = log(spark, attempt("r1", "p", 0, "ok", stream=True) + attempt("r2", "p", 5, "ok", ms=50.0))
    rows = [
        (T0, "openai", "p", 100.0, True, 10.0, 10, 20, 5),
        (T0, "openai", "p", 100.0, True, None, 10, 20, 5),
        (T0, "openai", "p", 50.0, False, None, 10, 20, 5),
    ]
    r = one(stats.provider_stats(events, stat_rows(spark, rows)))
    assert (r.streaming_requests, r.streaming_average_latency_ms, r.streaming_average_ttft_ms) == (2, 100.0, 10.0)
    assert r.streaming_tokens_per_second_with_ttft == 40 / 0.2
    assert r.streaming_tokens_per_second_without_ttft == 40 / 0.09  # all tokens, only the row with a first-token time
    assert (r.non_streaming_requests, r.non_streaming_average_latency_ms) == (1, 50.0)
    no_ttft = one(stats.provider_stats(events, stat_rows(spark, rows[1:2])))
    assert (no_ttft.streaming_average_ttft_ms, no_ttft.streaming_tokens_per_second_without_ttft) == (0.0, 0.0)
    assert no_ttft.streaming_tokens_per_second_with_ttft > 0


def test_last_error(spark):
    base = attempt("r1", "p", 0, "rate_limit_error", status_code=429)
    r = one(stats.provider_stats(log(spark, base), stat_rows(spark, [])))
    assert r.last_error == "Rate limit error: boom" and r.total_rate_limits == 1
    r = one(stats.provider_stats(log(spark, base + attempt("r2", "p", 5, "ok")), stat_rows(spark, [])))
    assert r.last_error is None
    # same microsecond: the later line counts
    ok = attempt("r2", "p", 0, "ok")
    r = one(stats.provider_stats(log(spark, ok + base), stat_rows(spark, [])))
    assert r.last_error == "Rate limit error: boom"
    r = one(stats.provider_stats(log(spark, base + ok), stat_rows(spark, [])))
    assert r.last_error is None


def provider_rows(spark, counts, latencies):
    rows, at = [], 0
    for name, n, ms in zip("abc", counts, latencies, strict=True):
        for i in range(n):
            rows += attempt(f"{name}{i}", name, at, "ok", ms=ms)
            at += 10
    return stats.provider_stats(log(spark, rows), stat_rows(spark, []))


def test_most_used_and_fastest(spark):
    ps = provider_rows(spark, (1, 3, 2), (100.0, 50.0, 200.0))
    assert one(stats.most_used(ps)).most_used_provider == "b"
    assert one(stats.fastest(ps)).fastest_provider == "b"
    tie = provider_rows(spark, (2, 2, 1), (0.0, 70.0, 70.0))
    assert one(stats.most_used(tie)).most_used_provider == "a"  # seen first
    assert one(stats.fastest(tie)).fastest_provider == "b"  # a has no positive latency
    nothing = provider_rows(spark, (1, 0, 0), (0.0, 0.0, 0.0))
    assert one(stats.fastest(nothing)).fastest_provider is None


def test_uptime(spark):
    rows = [
        {"type": "configuration", "config_type": "router_start", "at": n, "endpoint": None, "details": '{"endpoint":"openai"}'}
        for n in (0, 100, 500)
    ]
    got = one(stats.uptime(log(spark, rows), T0 + dt.timedelta(seconds=160)))
    assert tuple(got) == ("openai", 60.0)


def failing_chain():
    rows, names = [], ["a", "b", "c"]
    for n, name in enumerate(names):
        kind = ["rate_limit_error", "authentication_error", "unexpected_error"][n]
        rows += attempt("r1", name, 10 * n, kind)
        rows.append(
            {"type": "retry", "request_id": "r1", "provider": name, "attempt": n + 1, "max_attempts": 3, "error_type": kind,
             "retry_after": 0.5 if n == 0 else None, "at": 10 * n + 1}
        )
    rows.append({"type": "error", "request_id": "r1", "provider": "all", "error_type": "no_available_provider", "at": 40})
    return rows + attempt("r2", "a", 50, "rate_limit_error") + attempt("r2", "b", 60, "ok")


def test_chains(spark):
    events = log(spark, failing_chain())
    out = {r.request_id: r for r in chains.request_chains(events).collect()}
    assert (out["r1"].attempts, out["r1"].all_failed, out["r1"].serving_provider, out["r1"].duration_ms) == (3, True, None, 20000.0)
    assert (out["r2"].attempts, out["r2"].failures, out["r2"].serving_provider) == (2, 1, "b")
    assert one(chains.failure_summary(events)).summary == "- a: Rate limited: boom\n- b: boom\n- c: Unexpected error: boom"
    got = one(chains.exhausted(events))
    assert tuple(got) == (1, 2, 0.5)
    retries = {r.error_type: r for r in chains.retry_breakdown(events).collect()}
    assert retries["rate_limit_error"].avg_retry_after == 0.5 and retries["unexpected_error"].avg_retry_after is None
    assert {(r.provider, r.errors) for r in chains.error_breakdown(events).collect() if r.error_type == "rate_limit_error"} == {("a", 2)}
    for slice_s in (1, 7, 1000):
        numbers = chains.attempt_numbers(events, slice_s=slice_s).orderBy("request_id", "attempt_no").collect()
        assert [(r.request_id, r.provider, r.attempt_no) for r in numbers] == [
            ("r1", "a", 1), ("r1", "b", 2), ("r1", "c", 3), ("r2", "a", 1), ("r2", "b", 2),
        ]


def test_skips_count_as_attempts(spark):
    rows = attempt("r1", "c", 0, "ok")
    rows[1]["provider_priority"] = 3
    skips = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 2), ("r1", "d", 4)], "request_id string, provider string, priority int")
    assert one(chains.attempt_numbers(log(spark, rows), skips)).attempt_no == 3


def test_metrics(spark):
    ps = provider_rows(spark, (3, 0, 0), (0.0, 0.0, 0.0))
    long = publish.metrics(ps, stats.router_totals(ps), prefix="x_")
    names = {r.name: r.value for r in long.collect()}
    assert names["x_provider_success_rate"] == 1.0
    assert "x_provider_latency_seconds" not in names  # only if positive
    lines = [r.line for r in publish.metrics_text(long, "1.2", "x_").collect()]
    assert lines[:3] == ["# HELP x_info Version of the software that wrote these lines", "# TYPE x_info gauge", 'x_info{version="1.2"} 1']
    assert 'x_provider_requests_total{provider_type="openai",provider="a"} 3' in lines
    assert sum(line.startswith("# TYPE x_provider_requests_total ") for line in lines) == 1
    at = lines.index('x_requests_total{provider_type="openai"} 3')
    assert lines[at - 2 : at] == ["# HELP x_requests_total Finished requests of this type", "# TYPE x_requests_total counter"]
    nothing = publish.metrics_text(long.filter("false"), "1.2", "x_").collect()
    assert [r.line for r in nothing] == ["# No metrics available"]


def test_repeated_provider_names(spark):
    """A name configured twice is one provider, its first entry counts."""
    configured = spark.createDataFrame(
        [("openai", "a", 1, 0, "u1"), ("openai", "b", 2, 1, "u2"), ("openai", "a", 3, 2, "u3")],
        "provider_type string, provider string, priority int, position int, base_url string",
    ).withColumn("model_mapping", F.lit(None).cast("map<string,string>"))
    failures = spark.createDataFrame([("openai", "a"), ("openai", "b")], "provider_type string, provider string")
    got = {(r.provider, r.from_priority, r.to_provider) for r in chains.next_provider(failures, configured).collect()}
    assert got == {("a", 1, "b"), ("b", 2, "a")}
    seen = spark.createDataFrame([("openai", "a", 5)], "provider_type string, provider string, total_requests long")
    rows = {(r.provider, r.base_url, r.total_requests) for r in providers.with_statistics(configured, seen).collect()}
    assert rows == {("a", "u1", 5), ("b", "u2", 0)}
