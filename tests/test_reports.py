import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gatelens import schemas
from gatelens.operators import reports as R

AS_OF = dt.datetime(2024, 1, 2, 10, 30)


def row(ts, type_="openai", name="p", latency=100.0, streaming=False, ttft=None, i=10, o=20, c=5):
    return (ts.replace(tzinfo=dt.timezone.utc), type_, name, latency, streaming, ttft, i, o, c)


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.REQUEST_STATS)


def test_buckets_bounds_and_gaps(spark):
    rows = [
        row(AS_OF - dt.timedelta(hours=24)),  # on the bound: counted
        row(AS_OF - dt.timedelta(hours=24, microseconds=1)),  # before it, though in the same bucket
        row(AS_OF),
        row(AS_OF + dt.timedelta(hours=3)),  # outside the buckets
    ]
    out = R.requests_over_time(table(spark, rows), AS_OF).collect()
    assert len(out) == 25
    assert [r["count"] for r in out] == [1] + [0] * 23 + [1]
    assert out[0]["timestamp"] == dt.datetime(2024, 1, 1, 10)


def test_empty_source_has_only_the_spine(spark):
    out = R.tokens_over_time(table(spark, []), AS_OF, "day", 48).collect()
    assert [tuple(r)[1:] for r in out] == [(0, 0, 0, 0)] * 3


def test_null_tokens_add_nothing(spark):
    rows = [row(AS_OF), row(AS_OF, i=None), row(AS_OF, o=None)]
    out = R.tokens_over_time(table(spark, rows), AS_OF, "hour", 1).collect()[-1]
    assert (out.input_tokens, out.output_tokens, out.total_tokens) == (20, 40, 30)


def test_provider_type_filter(spark):
    rows = [row(AS_OF), row(AS_OF, "anthropic")]
    for asked, n in ((None, 2), ("", 2), ("openai", 1), ("other", 0)):
        assert R.requests_over_time(table(spark, rows), AS_OF, "hour", 1, asked).collect()[-1]["count"] == n


def test_summary(spark):
    rows = [
        row(AS_OF - dt.timedelta(minutes=n), name=f"provider-{n % 2}", latency=100.0 + 10 * n, streaming=n % 2 == 0)
        for n in range(5)
    ] + [row(AS_OF + dt.timedelta(days=9), name="provider-0", streaming=None)]
    out = R.provider_summary(table(spark, rows), AS_OF).collect()
    assert [(r.provider_name, r.request_count, r.streaming_count, r.non_streaming_count) for r in out] == [
        ("provider-0", 4, 3, 0),  # rows after as_of count here, an unknown stream flag in neither column
        ("provider-1", 2, 0, 2),
    ]
    assert out[1].avg_latency_ms == 120.0
    assert out[1].total_tokens == 60


def test_argument_checks(spark):
    empty = table(spark, [])
    with pytest.raises(ValueError):
        R.requests_over_time(empty, AS_OF, "week")
    with pytest.raises(ValueError):
        R.requests_over_time(empty, AS_OF, "hour", 721)
    R.requests_over_time(empty, AS_OF, "hour", 721, strict=False)
    with pytest.raises(ValueError):
        R.provider_summary(empty, AS_OF, hours=1, from_utc="2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        R.provider_summary(empty, AS_OF, from_utc="yesterday")
    assert R.parse_utc("2024-01-15T10:30:00+02:00") == dt.datetime(2024, 1, 15, 8, 30)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.integers(-100_000, 100_000), max_size=30),
    st.sampled_from(["minute", "hour", "day"]),
    st.integers(1, 30),
)
def test_series_and_rollup_agree(spark, offsets, interval, hours):
    rows = [row(AS_OF + dt.timedelta(seconds=s), i=n, o=2 * n) for n, s in enumerate(offsets)]
    df = table(spark, rows)
    series = R.requests_over_time(df, AS_OF, interval, hours).collect()
    again = R.requests_over_time_from_rollup(R.rollup(df), df, AS_OF, interval, hours).collect()
    assert series == again
    bound = AS_OF - dt.timedelta(hours=hours)
    last = {"minute": 60, "hour": 3600, "day": 86400}[interval]
    end = series[-1]["timestamp"] + dt.timedelta(seconds=last)
    inside = [s for s in offsets if bound <= AS_OF + dt.timedelta(seconds=s) < end]
    assert sum(r["count"] for r in series) == len(inside)
    tokens = R.tokens_over_time_from_rollup(R.rollup(df), df, AS_OF, interval, hours).collect()
    assert tokens == R.tokens_over_time(df, AS_OF, interval, hours).collect()
    assert (
        R.provider_summary_from_rollup(R.rollup(df), df, AS_OF, hours=hours).collect()
        == R.provider_summary(df, AS_OF, hours=hours).collect()
    )
