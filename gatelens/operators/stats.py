"""Counters and derived rates per provider, and totals over providers.

All counts, sums and times of one table come from one hash aggregation with map-side partial sums; only fixed-width
values are in its buffers, so Spark does not fall back to sorting. Ratios are taken after the sums.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions import derive
from gatelens.operators.cooldown import as_us, keys_of, order_key_us
from gatelens.operators.facts import attempts_finished, terminals
from gatelens.operators.reports import ts_literal, us_to_ms, whole_us

KEY = ["provider_type", "provider"]


def order_key(ts: str = "timestamp", seq: str = "seq") -> Column:
    """(time, seq) as one number, so that "the latest" is a plain max in a hash aggregation."""
    return order_key_us(as_us(F.col(ts)), F.col(seq))


def _zero(column: Column, default=0) -> Column:
    return F.coalesce(column, F.lit(default))


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 if the bottom is not positive or missing."""
    return F.coalesce(F.when(bottom > 0, top.cast("double") / bottom.cast("double")), F.lit(0.0))


def event_counters(events: DataFrame) -> DataFrame:
    """Counters that need single events only: totals, failures, tokens, overall latency, times."""
    rows = events.filter(
        (F.col("type") == "request") | (F.col("type").isin("response", "error") & (F.col("provider") != "all"))
    ).withColumn("provider_type", derive.provider_type(F.col("endpoint")))
    is_request = F.col("type") == "request"
    is_ok = F.col("type") == "response"
    is_error = F.col("type") == "error"
    prompt = F.coalesce("usage.prompt_tokens", "input_tokens", F.lit(0))
    completion = F.coalesce("usage.completion_tokens", F.lit(0))
    cached = F.coalesce("usage.cached_tokens", F.lit(0))
    return rows.groupBy(*KEY).agg(
        F.count_if(is_request).alias("total_requests"),
        F.count_if(is_ok).alias("successful_requests"),
        F.count_if(is_error).alias("failed_requests"),
        F.count_if(is_error & (F.col("status_code") == 429)).alias("total_rate_limits"),
        _zero(F.sum(F.when(is_ok, prompt))).alias("total_input_tokens"),
        _zero(F.sum(F.when(is_ok, completion))).alias("total_output_tokens"),
        _zero(F.sum(F.when(is_ok, cached))).alias("total_cached_tokens"),
        us_to_ms(_zero(F.sum(F.when(is_ok, whole_us("duration_ms"))))).alias("total_latency_ms"),
        F.min(F.when(is_request, F.col("timestamp"))).alias("first_request_time"),
        F.max(F.when(is_request, F.col("timestamp"))).alias("last_request_time"),
        F.max(F.when(is_ok, F.col("timestamp"))).alias("last_success_time"),
        F.max(F.when(is_ok, order_key())).alias("last_success_key"),
    )


def last_errors(events: DataFrame) -> DataFrame:
    """Label of the latest error per provider; only error events are read."""
    errors = terminals(events).filter(F.col("type") == "error")
    return (
        errors.withColumn("provider_type", derive.provider_type(F.col("endpoint")))
        .groupBy(*KEY)
        .agg(
            F.max_by(
                F.struct(derive.failure_label(F.col("error_type"), F.col("error_message")).alias("label")),
                order_key(),
            ).alias("e"),
            F.max(order_key()).alias("last_error_key"),
        )
        .select(*KEY, F.col("e.label").alias("label"), "last_error_key")
    )


def non_streaming_counters(finished: DataFrame) -> DataFrame:
    """Requests, latency and output tokens of non-streaming successes, count_tokens calls included."""
    rows = finished.filter((F.col("outcome") == "success") & ~F.coalesce("stream", F.lit(False)))
    return (
        rows.withColumn("provider_type", derive.provider_type(F.col("endpoint")))
        .groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("non_streaming_requests"),
            us_to_ms(_zero(F.sum(whole_us("duration_ms")))).alias("non_streaming_total_latency_ms"),
            _zero(F.sum("output_tokens")).alias("non_streaming_output_tokens"),
        )
    )


def streaming_counters(request_stats: DataFrame) -> DataFrame:
    """Streaming latency, time to first token and generation time; these live in the request stats only."""
    latency = whole_us("latency_ms")
    ttft = whole_us("time_to_first_token_ms")
    has_ttft = F.col("time_to_first_token_ms") > 0
    generation = latency - ttft
    return (
        request_stats.filter("is_streaming")
        .groupBy("provider_type", F.col("provider_name").alias("provider"))
        .agg(
            F.count(F.lit(1)).alias("streaming_requests"),
            us_to_ms(_zero(F.sum(latency))).alias("streaming_total_latency_ms"),
            _zero(F.sum("output_tokens")).alias("streaming_output_tokens"),
            us_to_ms(_zero(F.sum(F.when(has_ttft, ttft)))).alias("streaming_ttft_ms"),
            F.count_if(has_ttft).alias("streaming_ttft_count"),
            us_to_ms(_zero(F.sum(F.when(has_ttft & (generation > 0), generation)))).alias(
                "streaming_generation_time_ms"
            ),
        )
    )


def provider_stats(
    events: DataFrame,
    request_stats: DataFrame,
    cooldown: DataFrame | None = None,
    finished: DataFrame | None = None,
) -> DataFrame:
    """One row per provider with all counters and derived rates.

    ``finished`` (default :func:`attempts_finished`) gives the stream flag of successes; pass a stored attempts table
    to save the join. ``cooldown`` is the output of ``cooldown_status``. Every joined table has one row per provider.
    """
    if finished is None:
        answered = events.filter(F.col("type").isin("request", "response"))
        finished = attempts_finished(answered, start_columns=["endpoint", "stream"])
    joined = (
        event_counters(events)
        .join(non_streaming_counters(finished), KEY, "left")
        # the two tables may cover different times: a provider of either is listed
        .join(streaming_counters(request_stats), KEY, "full")
        .join(last_errors(events), KEY, "left")
    )
    counts = [
        "total_requests",
        "successful_requests",
        "failed_requests",
        "total_rate_limits",
        "total_input_tokens",
        "total_output_tokens",
        "total_cached_tokens",
        "non_streaming_requests",
        "non_streaming_output_tokens",
        "streaming_requests",
        "streaming_output_tokens",
        "streaming_ttft_count",
    ]
    sums = [
        "total_latency_ms",
        "non_streaming_total_latency_ms",
        "streaming_total_latency_ms",
        "streaming_ttft_ms",
        "streaming_generation_time_ms",
    ]
    joined = joined.withColumns({c: _zero(F.col(c)) for c in counts} | {c: _zero(F.col(c), 0.0) for c in sums})
    if cooldown is not None:
        joined = joined.join(cooldown, keys_of(cooldown), "left").withColumns(
            {
                "in_cooldown": _zero(F.col("in_cooldown"), False),
                "cooldown_remaining_seconds": _zero(F.col("cooldown_remaining_seconds"), 0.0),
                "recent_rate_limits": _zero(F.col("recent_rate_limits")),
                "cooldown_count": _zero(F.col("cooldown_count")),
                "total_cooldown_time_seconds": _zero(F.col("total_cooldown_time_seconds"), 0.0),
            }
        )
    ok, failed = F.col("successful_requests"), F.col("failed_requests")
    cleared = F.col("last_success_key") > F.col("last_error_key")
    derived = {
        "in_progress_requests": F.col("total_requests") - ok - failed,
        "total_tokens": F.col("total_input_tokens") + F.col("total_output_tokens"),
        "success_rate": _ratio(ok, ok + failed) * 100,
        "failure_rate": _ratio(failed, ok + failed) * 100,
        "non_streaming_average_latency_ms": _ratio(
            F.col("non_streaming_total_latency_ms"), F.col("non_streaming_requests")
        ),
        "non_streaming_tokens_per_second": _ratio(
            F.col("non_streaming_output_tokens"), F.col("non_streaming_total_latency_ms") / 1000
        ),
        "streaming_average_latency_ms": _ratio(F.col("streaming_total_latency_ms"), F.col("streaming_requests")),
        "streaming_average_ttft_ms": _ratio(F.col("streaming_ttft_ms"), F.col("streaming_ttft_count")),
        "streaming_tokens_per_second_with_ttft": _ratio(
            F.col("streaming_output_tokens"), F.col("streaming_total_latency_ms") / 1000
        ),
        # all streaming output tokens over the generation time of the rows that have a time to first token
        "streaming_tokens_per_second_without_ttft": _ratio(
            F.col("streaming_output_tokens"), F.col("streaming_generation_time_ms") / 1000
        ),
        "average_latency_ms": _ratio(F.col("total_latency_ms"), ok),
        "tokens_per_second": _ratio(F.col("total_output_tokens"), F.col("total_latency_ms") / 1000),
        "last_error": F.when(~_zero(cleared, False), F.col("label")),
    }
    return joined.withColumns(derived).drop("label", "last_error_key", "last_success_key")


def router_totals(stats: DataFrame, uptime_: DataFrame | None = None) -> DataFrame:
    """Totals per provider type with the most used and the fastest provider; ties go to the one seen first."""
    seen = F.col("first_request_time")
    fast = F.col("average_latency_ms") > 0
    totals = stats.groupBy("provider_type").agg(
        F.sum("total_requests").alias("total_requests"),
        F.sum("total_input_tokens").alias("total_input_tokens"),
        F.sum("total_output_tokens").alias("total_output_tokens"),
        F.sum("total_cached_tokens").alias("total_cached_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.max_by("provider", F.struct("total_requests", (-as_us(seen)).alias("seen"))).alias("most_used_provider"),
        F.min_by(
            "provider", F.when(fast, F.struct(F.col("average_latency_ms"), as_us(seen).alias("seen")))
        ).alias("fastest_provider"),
    )
    return totals if uptime_ is None else totals.join(uptime_, "provider_type", "left")


def most_used(stats: DataFrame) -> DataFrame:
    return router_totals(stats).select("provider_type", "most_used_provider")


def fastest(stats: DataFrame) -> DataFrame:
    return router_totals(stats).select("provider_type", "fastest_provider")


def uptime(events: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Seconds since the last start of each router. The start event names its endpoint in the details."""
    started = events.filter((F.col("type") == "configuration") & (F.col("config_type") == "router_start"))
    endpoint = F.coalesce("endpoint", F.try_variant_get("details", "$.endpoint", "string"))
    at = ts_literal(as_of)
    return (
        started.filter(F.col("timestamp").cast("timestamp") <= at)
        .groupBy(derive.provider_type(F.coalesce(endpoint, F.lit(""))).alias("provider_type"))
        .agg(((as_us(at) - as_us(F.max("timestamp"))) / 1_000_000).alias("uptime_seconds"))
    )
