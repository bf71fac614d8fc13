"""Fact tables derived from the event log: attempts, in-flight calls, request stats.

Requests are first reduced to one row per (request_id, provider). Joins from terminal events to that table are then
many-to-one: copies of an event can never multiply rows, and hot keys are kept out of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions import derive
from gatelens.functions import usage as U

KEY = ["request_id", "provider"]
FINAL_FAILURE = "all"  # fixed value: provider of the error event that closes an exhausted request


START_COLUMNS = {
    "start_ts": "timestamp",
    "start_seq": "seq",
    "endpoint": "endpoint",
    "provider_priority": "provider_priority",
    "requested_model": "model",
    "stream": "stream",
    "user_agent": "user_agent",
}


def starts(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The first request event per (request_id, provider), with all of ``START_COLUMNS`` or those named."""
    names = columns or list(START_COLUMNS)
    requests = events.filter(F.col("type") == "request")
    first = F.min_by(F.struct(*[F.col(START_COLUMNS[n]).alias(n) for n in names]), F.struct("timestamp", "seq"))
    return (
        requests.groupBy(*KEY)
        .agg(first.alias("s"))
        .select(*KEY, *[F.coalesce("s.stream", F.lit(False)).alias(n) if n == "stream" else F.col(f"s.{n}") for n in names])
    )


def terminals(events: DataFrame) -> DataFrame:
    """Response and error events of single attempts."""
    return events.filter(
        F.col("type").isin("response", "error") & (F.coalesce("provider", F.lit("")) != FINAL_FAILURE)
    )


def count_tokens_event(events: DataFrame | None = None) -> Column:
    """A response event of a token-count call: input tokens without usage."""
    return (F.col("type") == "response") & F.col("input_tokens").isNotNull() & F.col("usage").isNull()


def attempts_finished(
    events: DataFrame, ttft: DataFrame | None = None, start_columns: list[str] | None = None
) -> DataFrame:
    """Terminal events with the start of their attempt.

    ``ttft`` (request_id, provider, time_to_first_token_ms) is attached to the starts, where every key is single.
    ``start_columns`` (with the endpoint) names those of ``starts`` to carry through the join; all by default.
    """
    started = starts(events, start_columns)
    if ttft is not None:
        one = ttft.groupBy(*KEY).agg(F.min("time_to_first_token_ms").alias("time_to_first_token_ms"))
        started = started.join(one, KEY, "left")
    done = terminals(events).select(
        *KEY,
        F.col("endpoint").alias("terminal_endpoint"),
        F.col("timestamp").alias("end_ts"),
        F.col("seq").alias("end_seq"),
        F.when(F.col("type") == "response", F.lit("success")).otherwise(F.lit("failed")).alias("outcome"),
        count_tokens_event().alias("is_count_tokens"),
        F.col("duration_ms"),
        F.coalesce("usage.prompt_tokens", "input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("usage.completion_tokens", F.lit(0)).alias("output_tokens"),
        F.coalesce("usage.cached_tokens", F.lit(0)).alias("cached_tokens"),
        "model",
        "finish_reason",
        "error_type",
        "error_message",
        "status_code",
    )
    joined = done.join(started, KEY, "left")
    return joined.withColumn("endpoint", F.coalesce("endpoint", "terminal_endpoint")).drop("terminal_endpoint")


def in_flight(events: DataFrame) -> DataFrame:
    """Attempts that started and have no terminal event."""
    return starts(events).join(terminals(events).select(*KEY).distinct(), KEY, "left_anti")


def attempts(events: DataFrame) -> DataFrame:
    """One row per attempt: finished ones with their outcome, open ones as ``in_progress``."""
    finished = attempts_finished(events)
    still_open = in_flight(events).withColumn("outcome", F.lit("in_progress"))
    rows = finished.unionByName(still_open, allowMissingColumns=True)
    return rows.withColumn("provider_type", derive.provider_type(F.col("endpoint")))


def with_usage(events: DataFrame) -> DataFrame:
    """Fill usage, finish reason and model of response events from the vendor document.

    The format is chosen by the endpoint; events without a document keep what they have.
    """
    doc = F.col("full_response")
    parsed = (F.col("type") == "response") & doc.isNotNull()
    counting = parsed & U.is_count_tokens(doc)
    type_ = derive.provider_type(F.col("endpoint"))
    return events.withColumns(
        {
            "usage": F.when(parsed & ~counting, U.usage(doc, type_)).otherwise(F.col("usage")),
            "finish_reason": F.when(parsed & ~counting, U.finish_reason(doc)).otherwise(F.col("finish_reason")),
            "input_tokens": F.when(counting, F.try_variant_get(doc, "$.input_tokens", "bigint")).otherwise(
                F.col("input_tokens")
            ),
        }
    )


def build_request_stats(events: DataFrame, ttft: DataFrame | None = None) -> DataFrame:
    """Request stats from the event log: one row per successful chat completion, with its ``request_id``.

    The log has no time to first token; ``ttft`` (request_id, provider, time_to_first_token_ms) may supply it.
    """
    answered = events.filter(F.col("type").isin("request", "response"))
    ok = attempts_finished(answered, ttft, ["endpoint", "stream"]).filter((F.col("outcome") == "success") & ~F.col("is_count_tokens"))
    if ttft is None:
        ok = ok.withColumn("time_to_first_token_ms", F.lit(None).cast("double"))
    return ok.select(
        "request_id",
        F.col("end_ts").alias("timestamp"),
        derive.provider_type(F.col("endpoint")).alias("provider_type"),
        F.col("provider").alias("provider_name"),
        derive.round_ms(F.col("duration_ms")).alias("latency_ms"),
        F.coalesce("stream", F.lit(False)).alias("is_streaming"),
        derive.round_ms(F.col("time_to_first_token_ms")).alias("time_to_first_token_ms"),
        "input_tokens",
        "output_tokens",
        "cached_tokens",
    )
