"""Explicit schemas of all tables. Nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

REQUEST_STATS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("provider_type", T.StringType()),
        T.StructField("provider_name", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("is_streaming", T.BooleanType()),
        T.StructField("time_to_first_token_ms", T.DoubleType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cached_tokens", T.LongType()),
    ]
)

USAGE = T.StructType(
    [
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("cached_tokens", T.LongType()),
    ]
)

OFFERED = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("priority", T.IntegerType())])
)

# Union of the fields of all event types; payloads with an open schema stay VARIANT.
ROUTER_EVENTS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("type", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("provider_priority", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("message_count", T.IntegerType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("stream", T.BooleanType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("full_request", T.VariantType()),
        T.StructField("response_id", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("usage", USAGE),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("full_response", T.VariantType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("max_attempts", T.IntegerType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("retry_after", T.DoubleType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("from_provider", T.StringType()),
        T.StructField("from_priority", T.IntegerType()),
        T.StructField("to_provider", T.StringType()),
        T.StructField("to_priority", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("selected_provider", T.StringType()),
        T.StructField("selected_priority", T.IntegerType()),
        T.StructField("available_providers", OFFERED),
        T.StructField("config_type", T.StringType()),
        T.StructField("details", T.VariantType()),
    ]
)

PROVIDERS = T.StructType(
    [
        T.StructField("provider_type", T.StringType()),
        T.StructField("api_key", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("base_url", T.StringType()),
        T.StructField("timeout", T.IntegerType()),
        T.StructField("max_retries", T.IntegerType()),
        T.StructField("model_mapping", T.MapType(T.StringType(), T.StringType())),
        T.StructField("provider_name", T.StringType()),
        T.StructField("position", T.IntegerType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("provider_type", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("data", T.BinaryType()),
    ]
)
