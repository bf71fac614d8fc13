"""Status document, metrics table and its text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions import derive

# Metric names without prefix, type, help text, and the column (or expression) that holds the value, in
# the order of the export. The last field tells if the metric is left out unless positive.
TYPE_METRICS = [
    ("uptime_seconds", "gauge", "Seconds from the first logged event to the report time", "uptime_seconds", False),
    ("requests_total", "counter", "Finished requests of this type", "total_requests", False),
    ("input_tokens_total", "counter", "Prompt tokens sent to this type", "total_input_tokens", False),
    ("output_tokens_total", "counter", "Completion tokens received from this type", "total_output_tokens", False),
    ("cached_tokens_total", "counter", "Prompt tokens this type read from a cache", "total_cached_tokens", False),
    ("total_tokens", "counter", "Prompt and completion tokens of this type together", "total_tokens", False),
]
PROVIDER_METRICS = [
    ("provider_requests_total", "counter", "Finished requests of this provider", "total_requests", False),
    ("provider_requests_in_progress", "gauge", "Requests sent to this provider and not ended yet", "in_progress_requests", False),
    ("provider_requests_successful_total", "counter", "Requests this provider answered", "successful_requests", False),
    ("provider_requests_failed_total", "counter", "Requests this provider ended with an error", "failed_requests", False),
    ("provider_input_tokens_total", "counter", "Prompt tokens sent to this provider", "total_input_tokens", False),
    ("provider_output_tokens_total", "counter", "Completion tokens received from this provider", "total_output_tokens", False),
    ("provider_cached_tokens_total", "counter", "Prompt tokens this provider read from a cache", "total_cached_tokens", False),
    ("provider_streaming_requests_total", "counter", "Requests answered as a stream", "streaming_requests", False),
    (
        "provider_non_streaming_requests_total",
        "counter",
        "Requests answered in one piece",
        "non_streaming_requests",
        False,
    ),
    ("provider_latency_seconds", "gauge", "Mean seconds from sending to the end of an answer", "average_latency_ms / 1000", True),
    (
        "provider_streaming_latency_seconds",
        "gauge",
        "Mean seconds to the end of a streamed answer",
        "streaming_average_latency_ms / 1000",
        True,
    ),
    (
        "provider_non_streaming_latency_seconds",
        "gauge",
        "Mean seconds to an answer in one piece",
        "non_streaming_average_latency_ms / 1000",
        True,
    ),
    (
        "provider_time_to_first_token_seconds",
        "gauge",
        "Mean seconds to the first chunk of a stream",
        "streaming_average_ttft_ms / 1000",
        True,
    ),
    ("provider_tokens_per_second", "gauge", "Completion tokens for each second of latency", "tokens_per_second", True),
    (
        "provider_streaming_tokens_per_second",
        "gauge",
        "Completion tokens for each second of a stream, waiting included",
        "streaming_tokens_per_second_with_ttft",
        True,
    ),
    ("provider_success_rate", "gauge", "Share of finished requests that were answered", "success_rate / 100", False),
    ("provider_rate_limits_total", "counter", "Errors of this provider that were rate limits", "total_rate_limits", False),
    ("provider_recent_rate_limits", "gauge", "Rate limits inside the window that ends now", "recent_rate_limits", False),
    ("provider_cooldowns_total", "counter", "Pauses this provider was put into", "cooldown_count", False),
    (
        "provider_cooldown_time_seconds_total",
        "counter",
        "Seconds of all pauses of this provider so far",
        "total_cooldown_time_seconds",
        False,
    ),
    ("provider_in_cooldown", "gauge", "1 while this provider is paused, else 0", "cast(in_cooldown as int)", False),
    (
        "provider_cooldown_remaining_seconds",
        "gauge",
        "Seconds until the pause of this provider ends",
        "cooldown_remaining_seconds",
        True,
    ),
]
INFO_METRIC = ("info", "gauge", "Version of the software that wrote these lines")
NO_METRICS = "# No metrics available"


def _long(df: DataFrame, metrics: list, offset: int, provider: Column, prefix: str) -> DataFrame:
    """One row per input row and metric, by one explode of an array of structs."""
    cells = F.array(
        *[
            F.struct(
                F.lit(offset + i).alias("position"),
                F.lit(prefix + name).alias("name"),
                F.lit(kind).alias("type"),
                F.lit(text).alias("help"),
                F.expr(value).cast("double").alias("value"),
                F.lit(positive).alias("only_positive"),
            )
            for i, (name, kind, text, value, positive) in enumerate(metrics)
        ]
    )
    rows = df.select("provider_type", provider.alias("provider"), F.inline(cells))
    return rows.filter("value is not null and (not only_positive or value > 0)").drop("only_positive")


def metrics(stats: DataFrame, totals: DataFrame, prefix: str = "gateway_") -> DataFrame:
    """All metrics in long form: position, name, type, help, provider_type, provider, value."""
    nobody = F.lit(None).cast("string")
    have = set(totals.columns)
    type_metrics = [m for m in TYPE_METRICS if m[3] in have]
    have = set(stats.columns)
    no_cooldown = {"recent_rate_limits", "cooldown_count", "total_cooldown_time_seconds", "cast(in_cooldown as int)",
                   "cooldown_remaining_seconds"}
    provider_metrics = [m for m in PROVIDER_METRICS if m[3] not in no_cooldown or "in_cooldown" in have]
    return _long(totals, type_metrics, 1, nobody, prefix).unionByName(
        _long(stats, provider_metrics, 100, F.col("provider"), prefix)
    )


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _number(value: Column) -> Column:
    """Whole numbers without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def metrics_text(long: DataFrame, version: str, prefix: str = "gateway_") -> DataFrame:
    """Text exposition lines in order (columns ``ord``, ``line``); HELP and TYPE stand once before each name.

    Without any metric the only line says so.
    """
    labels = F.concat(
        F.lit('{provider_type="'),
        _escaped(F.col("provider_type")),
        F.lit('"'),
        F.when(F.col("provider").isNotNull(), F.concat(F.lit(',provider="'), _escaped(F.col("provider")), F.lit('"')))
        .otherwise(F.lit("")),
        F.lit("}"),
    )
    sample = F.concat(F.col("name"), labels, F.lit(" "), _number(F.col("value")))
    first = Window.partitionBy("name").orderBy("provider_type", F.col("provider").asc_nulls_first())
    rows = long.withColumns({"n": F.row_number().over(first), "sample": sample})
    head = F.array(
        F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), F.col("help")),
        F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" "), F.col("type")),
        F.col("sample"),
    )
    lines = rows.select(
        "position", "n", F.posexplode(F.when(F.col("n") == 1, head).otherwise(F.array("sample"))).alias("i", "line")
    ).select(F.struct("position", "n", "i").alias("ord"), "line")
    spark = long.sparkSession
    name, kind, text = INFO_METRIC
    info = [
        f"# HELP {prefix}{name} {text}",
        f"# TYPE {prefix}{name} {kind}",
        f'{prefix}{name}{{version="{version}"}} 1',
    ]
    some = long.limit(1).select(F.lit(1).alias("some")).agg(F.count("some").alias("some"))
    fixed = some.select(
        F.explode(
            F.when(F.col("some") > 0, F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("line")) for i, x in enumerate(info)]))
            .otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(NO_METRICS).alias("line"))))
        ).alias("f")
    ).select(F.struct(F.lit(0).alias("position"), F.lit(0).alias("n"), F.col("f.i").alias("i")).alias("ord"), "f.line")
    return fixed.unionByName(lines).orderBy("ord")


def write_metrics_text(lines: DataFrame, path: str) -> None:
    """Write the exposition as one text file; its size is bounded by the number of providers."""
    lines.orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def status_json(providers: DataFrame, counts: DataFrame, stats: DataFrame, totals: DataFrame) -> DataFrame:
    """The status document as one JSON row. Values are rounded here only; API keys are never part of it.

    ``providers`` with display names, ``counts`` from ``provider_counts``, ``stats`` with cooldown columns. The
    document lists every provider, so its size is that of the configuration.
    """

    def r(name: str) -> Column:
        return derive.round_ms(F.col(name))

    config = providers.groupBy("provider_type").agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "priority", "position", F.col("provider").alias("name"), "base_url",
                        F.to_json("model_mapping").alias("mapping"),
                    )
                )
            ),
            lambda p: F.struct(
                p["name"].alias("name"),
                p["priority"].alias("priority"),
                p["base_url"].alias("base_url"),
                F.from_json(p["mapping"], "map<string,string>").alias("model_mapping"),
            ),
        ).alias("providers")
    )
    config_map = counts.join(config, "provider_type", "left").agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "provider_type",
                        F.to_json(
                            F.struct("enabled", "provider_count", F.coalesce("providers", F.array()).alias("providers")),
                            {"ignoreNullFields": "false"},
                        ).alias("v"),
                    )
                )
            )
        ).alias("config")
    )
    one = F.to_json(
        F.struct(
            "total_requests",
            "in_progress_requests",
            "successful_requests",
            "failed_requests",
            r("success_rate").alias("success_rate"),
            r("failure_rate").alias("failure_rate"),
            "total_input_tokens",
            "total_output_tokens",
            "total_tokens",
            "total_cached_tokens",
            derive.iso_utc(F.col("last_request_time").cast("timestamp")).alias("last_request_time"),
            derive.iso_utc(F.col("last_success_time").cast("timestamp")).alias("last_success_time"),
            "last_error",
            F.struct(
                "total_rate_limits",
                "recent_rate_limits",
                "cooldown_count",
                r("total_cooldown_time_seconds").alias("total_cooldown_time_seconds"),
                "in_cooldown",
                r("cooldown_remaining_seconds").alias("cooldown_remaining_seconds"),
                derive.iso_utc(F.col("last_cooldown_start_ts").cast("timestamp")).alias("last_cooldown_start_time"),
            ).alias("rate_limits"),
            F.struct(
                F.col("non_streaming_requests").alias("requests"),
                r("non_streaming_average_latency_ms").alias("average_latency_ms"),
                r("non_streaming_tokens_per_second").alias("tokens_per_second"),
            ).alias("non_streaming"),
            F.struct(
                F.col("streaming_requests").alias("requests"),
                r("streaming_average_ttft_ms").alias("average_time_to_first_token_ms"),
                r("streaming_average_latency_ms").alias("average_total_latency_ms"),
                r("streaming_tokens_per_second_with_ttft").alias("tokens_per_second_with_first_token"),
                r("streaming_tokens_per_second_without_ttft").alias("tokens_per_second_without_first_token"),
            ).alias("streaming"),
            r("average_latency_ms").alias("average_latency_ms"),
            r("tokens_per_second").alias("tokens_per_second"),
        ),
        {"ignoreNullFields": "false"},
    )
    by_type = stats.select("provider_type", "provider", one.alias("v")).groupBy("provider_type").agg(
        F.array_sort(F.collect_list(F.struct("provider", "v"))).alias("entries")
    )
    scalar = [c for c in totals.columns if c != "provider_type"]
    statistics = (
        totals.join(by_type, "provider_type", "left")
        .select(
            "provider_type",
            F.concat(
                F.regexp_replace(F.to_json(F.struct(*scalar), {"ignoreNullFields": "false"}), r"\}$", ""),
                F.lit(',"providers":'),
                _object("entries", "provider"),
                F.lit("}"),
            ).alias("v"),
        )
        .agg(F.array_sort(F.collect_list(F.struct("provider_type", "v"))).alias("entries"))
        .select(F.when(F.size("entries") > 0, _object("entries", "provider_type")).otherwise(F.lit("null")).alias("s"))
    )
    config_text = config_map.select(_object("map_entries(config)", "key", "value").alias("c"))
    parts = config_text.select(F.col("c").alias("t"), F.lit(0).alias("i")).unionByName(
        statistics.select(F.col("s").alias("t"), F.lit(1).alias("i"))
    )
    return parts.agg(
        F.concat(
            F.lit('{"status":"healthy","config":'),
            F.max(F.when(F.col("i") == 0, F.col("t"))),
            F.lit(',"statistics":'),
            F.max(F.when(F.col("i") == 1, F.col("t"))),
            F.lit("}"),
        ).alias("status")
    )


def _object(entries: str, key: str, value: str = "v") -> Column:
    """JSON object text from an array of (key, JSON text) structs."""
    quoted = f"substring(to_json(array(e.{key})), 2, length(to_json(array(e.{key}))) - 2)"
    return F.expr(f"concat('{{', array_join(transform({entries}, e -> concat({quoted}, ':', e.{value})), ','), '}}')")
