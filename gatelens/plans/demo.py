"""Gateway tables derived from the test tables, so that every operator can be run and checked on them.

``events`` becomes request stats and an event log (one attempt per row), ``supplier`` a provider configuration,
``conversations`` and ``documents`` recorded response streams. All columns are plain functions of the source row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens import schemas
from gatelens.functions import derive

AS_OF = dt.datetime(2024, 1, 30, 12, 34, 56)
FROM_UTC = "2024-01-10T06:00:00Z"
# The test events are sparse, so bursts are looked for in a wider window.
WINDOW_S, COOLDOWN_S, THRESHOLD = 10_800, 36_000, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _type() -> Column:
    kind = F.col("user_id") % 3
    return F.when(kind == 0, "anthropic").when(kind == 1, "openai").otherwise("unknown")


def _provider() -> Column:
    return F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))


def stats_of(events: DataFrame) -> DataFrame:
    """Request stats from rows of ``events`` (also from a stream of them)."""
    streaming = F.col("event_type").isin("view", "click")
    return events.select(
        F.col("ts").alias("timestamp"),
        _type().alias("provider_type"),
        _provider().alias("provider_name"),
        F.col("value").alias("latency_ms"),
        streaming.alias("is_streaming"),
        F.when(streaming, derive.round_ms(F.col("value") / 4)).alias("time_to_first_token_ms"),
        _k().alias("input_tokens"),
        (F.col("event_id") % 97).alias("output_tokens"),
        F.call_function("div", _k(), F.lit(2).cast("bigint")).alias("cached_tokens"),
    )


def request_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(table(spark, sf_dir, "events"))


EVENT_TYPES = ["request", "response", "error", "retry", "fallback", "provider_selection", "configuration"]


def router_events(spark: SparkSession, sf_dir: str, chained: bool = False) -> DataFrame:
    return events_of(table(spark, sf_dir, "events"), chained)


def events_of(events: DataFrame, chained: bool = False) -> DataFrame:
    """Event log: every source row is one attempt with its request and, unless left open, its terminal events.

    ``chained`` puts all attempts of a user and day into one request, spread over the providers.
    """
    if chained:
        request_id = F.concat_ws("-", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string"))
        nth = F.col("event_id") % 4
    else:
        request_id = F.concat(F.lit("r"), F.col("event_id").cast("string"))
        nth = F.col("user_id") % 4
    provider = F.concat(F.lit("p"), nth.cast("string"))
    k = _k()
    counting = (F.col("event_type") == "view") & (k % 10 == 3)
    failed = (
        F.when(F.col("event_type") == "error", "rate_limit_error")
        .when(F.col("event_type") == "signup", "provider_error")
        .when((F.col("event_type") == "purchase") & (k >= 95), "authentication_error")
    )
    rows = events.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("start_ts"),
        "event_type",
        "value",
        k.alias("k"),
        request_id.alias("request_id"),
        provider.alias("provider"),
        (nth + 1).cast("int").alias("provider_priority"),
        F.when(counting, F.concat(_type(), F.lit("/count_tokens"))).otherwise(_type()).alias("endpoint"),
        counting.alias("counting"),
        (F.col("event_type").isin("view", "click") & ~counting).alias("stream"),
        failed.alias("error_type"),
        ((F.col("event_type") == "purchase") & (k < 10)).alias("open"),
        F.when((F.col("user_id") % 5) > 0, F.concat(F.lit("agent-"), (F.col("user_id") % 5).cast("string"))).alias(
            "user_agent"
        ),
        F.concat(F.lit("m"), (k % 7).cast("string")).alias("model"),
    ).withColumns(
        {
            "end_ts": F.timestamp_micros(F.unix_micros("start_ts") + F.col("k") * 1000),
            "seq": F.col("event_id") * 8,
            "error_message": F.concat(F.lit("e"), F.col("k").cast("string")),
        }
    )
    is_failed = F.col("error_type").isNotNull()
    base = {
        "request_id": F.col("request_id"),
        "endpoint": F.col("endpoint"),
        "provider": F.col("provider"),
    }
    usage = F.struct(
        F.col("k").alias("prompt_tokens"),
        (F.col("event_id") % 97).alias("completion_tokens"),
        (F.col("k") + F.col("event_id") % 97).alias("total_tokens"),
        F.call_function("div", F.col("k"), F.lit(2).cast("bigint")).alias("cached_tokens"),
    )
    parts = [
        _typed(
            rows,
            "request",
            0,
            "start_ts",
            base
            | {c: F.col(c) for c in ("provider_priority", "model", "stream", "user_agent")}
            | {"message_count": (F.col("k") % 5).cast("int")},
        ),
        _typed(
            rows.filter(~is_failed & ~F.col("open")),
            "response",
            1,
            "end_ts",
            base
            | {
                "duration_ms": F.col("value"),
                "model": F.when(~F.col("counting"), F.col("model")),
                "usage": F.when(~F.col("counting"), usage),
                "input_tokens": F.when(F.col("counting"), F.col("k")),
                "finish_reason": F.when(~F.col("counting"), F.lit("stop")),
            },
        ),
        _typed(
            rows.filter(is_failed),
            "error",
            1,
            "end_ts",
            base
            | {
                "error_type": F.col("error_type"),
                "error_message": F.col("error_message"),
                "status_code": F.when(F.col("error_type") == "rate_limit_error", 429).when(
                    F.col("error_type") == "authentication_error", 401
                ),
            },
        ),
        _typed(
            rows.filter(is_failed),
            "retry",
            2,
            "end_ts",
            base
            | {
                "provider_priority": F.col("provider_priority"),
                "attempt": (F.col("k") % 3 + 1).cast("int"),
                "max_attempts": F.lit(3),
                "error_type": F.col("error_type"),
                "error_message": F.col("error_message"),
                "retry_after": F.when(F.col("error_type") == "rate_limit_error", F.col("k") / 2),
            },
        ),
        _typed(
            rows.filter(
                F.col("error_type").isin("rate_limit_error", "provider_error") & (F.col("provider_priority") < 4)
            ),
            "fallback",
            3,
            "end_ts",
            {
                "request_id": F.col("request_id"),
                "endpoint": F.col("endpoint"),
                "from_provider": F.col("provider"),
                "from_priority": F.col("provider_priority"),
                "to_provider": F.concat(F.lit("p"), F.col("provider_priority").cast("string")),
                "to_priority": F.col("provider_priority") + 1,
                "reason": F.when(F.col("error_type") == "rate_limit_error", "rate_limit").otherwise("provider_error"),
            },
        ),
        _typed(
            rows.filter((F.col("error_type") == "rate_limit_error") & (F.col("k") >= 90)),
            "error",
            4,
            "end_ts",
            {
                "request_id": F.col("request_id"),
                "endpoint": F.col("endpoint"),
                "provider": F.lit("all"),
                "error_type": F.lit("no_available_provider"),
                "error_message": F.lit("All 4 providers failed"),
            },
        ),
        _typed(
            rows,
            "provider_selection",
            5,
            "start_ts",
            {
                "request_id": F.col("request_id"),
                "endpoint": F.col("endpoint"),
                "selected_provider": F.lit(""),
                "selected_priority": F.lit(0),
                "available_providers": F.transform(
                    F.sequence(F.lit(1), F.col("provider_priority")),
                    lambda i: F.struct(
                        F.concat(F.lit("p"), (i - 1).cast("string")).alias("name"), i.cast("int").alias("priority")
                    ),
                ),
            },
        ),
        _typed(
            rows.filter((F.col("event_type") == "signup") & (F.col("k") == 0)),
            "configuration",
            6,
            "start_ts",
            {
                "config_type": F.lit("router_start"),
                "details": F.parse_json(F.concat(F.lit('{"endpoint":"'), F.col("endpoint"), F.lit('"}'))),
            },
        ),
    ]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log


def _typed(rows: DataFrame, type_: str, offset: int, ts: str, given: dict[str, Column]) -> DataFrame:
    """Rows of one event type with the full schema."""
    given = given | {"timestamp": F.col(ts), "type": F.lit(type_), "session_id": F.lit("demo")}
    columns = [
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ROUTER_EVENTS.fields
    ]
    return rows.select(*columns, (F.col("seq") + offset).alias("seq"))


def event_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The providers that occur in ``events``, with their priority."""
    seen = table(spark, sf_dir, "events").select(
        _type().alias("provider_type"),
        _provider().alias("provider"),
        (F.col("user_id") % 4 + 1).cast("int").alias("priority"),
    )
    return seen.distinct().withColumn("position", F.col("priority"))


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider configuration from ``supplier``."""
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_nationkey") % 2 == 0, "openai").otherwise("anthropic").alias("provider_type"),
        F.when(n % 7 == 0, "key").otherwise(F.col("s_name")).alias("api_key"),
        # every tenth provider repeats the priority of the one before
        (n + 1 - F.when(n % 10 == 9, 1).otherwise(0)).cast("int").alias("priority"),
        F.when(F.col("s_nationkey") >= 12, F.concat(F.lit("https://h"), F.col("s_nationkey").cast("string"))).alias(
            "base_url"
        ),
        (n % 40).cast("int").alias("timeout"),
        (n % 4).cast("int").alias("max_retries"),
        F.create_map(F.lit("m1"), F.concat(F.col("s_name"), F.lit("-m1")), F.lit("m2"), F.lit("large")).alias(
            "model_mapping"
        ),
        F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, "").otherwise(F.col("s_name")).alias("provider_name"),
        n.cast("int").alias("position"),
    )


def _cut(events: DataFrame, at: Column) -> DataFrame:
    """Two chunks per row of (request_id, provider_type, n, text): the bytes before and after position ``at``.

    The cut may fall inside a character.
    """
    data = F.encode("text", "UTF-8")
    size = F.octet_length(data)
    halves = F.array(
        F.struct((F.col("n") * 2).alias("seq"), F.substring(data, F.lit(1), at(size)).alias("data")),
        F.struct((F.col("n") * 2 + 1).alias("seq"), F.substring(data, at(size) + 1, size).alias("data")),
    )
    return events.select("request_id", "provider_type", "base_ts", F.inline(halves)).select(
        "request_id",
        "provider_type",
        "seq",
        F.timestamp_micros(F.unix_micros("base_ts") + F.col("seq") * 10_000).alias("ts"),
        "data",
    )


def _base_ts(n: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + n * 1_000_000)


def conversation_chunks(spark: SparkSession, sf_dir: str, provider_type: str) -> DataFrame:
    """Every conversation as one streamed response, every turn as stream events, cut into two chunks per turn.

    Every fifth chunk was recorded twice.
    """
    turns = table(spark, sf_dir, "conversations")
    text = _openai_lines() if provider_type == "openai" else _anthropic_lines()
    rows = turns.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("request_id"),
        F.lit(provider_type).alias("provider_type"),
        F.col("turn").alias("n"),
        _base_ts(F.col("conv_id")).alias("base_ts"),
        text.alias("text"),
    )
    once = _cut(rows, lambda size: F.call_function("div", size, F.lit(2)).cast("int"))
    copies = F.when(F.col("seq") % 5 == 0, 2).otherwise(1)
    return once.select("*", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).drop("copy")


def _line(doc: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(doc), F.lit("\n\n"))


def _openai_lines() -> Column:
    turn, text = F.col("turn"), F.col("text")
    call = F.struct(
        (turn % 3).alias("index"),
        F.concat(F.lit("call-"), turn.cast("string")).alias("id"),
        F.lit("function").alias("type"),
        F.struct(F.col("role").alias("name"), F.concat(turn.cast("string"), F.lit(";")).alias("arguments")).alias(
            "function"
        ),
    )
    doc = F.struct(
        F.concat(F.lit("id-"), F.col("conv_id").cast("string")).alias("id"),
        F.lit(1700000000).alias("created"),
        F.concat(F.lit("model-"), turn.cast("string")).alias("model"),
        F.array(
            F.struct(
                (turn % 2).alias("index"),
                F.struct(F.col("role").alias("role"), text.alias("content"), F.array(call).alias("tool_calls")).alias(
                    "delta"
                ),
                F.concat(F.lit("f"), turn.cast("string")).alias("finish_reason"),
            )
        ).alias("choices"),
        F.struct((turn + 10).alias("prompt_tokens"), F.length(text).alias("completion_tokens")).alias("usage"),
    )
    return F.concat(F.lit(": comment\ndata:\n"), _line(doc), F.lit('data: [DONE]\ndata: {broken\ndata: {"choices":[]}}\n'))


def _anthropic_lines() -> Column:
    turn, text = F.col("turn"), F.col("text")

    def event(kind: str, **fields: Column) -> Column:
        return _line(F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in fields.items()]))

    def delta(index: Column, **fields: Column) -> Column:
        body = F.struct(F.lit("d").alias("type"), *[c.alias(n) for n, c in fields.items()])
        return event("content_block_delta", index=index, delta=body)

    head = event(
        "message_start",
        message=F.struct(
            F.concat(F.lit("msg-"), F.col("conv_id").cast("string")).alias("id"),
            F.lit("model-a").alias("model"),
            F.struct(
                F.lit(20).alias("input_tokens"),
                F.lit(3).alias("cache_creation_input_tokens"),
                F.lit(5).alias("cache_read_input_tokens"),
                F.lit(1).alias("output_tokens"),
                F.lit("standard").alias("service_tier"),
            ).alias("usage"),
        ),
    )
    tool = F.concat(
        event(
            "content_block_start",
            index=turn,
            content_block=F.struct(
                F.lit("tool_use").alias("type"),
                F.concat(F.lit("t"), turn.cast("string")).alias("id"),
                F.lit("find").alias("name"),
                F.concat(F.lit("use-"), turn.cast("string")).alias("tool_use_id"),
            ),
        ),
        delta(turn, partial_json=F.lit('{"n":')),
        delta(turn, partial_json=F.concat(turn.cast("string"), F.when(turn % 4 == 3, "").otherwise("}"))),
    )
    plain = F.concat(
        event("content_block_start", index=turn, content_block=F.struct(F.lit("text").alias("type"), F.lit("old").alias("text"), F.array("role").alias("citations"))),
        delta(turn, text=F.lit("older")),
        event("content_block_start", index=turn, content_block=F.struct(F.lit("text").alias("type"), F.lit("").alias("text"))),
        delta(turn, text=F.concat(text, F.lit("|"))),
        delta(turn, text=text),
    )
    tail = event(
        "message_delta",
        delta=F.struct(F.concat(F.lit("s"), turn.cast("string")).alias("stop_reason")),
        usage=F.struct(
            F.length(text).alias("output_tokens"), F.struct(turn.alias("web_search_requests")).alias("server_tool_use")
        ),
    )
    return F.concat(
        F.when(turn == 0, head).otherwise(""),
        F.when(F.col("role") == "assistant", tool).otherwise(plain),
        delta(turn + 100, text=F.lit("dropped")),
        tail,
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one streamed response: one event per text line, cut after a third of its bytes."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    content = F.concat(F.when(F.col("n") > 0, "\n").otherwise(""), F.col("line"))
    doc = F.struct(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.lit("m").alias("model"),
        F.array(F.struct(F.lit(0).alias("index"), F.struct(content.alias("content")).alias("delta"))).alias("choices"),
    )
    rows = lines.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"),
        F.lit("openai").alias("provider_type"),
        F.col("n").cast("bigint").alias("n"),
        _base_ts(F.col("doc_id")).alias("base_ts"),
        _line(doc).alias("text"),
    )
    return _cut(rows, lambda size: F.call_function("div", size, F.lit(3)).cast("int"))


def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each streamed conversation, one row per request."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("request_id"),
        F.concat(F.lit("p"), (F.col("conv_id") % 4).cast("string")).alias("provider_name"),
        F.timestamp_micros(F.unix_micros(_base_ts(F.col("conv_id"))) - 50_000).alias("start_ts"),
    )
