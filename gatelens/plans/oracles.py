"""DuckDB SQL with the same meaning as the queries, written from the operators' definitions.

The common table expressions restate the derived tables of ``demo``.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-30 12:34:56'"
WINDOW_US = 10_800 * 1_000_000
COOLDOWN_US = 36_000 * 1_000_000

TYPE = "CASE user_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'unknown' END"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

STATS = f"""s AS (
  SELECT ts AS "timestamp", {TYPE} AS provider_type, 'p' || (user_id % 4) AS provider_name, value AS latency_ms,
         event_type IN ('view', 'click') AS is_streaming,
         CASE WHEN event_type IN ('view', 'click') THEN printf('%.2f', value / 4)::DOUBLE END AS time_to_first_token_ms,
         {K} AS input_tokens, event_id % 97 AS output_tokens, {K} // 2 AS cached_tokens
  FROM events)"""

ATTEMPTS = f"""e0 AS (SELECT *, {K} AS k, {TYPE} AS ptype FROM events),
a AS (
  SELECT event_id, user_id, ts, value, k, ptype, event_type, 'p' || (user_id % 4) AS prov, user_id % 4 + 1 AS prio,
         'r' || event_id AS rid, user_id || '-' || day(ts) AS cid, 'p' || (event_id % 4) AS cprov,
         event_type = 'view' AND k % 10 = 3 AS counting,
         event_type IN ('view', 'click') AND NOT (event_type = 'view' AND k % 10 = 3) AS stream,
         CASE WHEN event_type = 'error' THEN 'rate_limit_error' WHEN event_type = 'signup' THEN 'provider_error'
              WHEN event_type = 'purchase' AND k >= 95 THEN 'authentication_error' END AS etype,
         CASE WHEN event_type = 'error' THEN 429 WHEN event_type = 'purchase' AND k >= 95 THEN 401 END::BIGINT AS status,
         event_type = 'purchase' AND k < 10 AS is_open,
         ts + to_microseconds(k * 1000) AS end_ts, event_id * 8 AS seq,
         CASE WHEN user_id % 5 > 0 THEN 'agent-' || (user_id % 5) END AS agent, 'm' || (k % 7) AS model,
         event_id % 97 AS out_tokens
  FROM e0),
d AS (SELECT * FROM a WHERE NOT is_open)"""

# The rule itself, one event after the other: the list of rate limits still counted, cleared by success and trigger.
TRIGGERS = f"""{ATTEMPTS},
marks AS (
  SELECT ptype AS provider_type, prov AS provider, epoch_us(end_ts) AS us, seq + 1 AS seq,
         etype IS NOT NULL AND etype = 'rate_limit_error' AS limited
  FROM d WHERE etype = 'rate_limit_error' OR (etype IS NULL AND NOT stream AND NOT counting)),
m AS (SELECT *, row_number() OVER (PARTITION BY provider_type, provider ORDER BY us, seq) AS n FROM marks),
f AS (
  SELECT provider_type, provider, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS buf, false AS trig,
         CAST(0 AS BIGINT) AS us, CAST(0 AS BIGINT) AS seq
  FROM (SELECT DISTINCT provider_type, provider FROM m)
  UNION ALL
  SELECT provider_type, provider, n,
         CASE WHEN NOT limited OR len(nb) >= 3 THEN CAST([] AS BIGINT[]) ELSE nb END,
         limited AND len(nb) >= 3, us, seq
  FROM (SELECT m.*, list_append(list_filter(f.buf, lambda x: m.us - x <= {WINDOW_US}), m.us) AS nb
        FROM f JOIN m ON m.provider_type = f.provider_type AND m.provider = f.provider AND m.n = f.n + 1)),
t AS (SELECT provider_type, provider, us, seq FROM f WHERE trig)"""

EPISODES = f"""{TRIGGERS},
known AS (
  SELECT *, lead(us) OVER (PARTITION BY provider_type, provider ORDER BY us, seq) AS next_us
  FROM t WHERE us <= epoch_us({AS_OF})),
ep AS (
  SELECT provider_type, provider, seq, us, us + {COOLDOWN_US} AS deadline,
         coalesce(next_us < us + {COOLDOWN_US}, false) AS replaced, next_us
  FROM known),
credited AS (
  SELECT *, CASE WHEN NOT replaced AND deadline <= epoch_us({AS_OF}) THEN 36000.0::DOUBLE ELSE 0.0::DOUBLE END AS credit
  FROM ep)"""

RECENT = f"""resets AS (
  SELECT provider_type, provider, us, seq FROM marks WHERE NOT limited
  UNION ALL SELECT provider_type, provider, us, seq FROM t),
recent AS (
  SELECT provider_type, provider, count(*) AS recent_rate_limits FROM marks x
  WHERE limited AND us <= epoch_us({AS_OF}) AND us >= epoch_us({AS_OF}) - {WINDOW_US}
    AND NOT EXISTS (SELECT 1 FROM resets r WHERE r.provider_type = x.provider_type AND r.provider = x.provider
                    AND r.us <= epoch_us({AS_OF}) AND (r.us > x.us OR (r.us = x.us AND r.seq >= x.seq)))
  GROUP BY ALL)"""

STATUS = f"""{EPISODES}, {RECENT},
per AS (SELECT provider_type, provider, count(*) AS n, sum(credit) AS total, max(us) AS last_us, max(deadline) AS last_deadline
        FROM credited GROUP BY ALL),
status AS (
  SELECT q.provider_type, q.provider, coalesce(last_deadline > epoch_us({AS_OF}), false) AS in_cooldown,
         CASE WHEN last_deadline > epoch_us({AS_OF}) THEN (last_deadline - epoch_us({AS_OF}))::DOUBLE / 1000000
              ELSE 0.0::DOUBLE END AS cooldown_remaining_seconds,
         CASE WHEN last_deadline > epoch_us({AS_OF}) THEN make_timestamp(last_deadline) END AS cooldown_end_ts,
         CASE WHEN last_deadline > epoch_us({AS_OF}) THEN make_timestamp(last_us) END AS last_cooldown_start_ts,
         coalesce(recent_rate_limits, 0) AS recent_rate_limits,
         coalesce(n, 0) AS cooldown_count, coalesce(total, 0.0) AS total_cooldown_time_seconds
  FROM (SELECT DISTINCT ptype AS provider_type, prov AS provider FROM a) q
  LEFT JOIN per ON per.provider_type = q.provider_type AND per.provider = q.provider
  LEFT JOIN recent ON recent.provider_type = q.provider_type AND recent.provider = q.provider)"""

# Providers that a chained request passed over: cooling at its time, before the one that served it, and not tried.
SKIPS = f"""{TRIGGERS},
asked AS (SELECT cid, ptype, min(ts) AS ts FROM a GROUP BY ALL),
served AS (SELECT cid, min(event_id % 4 + 1) AS prio FROM d WHERE etype IS NULL GROUP BY ALL),
tried AS (SELECT DISTINCT cid, cprov FROM a),
dims AS (SELECT DISTINCT ptype, prov, prio FROM a),
skips AS (
  SELECT q.cid, q.ptype, q.ts, dims.prov, dims.prio, max(t.us) + {COOLDOWN_US} - epoch_us(q.ts) AS left_us
  FROM asked q JOIN dims USING (ptype)
  JOIN t ON t.provider_type = q.ptype AND t.provider = dims.prov AND t.us <= epoch_us(q.ts)
        AND epoch_us(q.ts) < t.us + {COOLDOWN_US}
  LEFT JOIN served USING (cid)
  WHERE (served.prio IS NULL OR dims.prio < served.prio)
    AND NOT EXISTS (SELECT 1 FROM tried WHERE tried.cid = q.cid AND tried.cprov = dims.prov)
  GROUP BY q.cid, q.ptype, q.ts, dims.prov, dims.prio)"""

DEC = "DECIMAL(18,2)"


def ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN {top}::DOUBLE / ({bottom})::DOUBLE ELSE 0.0 END"


PROVIDER_STATS = f"""counters AS (
  SELECT ptype AS provider_type, prov AS provider, count(*) AS total_requests,
         count(*) FILTER (etype IS NULL AND NOT is_open) AS successful_requests,
         count(*) FILTER (etype IS NOT NULL) AS failed_requests,
         count(*) FILTER (status = 429) AS total_rate_limits,
         coalesce(sum(k) FILTER (etype IS NULL AND NOT is_open), 0)::BIGINT AS total_input_tokens,
         coalesce(sum(out_tokens) FILTER (etype IS NULL AND NOT is_open AND NOT counting), 0)::BIGINT AS total_output_tokens,
         coalesce(sum(k // 2) FILTER (etype IS NULL AND NOT is_open AND NOT counting), 0)::BIGINT AS total_cached_tokens,
         coalesce(sum(value::{DEC}) FILTER (etype IS NULL AND NOT is_open), 0)::DOUBLE AS total_latency_ms,
         min(ts) AS first_request_time, max(ts) AS last_request_time,
         max(end_ts) FILTER (etype IS NULL AND NOT is_open) AS last_success_time,
         count(*) FILTER (etype IS NULL AND NOT is_open AND NOT stream) AS non_streaming_requests,
         coalesce(sum(value::{DEC}) FILTER (etype IS NULL AND NOT is_open AND NOT stream), 0)::DOUBLE
           AS non_streaming_total_latency_ms,
         coalesce(sum(out_tokens) FILTER (etype IS NULL AND NOT is_open AND NOT stream AND NOT counting), 0)::BIGINT
           AS non_streaming_output_tokens
  FROM a GROUP BY ALL),
streaming AS (
  SELECT provider_type, provider_name AS provider, count(*) AS streaming_requests,
         sum(latency_ms::{DEC})::DOUBLE AS streaming_total_latency_ms,
         sum(output_tokens)::BIGINT AS streaming_output_tokens,
         coalesce(sum(time_to_first_token_ms::DECIMAL(18,6)) FILTER (time_to_first_token_ms > 0), 0)::DOUBLE AS streaming_ttft_ms,
         count(*) FILTER (time_to_first_token_ms > 0) AS streaming_ttft_count,
         coalesce(sum(latency_ms::{DEC} - time_to_first_token_ms::DECIMAL(18,6))
                  FILTER (time_to_first_token_ms > 0 AND latency_ms > time_to_first_token_ms), 0)::DOUBLE
           AS streaming_generation_time_ms
  FROM s WHERE is_streaming GROUP BY ALL),
newest AS (
  SELECT ptype AS provider_type, prov AS provider, etype, k,
         row_number() OVER (PARTITION BY ptype, prov ORDER BY end_ts DESC, seq DESC) AS back
  FROM d),
ps AS (
  SELECT counters.*, streaming_requests, streaming_total_latency_ms, streaming_output_tokens, streaming_ttft_ms,
         streaming_ttft_count, streaming_generation_time_ms,
         total_requests - successful_requests - failed_requests AS in_progress_requests,
         total_input_tokens + total_output_tokens AS total_tokens,
         {ratio('successful_requests', 'successful_requests + failed_requests')} * 100 AS success_rate,
         {ratio('failed_requests', 'successful_requests + failed_requests')} * 100 AS failure_rate,
         {ratio('non_streaming_total_latency_ms', 'non_streaming_requests')} AS non_streaming_average_latency_ms,
         {ratio('non_streaming_output_tokens', 'non_streaming_total_latency_ms / 1000')} AS non_streaming_tokens_per_second,
         {ratio('streaming_total_latency_ms', 'streaming_requests')} AS streaming_average_latency_ms,
         {ratio('streaming_ttft_ms', 'streaming_ttft_count')} AS streaming_average_ttft_ms,
         {ratio('streaming_output_tokens', 'streaming_total_latency_ms / 1000')} AS streaming_tokens_per_second_with_ttft,
         {ratio('streaming_output_tokens', 'streaming_generation_time_ms / 1000')}
           AS streaming_tokens_per_second_without_ttft,
         {ratio('total_latency_ms', 'successful_requests')} AS average_latency_ms,
         {ratio('total_output_tokens', 'total_latency_ms / 1000')} AS tokens_per_second,
         CASE etype WHEN 'rate_limit_error' THEN 'Rate limit error: ' WHEN 'provider_error' THEN 'Provider error: '
                    WHEN 'authentication_error' THEN 'Authentication error: ' END || 'e' || k AS last_error
  FROM counters
  LEFT JOIN streaming USING (provider_type, provider)
  LEFT JOIN newest ON newest.provider_type = counters.provider_type AND newest.provider = counters.provider AND back = 1)"""

TOTALS = """totals AS (
  SELECT provider_type, sum(total_requests)::BIGINT AS total_requests, sum(total_input_tokens)::BIGINT AS total_input_tokens,
         sum(total_output_tokens)::BIGINT AS total_output_tokens, sum(total_cached_tokens)::BIGINT AS total_cached_tokens,
         sum(total_tokens)::BIGINT AS total_tokens,
         first(provider ORDER BY total_requests DESC, first_request_time) AS most_used_provider,
         first(provider ORDER BY average_latency_ms, first_request_time) FILTER (average_latency_ms > 0) AS fastest_provider
  FROM ps GROUP BY ALL)"""

UPTIME = f"""up AS (
  SELECT ptype AS provider_type, (epoch_us({AS_OF}) - epoch_us(max(ts)))::DOUBLE / 1000000 AS uptime_seconds
  FROM a WHERE event_type = 'signup' AND k = 0 AND ts <= {AS_OF} GROUP BY ALL)"""

PROVIDERS = """p AS (
  SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider_type,
         CASE WHEN s_suppkey % 7 = 0 THEN 'key' ELSE s_name END AS api_key,
         s_suppkey + 1 - CASE WHEN s_suppkey % 10 = 9 THEN 1 ELSE 0 END AS priority,
         CASE WHEN s_nationkey >= 12 THEN 'https://h' || s_nationkey END AS base_url,
         s_suppkey % 40 AS timeout, s_suppkey % 4 AS max_retries, s_name || '-m1' AS m1,
         CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN '' ELSE s_name END AS provider_name,
         s_suppkey AS position
  FROM supplier),
named AS (
  SELECT *, coalesce(nullif(provider_name, ''), provider_type || '-priority-' || priority) AS provider FROM p)"""


def spine(step: str, hours: int) -> str:
    return (
        f"spine AS (SELECT unnest(range(date_trunc('{step}', {AS_OF} - INTERVAL {hours} HOUR), "
        f"date_trunc('{step}', {AS_OF}) + INTERVAL 1 {step}, INTERVAL 1 {step})) AS \"timestamp\")"
    )


def requests(step: str, hours: int, where: str = "true") -> str:
    return f"""WITH {STATS}, {spine(step, hours)},
g AS (SELECT date_trunc('{step}', "timestamp") AS "timestamp", count(*) AS n FROM s
      WHERE "timestamp" >= {AS_OF} - INTERVAL {hours} HOUR AND {where} GROUP BY 1)
SELECT spine."timestamp"::TIMESTAMP AS "timestamp", coalesce(n, 0) AS count FROM spine LEFT JOIN g USING ("timestamp")
ORDER BY 1"""


def tokens(step: str, hours: int, where: str = "true") -> str:
    return f"""WITH {STATS}, {spine(step, hours)},
g AS (SELECT date_trunc('{step}', "timestamp") AS "timestamp", sum(input_tokens) AS i, sum(output_tokens) AS o,
             sum(cached_tokens) AS c, sum(input_tokens + output_tokens) AS t
      FROM s WHERE "timestamp" >= {AS_OF} - INTERVAL {hours} HOUR AND {where} GROUP BY 1)
SELECT spine."timestamp"::TIMESTAMP AS "timestamp", coalesce(i, 0)::BIGINT AS input_tokens,
       coalesce(o, 0)::BIGINT AS output_tokens, coalesce(c, 0)::BIGINT AS cached_tokens, coalesce(t, 0)::BIGINT AS total_tokens
FROM spine LEFT JOIN g USING ("timestamp") ORDER BY 1"""


def summary(bound: str) -> str:
    return f"""WITH {STATS}
SELECT provider_type, provider_name, count(*) AS request_count, sum(input_tokens + output_tokens)::BIGINT AS total_tokens,
       sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
       sum(cached_tokens)::BIGINT AS cached_tokens,
       sum(latency_ms::{DEC})::DOUBLE / count(latency_ms) AS avg_latency_ms,
       count(*) FILTER (is_streaming) AS streaming_count, count(*) FILTER (NOT is_streaming) AS non_streaming_count,
       min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp
FROM s WHERE "timestamp" >= {bound} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2"""


def counted(where: str = "true") -> str:
    return f"""WITH {STATS}
SELECT provider_type, provider_name, is_streaming, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens,
       count(time_to_first_token_ms) AS with_ttft, sum(latency_ms::{DEC})::DOUBLE AS latency_ms,
       min("timestamp") AS first_ts, max("timestamp") AS last_ts
FROM s WHERE {where} GROUP BY 1, 2, 3"""


LOG = f"""{ATTEMPTS},
log AS (
  SELECT 'request' AS type, rid, ts AS at_ts FROM a
  UNION ALL SELECT 'response', rid, end_ts FROM d WHERE etype IS NULL
  UNION ALL SELECT 'error', rid, end_ts FROM a WHERE etype IS NOT NULL
  UNION ALL SELECT 'retry', rid, end_ts FROM a WHERE etype IS NOT NULL
  UNION ALL SELECT 'fallback', rid, end_ts FROM a WHERE etype IN ('rate_limit_error', 'provider_error') AND prio < 4
  UNION ALL SELECT 'error', rid, end_ts FROM a WHERE etype = 'rate_limit_error' AND k >= 90
  UNION ALL SELECT 'provider_selection', rid, ts FROM a
  UNION ALL SELECT 'configuration', rid, ts FROM a WHERE event_type = 'signup' AND k = 0)"""

ERRORS = f"""{ATTEMPTS},
er AS (SELECT prov AS provider, etype AS error_type, status AS status_code FROM a WHERE etype IS NOT NULL
       UNION ALL SELECT 'all', 'no_available_provider', NULL FROM a WHERE etype = 'rate_limit_error' AND k >= 90)"""

TURNS = """c AS (
  SELECT 'c' || conv_id AS request_id, conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last_turn
  FROM conversations)"""

# Tool calls of one choice stand at turn % 3, choices at turn % 2; gaps are padded.
OPENAI = f"""{TURNS},
calls AS (
  SELECT request_id, turn % 2 AS choice, turn % 3 AS tool, arg_max('call-' || turn, turn) AS id, arg_max(role, turn) AS name,
         string_agg(turn || ';', '' ORDER BY turn) AS args
  FROM c GROUP BY ALL),
slots AS (
  SELECT request_id, choice, unnest(range(max(tool) + 1)) AS tool FROM calls GROUP BY 1, 2),
tools AS (
  SELECT slots.request_id, slots.choice,
         string_agg(coalesce(id, '-') || ':' || coalesce(name, '-') || ':' || coalesce(args, '-'), ',' ORDER BY slots.tool)
           AS tool_calls
  FROM slots LEFT JOIN calls USING (request_id, choice, tool) GROUP BY 1, 2),
heads AS (
  SELECT request_id, 'id-' || any_value(conv_id) AS id, arg_min('model-' || turn, turn) AS model,
         max(turn) + 10 AS prompt_tokens, arg_max(length(text), turn) AS completion_tokens
  FROM c GROUP BY 1)"""

PIECES = """pieces AS (SELECT request_id, provider_type, conv_id, out, prompt, cached, n_turns FROM (
  SELECT 'c' || conv_id AS request_id, 'openai' AS provider_type, conv_id, arg_max(length(text), turn) AS out,
         max(turn) + 10 AS prompt, 0::BIGINT AS cached, max(turn) AS n_turns FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT 'ac' || conv_id, 'anthropic', conv_id, arg_max(length(text), turn), 28, 5, max(turn)
  FROM conversations GROUP BY conv_id))"""


def metric(name: str, kind: str, value: str, source: str = "ps", positive: bool = False) -> str:
    provider = "provider" if source == "ps" else "CAST(NULL AS VARCHAR)"
    where = f"WHERE {value} > 0" if positive else f"WHERE {value} IS NOT NULL"
    frm = "ps JOIN status USING (provider_type, provider)" if source == "ps" else "totals LEFT JOIN up USING (provider_type)"
    return (
        f"SELECT 'gateway_{name}' AS name, '{kind}' AS type, provider_type, {provider} AS provider, "
        f"({value})::DOUBLE AS value FROM {frm} {where}"
    )


_METRICS = [
    metric("uptime_seconds", "gauge", "uptime_seconds", "t"),
    metric("requests_total", "counter", "total_requests", "t"),
    metric("input_tokens_total", "counter", "total_input_tokens", "t"),
    metric("output_tokens_total", "counter", "total_output_tokens", "t"),
    metric("cached_tokens_total", "counter", "total_cached_tokens", "t"),
    metric("total_tokens", "counter", "total_tokens", "t"),
    metric("provider_requests_total", "counter", "total_requests"),
    metric("provider_requests_in_progress", "gauge", "in_progress_requests"),
    metric("provider_requests_successful_total", "counter", "successful_requests"),
    metric("provider_requests_failed_total", "counter", "failed_requests"),
    metric("provider_input_tokens_total", "counter", "total_input_tokens"),
    metric("provider_output_tokens_total", "counter", "total_output_tokens"),
    metric("provider_cached_tokens_total", "counter", "total_cached_tokens"),
    metric("provider_streaming_requests_total", "counter", "streaming_requests"),
    metric("provider_non_streaming_requests_total", "counter", "non_streaming_requests"),
    metric("provider_latency_seconds", "gauge", "average_latency_ms / 1000", positive=True),
    metric("provider_streaming_latency_seconds", "gauge", "streaming_average_latency_ms / 1000", positive=True),
    metric("provider_non_streaming_latency_seconds", "gauge", "non_streaming_average_latency_ms / 1000", positive=True),
    metric("provider_time_to_first_token_seconds", "gauge", "streaming_average_ttft_ms / 1000", positive=True),
    metric("provider_tokens_per_second", "gauge", "tokens_per_second", positive=True),
    metric("provider_streaming_tokens_per_second", "gauge", "streaming_tokens_per_second_with_ttft", positive=True),
    metric("provider_success_rate", "gauge", "success_rate / 100"),
    metric("provider_rate_limits_total", "counter", "total_rate_limits"),
    metric("provider_recent_rate_limits", "gauge", "recent_rate_limits"),
    metric("provider_cooldowns_total", "counter", "cooldown_count"),
    metric("provider_cooldown_time_seconds_total", "counter", "total_cooldown_time_seconds"),
    metric("provider_in_cooldown", "gauge", "in_cooldown::INT"),
    metric("provider_cooldown_remaining_seconds", "gauge", "cooldown_remaining_seconds", positive=True),
]

# Counter lines of the text export: name, help, column, of providers (ps) or of a provider type (totals).
_COUNTERS = [
    ("requests_total", "Finished requests of this type", "total_requests", "totals"),
    ("input_tokens_total", "Prompt tokens sent to this type", "total_input_tokens", "totals"),
    ("output_tokens_total", "Completion tokens received from this type", "total_output_tokens", "totals"),
    ("cached_tokens_total", "Prompt tokens this type read from a cache", "total_cached_tokens", "totals"),
    ("total_tokens", "Prompt and completion tokens of this type together", "total_tokens", "totals"),
    ("provider_requests_total", "Finished requests of this provider", "total_requests", "ps"),
    ("provider_requests_successful_total", "Requests this provider answered", "successful_requests", "ps"),
    ("provider_requests_failed_total", "Requests this provider ended with an error", "failed_requests", "ps"),
    ("provider_input_tokens_total", "Prompt tokens sent to this provider", "total_input_tokens", "ps"),
    ("provider_output_tokens_total", "Completion tokens received from this provider", "total_output_tokens", "ps"),
    ("provider_cached_tokens_total", "Prompt tokens this provider read from a cache", "total_cached_tokens", "ps"),
    ("provider_streaming_requests_total", "Requests answered as a stream", "streaming_requests", "ps"),
    ("provider_non_streaming_requests_total", "Requests answered in one piece", "non_streaming_requests", "ps"),
    ("provider_rate_limits_total", "Errors of this provider that were rate limits", "total_rate_limits", "ps"),
]


def _exposition() -> str:
    parts = [
        "SELECT unnest(['# HELP gateway_info Version of the software that wrote these lines', '# TYPE gateway_info gauge', "
        "'gateway_info{version=\"1.0\"} 1']) AS line"
    ]
    for name, text, column, source in _COUNTERS:
        label = "'{provider_type=\"' || provider_type || '\"'" + (
            " || ',provider=\"' || provider || '\"'" if source == "ps" else ""
        ) + " || '}'"
        parts.append(f"SELECT unnest(['# HELP gateway_{name} {text}', '# TYPE gateway_{name} counter']) AS line")
        parts.append(f"SELECT 'gateway_{name}' || {label} || ' ' || {column} FROM {source}")
    return " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    "requests_minute": requests("minute", 720),
    "requests_hour": requests("hour", 720),
    "requests_hour_default": requests("hour", 24),
    "requests_hour_openai": requests("hour", 720, "provider_type = 'openai'"),
    "requests_day": requests("day", 720),
    "tokens_hour": tokens("hour", 720),
    "tokens_day_anthropic": tokens("day", 720, "provider_type = 'anthropic'"),
    "provider_summary_hours": summary(f"{AS_OF} - INTERVAL 720 HOUR"),
    "provider_summary_from": summary("TIMESTAMP '2024-01-10 06:00:00'"),
    "requests_from_rollup": requests("hour", 720),
    "tokens_from_rollup": tokens("day", 719),
    "summary_from_rollup": summary(f"{AS_OF} - INTERVAL 720 HOUR"),
    "stored_rollup_requests": requests("day", 720),
    "stored_rollup_tokens": tokens("hour", 720),
    "stored_rollup_summary": summary("TIMESTAMP '2024-01-10 06:00:00'"),
    "missing_source": counted(),
    "error_copies": f"""WITH {LOG}
SELECT type, CASE WHEN type <> 'configuration' THEN rid END AS request_id, count(*) AS n FROM log GROUP BY ALL""",
    "log_files": """SELECT date_trunc('hour', ts) AS log_started_at, 'u' || user_id AS log_session, count(*) AS n
FROM events GROUP BY ALL""",
    "read_configuration": f"""WITH {PROVIDERS}
SELECT provider_type, api_key, CASE WHEN position % 3 > 0 THEN priority ELSE 1 END AS priority, base_url,
       CASE WHEN position % 4 > 0 THEN timeout ELSE 30 END AS timeout,
       CASE WHEN position % 5 > 0 THEN max_retries ELSE 3 END AS max_retries, provider_name,
       CASE WHEN position % 6 > 0 THEN m1 END AS m1 FROM p""",
    "recorded_chunks": """SELECT 'c' || conv_id AS request_id, 'openai' AS provider_type,
       sum(2 + (2 * turn % 5 = 0)::INT + ((2 * turn + 1) % 5 = 0)::INT)::BIGINT AS chunks, 2 * count(*) AS numbers,
       TIMESTAMP '2024-01-01' + to_microseconds(conv_id * 1000000 + (2 * max(turn) + 1) * 10000) AS last_ts
FROM conversations GROUP BY conv_id""",
    "report_json": f"""SELECT '{{"day":"' || strftime("timestamp", '%Y-%m-%d') || '","count":' || count || '}}' AS json
FROM ({requests("day", 720)})""",
    "csv_round_trip": counted(),
    "parquet_round_trip": counted("\"timestamp\" >= TIMESTAMP '2024-01-10 06:00:00'"),
    "event_log_round_trip": f"""WITH {LOG}
SELECT type, count(*) AS n,
       (SELECT sum(k) FROM d WHERE etype IS NULL AND NOT counting AND type = 'response')::BIGINT AS prompt_tokens,
       max(at_ts) AS last_ts,
       CASE WHEN type = 'provider_selection' THEN (SELECT sum(prio) FROM a) END::BIGINT AS offered,
       CASE WHEN type = 'configuration' THEN count(*) ELSE 0 END AS with_details
FROM log GROUP BY type""",
    "archive_round_trip": f"""WITH {LOG}
SELECT at_ts::DATE AS date, count(*) AS n_all, nullif(count(*) FILTER (at_ts::DATE < DATE '2024-01-23'), 0) AS n, max(at_ts) FILTER (at_ts::DATE < DATE '2024-01-23') AS last_ts FROM log GROUP BY 1""",
    "archive_bytes": f"""WITH {LOG}
SELECT at_ts::DATE AS date, count(*) AS rows, true AS has_bytes, true AS smaller FROM log GROUP BY 1""",
    "warning_events": f"""WITH {LOG}
SELECT type, rid AS request_id, at_ts AS "timestamp" FROM log WHERE type IN ('retry', 'fallback', 'error')""",
    "usage_from_json": f"""WITH e AS (SELECT event_id, event_type, {K} AS k, event_id % 97 AS n FROM events)
SELECT event_id, 'openai' AS format, false AS is_count_tokens, event_type AS finish_reason, k AS prompt_tokens,
       n AS completion_tokens, k + n AS total_tokens, CASE WHEN k % 2 = 0 THEN k // 2 ELSE 0 END AS cached_tokens FROM e
UNION ALL
SELECT event_id, 'anthropic', false, event_type,
       k + CASE WHEN k % 2 = 0 THEN k ELSE 0 END + CASE WHEN k % 3 = 0 THEN 2 * k ELSE 0 END, n,
       k + CASE WHEN k % 2 = 0 THEN k ELSE 0 END + CASE WHEN k % 3 = 0 THEN 2 * k ELSE 0 END + n,
       CASE WHEN k % 3 = 0 THEN 2 * k ELSE 0 END FROM e
UNION ALL SELECT event_id, 'openai', true, NULL, 0, 0, 0, 0 FROM e""",
    "request_profiles": """SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN 'm' || turn ELSE '' END AS model,
       CASE WHEN turn % 4 > 0 THEN turn ELSE 0 END AS message_count,
       CASE WHEN turn % 2 = 0 THEN turn::DOUBLE / 4 END AS temperature,
       CASE WHEN turn % 2 = 1 THEN turn * 100 END AS max_tokens, turn % 5 = 0 AS stream FROM conversations""",
    "request_profiles_sent": """SELECT conv_id, turn, CASE WHEN turn % 4 > 0 THEN turn ELSE 0 END AS message_count,
       CASE WHEN turn % 2 = 0 THEN role || '/1.0' END AS user_agent FROM conversations""",
    "rounded_latency": "SELECT event_id, printf('%.2f', value / 4)::DOUBLE AS ttft_ms FROM events",
    "classified_errors": f"""WITH x AS (
  SELECT event_id, event_type,
         CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 401 ELSE 350 + {K} END AS status FROM events),
y AS (SELECT *, CASE WHEN status = 401 THEN 'authentication_error' WHEN status = 429 THEN 'rate_limit_error'
                     WHEN status >= 400 THEN 'provider_error' ELSE 'llm_error' END AS c FROM x)
SELECT event_id, status, c AS error_class,
       CASE c WHEN 'authentication_error' THEN 'Authentication error: ' WHEN 'rate_limit_error' THEN 'Rate limit error: '
              WHEN 'provider_error' THEN 'Provider error: ' ELSE '' END || event_type AS label,
       CASE c WHEN 'rate_limit_error' THEN 'Rate limited: ' ELSE '' END || event_type AS attempt_label,
       CASE c WHEN 'authentication_error' THEN 401 WHEN 'rate_limit_error' THEN 429 WHEN 'provider_error' THEN 502
              ELSE 500 END::BIGINT AS client_status
FROM y""",
    "iso_times": """SELECT event_id,
       CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS iso,
       strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso_second FROM events""",
    "finished_attempts": f"""WITH {ATTEMPTS}
SELECT rid AS request_id, prov AS provider, ts AS start_ts, end_ts,
       CASE WHEN etype IS NULL THEN 'success' ELSE 'failed' END AS outcome, stream,
       counting AND etype IS NULL AS is_count_tokens, CASE WHEN etype IS NULL THEN k ELSE 0 END AS input_tokens,
       CASE WHEN etype IS NULL AND NOT counting THEN out_tokens ELSE 0 END AS output_tokens, agent AS user_agent,
       etype AS error_type FROM d""",
    "in_flight": f"""WITH {ATTEMPTS}
SELECT rid AS request_id, prov AS provider, ts AS start_ts, ptype AS endpoint FROM a
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.rid = a.rid)""",
    "attempt_outcomes": f"""WITH {ATTEMPTS}
SELECT ptype AS provider_type, prov AS provider,
       CASE WHEN is_open THEN 'in_progress' WHEN etype IS NULL THEN 'success' ELSE 'failed' END AS outcome, count(*) AS n
FROM a GROUP BY ALL""",
    "request_stats_from_events": f"""WITH {ATTEMPTS}
SELECT rid AS request_id, end_ts AS "timestamp", ptype AS provider_type, prov AS provider_name,
       printf('%.2f', value)::DOUBLE AS latency_ms, stream AS is_streaming, CAST(NULL AS DOUBLE) AS time_to_first_token_ms,
       k AS input_tokens, out_tokens AS output_tokens, k // 2 AS cached_tokens
FROM d WHERE etype IS NULL AND NOT counting""",
    "usage_filled": f"""WITH {ATTEMPTS}, u AS (
  SELECT *, CASE ptype WHEN 'anthropic' THEN k + k // 2 WHEN 'openai' THEN k ELSE 0 END AS prompt,
         CASE WHEN ptype IN ('anthropic', 'openai') THEN out_tokens ELSE 0 END AS completion,
         CASE WHEN ptype IN ('anthropic', 'openai') THEN k // 2 ELSE 0 END AS cached
  FROM d WHERE etype IS NULL)
SELECT rid AS request_id, ptype || CASE WHEN counting THEN '/count_tokens' ELSE '' END AS endpoint,
       CASE WHEN counting THEN k END AS input_tokens, CASE WHEN NOT counting THEN 'stop' END AS finish_reason,
       CASE WHEN NOT counting THEN prompt END AS prompt_tokens, CASE WHEN NOT counting THEN completion END AS completion_tokens,
       CASE WHEN NOT counting THEN prompt + completion END AS total_tokens, CASE WHEN NOT counting THEN cached END AS cached_tokens
FROM u""",
    "provider_stats": f"WITH {STATS}, {ATTEMPTS}, {PROVIDER_STATS} SELECT * FROM ps",
    "router_totals": f"WITH {STATS}, {ATTEMPTS}, {PROVIDER_STATS}, {TOTALS} SELECT * FROM totals",
    "uptime": f"WITH {ATTEMPTS}, {UPTIME} SELECT * FROM up",
    "metrics_long": f"WITH RECURSIVE {STATS}, {STATUS}, {PROVIDER_STATS}, {TOTALS}, {UPTIME} " + " UNION ALL ".join(_METRICS),
    "metrics_lines": f"WITH {STATS}, {ATTEMPTS}, {PROVIDER_STATS}, {TOTALS} {_exposition()}",
    "status_document": f"""WITH {STATS}, {ATTEMPTS}, {PROVIDER_STATS}, {TOTALS}, {PROVIDERS}
SELECT provider_type, total_requests, most_used_provider,
       (SELECT total_requests FROM ps WHERE ps.provider_type = totals.provider_type AND provider = 'p0') AS p0_requests,
       (SELECT total_rate_limits FROM ps WHERE ps.provider_type = totals.provider_type AND provider = 'p1') AS p1_limits,
       (SELECT printf('%.2f', success_rate)::DOUBLE FROM ps WHERE ps.provider_type = totals.provider_type AND provider = 'p2')
         AS p2_success_rate,
       CASE WHEN provider_type <> 'unknown'
            THEN (SELECT count(*) FROM p WHERE p.provider_type = totals.provider_type) END AS configured
FROM totals""",
    "error_breakdown": f"WITH {ERRORS} SELECT provider, error_type, status_code, count(*) AS errors FROM er GROUP BY ALL",
    "error_subtotals": f"""WITH {ERRORS}
SELECT provider, error_type, status_code, count(*) AS errors, grouping(provider, error_type, status_code) AS level
FROM er GROUP BY CUBE (provider, error_type, status_code)""",
    "retry_breakdown": f"""WITH {ATTEMPTS}
SELECT k % 3 + 1 AS attempt, 3::BIGINT AS max_attempts, etype AS error_type, count(*) AS retries,
       count(*) FILTER (status = 429) AS with_retry_after,
       sum((k / 2)::DECIMAL(18,3)) FILTER (status = 429)::DOUBLE / nullif(count(*) FILTER (status = 429), 0) AS avg_retry_after
FROM a WHERE etype IS NOT NULL GROUP BY ALL""",
    "fallback_edges": f"""WITH {ATTEMPTS}
SELECT prov AS from_provider, 'p' || prio AS to_provider,
       CASE etype WHEN 'rate_limit_error' THEN 'rate_limit' ELSE 'provider_error' END AS reason, count(*) AS fallbacks
FROM a WHERE etype IN ('rate_limit_error', 'provider_error') AND prio < 4 GROUP BY ALL""",
    "exhausted_requests": f"""WITH {ATTEMPTS}
SELECT count(*) FILTER (event_type = 'error' AND k >= 90) AS exhausted_requests, count(*) AS requests,
       count(*) FILTER (event_type = 'error' AND k >= 90)::DOUBLE / count(*) AS share FROM a""",
    "request_mix": f"""WITH {ATTEMPTS}
SELECT model, agent AS user_agent, stream, count(*) AS attempts, count(DISTINCT rid) AS requests FROM a GROUP BY ALL""",
    "request_mix_from_rollup": f"""WITH {ATTEMPTS}
SELECT model, agent AS user_agent, stream, count(*) AS attempts, count(DISTINCT cid) AS requests, true AS within FROM a
WHERE ts >= TIMESTAMP '2024-01-09 04:30:00' AND ts < TIMESTAMP '2024-01-23 17:15:00' GROUP BY ALL""",
    "offered_providers": f"""WITH {ATTEMPTS}, o AS (SELECT unnest(range(1, prio + 1)) AS priority FROM a)
SELECT 'p' || (priority - 1) AS name, priority, count(*) AS offered FROM o GROUP BY ALL""",
    "provider_names": f"""WITH {PROVIDERS}
SELECT position, provider_type, provider,
       coalesce(base_url, CASE provider_type WHEN 'openai' THEN 'https://api.openai.com/v1'
                                             ELSE 'https://api.anthropic.com' END) AS effective_base_url,
       '********' || CASE WHEN length(api_key) > 4 THEN right(api_key, 4) ELSE '****' END AS api_key FROM named""",
    "ranked_providers": f"""WITH {PROVIDERS}
SELECT provider_type, provider, priority, row_number() OVER (PARTITION BY provider_type ORDER BY priority, position) AS rank
FROM named""",
    "provider_priorities": f"""WITH {PROVIDERS}
SELECT 'openai' AS provider_type, s_name AS provider,
       (SELECT min(priority) FROM named WHERE provider_type = 'openai' AND provider = s_name) AS priority FROM supplier""",
    "validated_providers": f"""WITH {PROVIDERS}
SELECT DISTINCT provider_type, 'duplicate_priority' AS rule, CAST(NULL AS VARCHAR) AS provider
FROM (SELECT provider_type FROM named GROUP BY provider_type, priority HAVING count(*) > 1)
UNION ALL SELECT provider_type, 'duplicate_name', provider FROM named GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT provider_type, 'value_out_of_range', provider FROM named WHERE timeout < 1""",
    "provider_counts": f"""WITH {PROVIDERS}
SELECT t.provider_type, count(position) > 0 AS enabled, count(position) AS provider_count, 2 * count(position) AS mapped_models
FROM (SELECT unnest(['openai', 'anthropic']) AS provider_type) t LEFT JOIN p USING (provider_type) GROUP BY ALL""",
    "mapped_models": f"""WITH {PROVIDERS},
calls AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider_type,
                 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS provider, 'm' || (l_linenumber % 4) AS model FROM lineitem)
SELECT calls.provider_type, model,
       CASE WHEN named.provider IS NOT NULL AND model = 'm1' THEN m1
            WHEN named.provider IS NOT NULL AND model = 'm2' THEN 'large' ELSE model END AS mapped_model, count(*) AS calls
FROM calls LEFT JOIN named ON named.provider_type = calls.provider_type AND named.provider = calls.provider GROUP BY ALL""",
    "providers_with_statistics": f"""WITH {PROVIDERS},
seen AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider_type,
                'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS provider, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT coalesce(named.provider_type, seen.provider_type) AS provider_type, coalesce(named.provider, seen.provider) AS provider,
       priority, priority IS NOT NULL AS configured, coalesce(n, 0) AS total_requests
FROM named FULL JOIN seen ON named.provider_type = seen.provider_type AND named.provider = seen.provider""",
    "next_providers": f"""WITH {ATTEMPTS},
dim AS (SELECT ptype, prov, prio, lead(prov) OVER w AS to_provider, lead(prio) OVER w AS to_priority
        FROM (SELECT DISTINCT ptype, prov, prio FROM a) WINDOW w AS (PARTITION BY ptype ORDER BY prio))
SELECT rid AS request_id, a.ptype AS provider_type, a.prov AS provider, dim.prio AS from_priority, to_provider, to_priority
FROM a JOIN dim ON a.ptype = dim.ptype AND a.prov = dim.prov WHERE etype IS NOT NULL""",
    "request_chains": f"""WITH {ATTEMPTS}
SELECT cid AS request_id, count(*) AS attempts, count(etype) AS failures,
       first(cprov ORDER BY end_ts, seq) FILTER (etype IS NULL) AS serving_provider,
       (epoch_us(max(end_ts)) - epoch_us(min(end_ts)))::DOUBLE / 1000 AS duration_ms,
       count(*) = count(etype) AS all_failed FROM d GROUP BY 1""",
    "passed_over": f"""WITH RECURSIVE {SKIPS}
SELECT cid AS request_id, ptype AS provider_type, prov AS provider, prio AS priority, left_us::DOUBLE / 1000000 AS remaining_s
FROM skips""",
    "attempt_numbers": f"""WITH {ATTEMPTS}
SELECT cid AS request_id, cprov AS provider, end_ts AS "timestamp",
       CASE WHEN etype IS NULL THEN 'response' ELSE 'error' END AS type,
       row_number() OVER (PARTITION BY cid ORDER BY end_ts, seq) AS attempt_no FROM d""",
    "attempt_numbers_skips": f"""WITH RECURSIVE {SKIPS}
SELECT cid AS request_id, cprov AS provider, end_ts AS "timestamp",
       CASE WHEN etype IS NULL THEN 'response' ELSE 'error' END AS type,
       row_number() OVER (PARTITION BY cid ORDER BY end_ts, seq)
         + (SELECT count(DISTINCT prio) FROM skips WHERE skips.cid = d.cid AND skips.prio < d.event_id % 4 + 1) AS attempt_no
FROM d""",
    "failure_summaries": f"""WITH RECURSIVE {SKIPS},
lines AS (
  SELECT cid, event_id % 4 + 1 AS prio, end_ts AS at_ts, seq,
         '- ' || cprov || ': ' || CASE etype WHEN 'rate_limit_error' THEN 'Rate limited: ' ELSE '' END || 'e' || k AS line
  FROM a WHERE etype IS NOT NULL
  UNION ALL
  SELECT cid, prio, ts, -1, '- ' || prov || ': In cooldown for ' || round_even(left_us::DOUBLE / 1000000, 0)::BIGINT || 's'
  FROM skips)
SELECT cid AS request_id, string_agg(line, chr(10) ORDER BY prio, at_ts, seq) AS summary
FROM lines WHERE cid IN (SELECT cid FROM a WHERE etype = 'rate_limit_error' AND k >= 90) GROUP BY 1""",
    "cooldown_triggers": f"""WITH RECURSIVE {TRIGGERS}
SELECT provider_type, provider, make_timestamp(us) AS ts, seq FROM t""",
    "cooldown_triggers_daily": f"""WITH RECURSIVE {TRIGGERS}
SELECT provider_type, provider, make_timestamp(us) AS ts, seq FROM t""",
    "cooldown_episodes": f"""WITH RECURSIVE {EPISODES}
SELECT provider_type, provider, make_timestamp(us) AS start_ts, make_timestamp(deadline) AS deadline_ts,
       make_timestamp(CASE WHEN replaced THEN next_us ELSE deadline END) AS end_ts, replaced, credit AS credited_seconds, seq
FROM credited""",
    "cooldown_status": f"WITH RECURSIVE {STATUS} SELECT * FROM status",
    "recent_rate_limits": f"WITH RECURSIVE {TRIGGERS}, {RECENT} SELECT * FROM recent",
    "cooldown_hits": f"""WITH RECURSIVE {TRIGGERS}
SELECT rid AS request_id, ptype AS provider_type, prov AS provider,
       EXISTS (SELECT 1 FROM t WHERE t.provider_type = ptype AND t.provider = prov AND us <= epoch_us(ts)
               AND epoch_us(ts) < us + {COOLDOWN_US}) AS in_cooldown FROM a""",
    "skipped_providers": f"""WITH RECURSIVE {TRIGGERS},
dim AS (SELECT DISTINCT ptype, prov, prio FROM a),
above AS (
  SELECT a.rid, a.ptype, dim.prov, dim.prio, epoch_us(a.ts) AS at_us FROM a JOIN dim ON a.ptype = dim.ptype
  WHERE NOT (a.etype IS NULL AND NOT a.is_open) OR dim.prio < a.prio)
SELECT rid AS request_id, ptype AS provider_type, prov AS provider, prio AS priority FROM above
WHERE EXISTS (SELECT 1 FROM t WHERE t.provider_type = ptype AND t.provider = prov AND us <= at_us AND at_us < us + {COOLDOWN_US})""",
    "running_latency": """SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS highest,
       min(value) OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
         AS lowest_ahead
FROM events WINDOW w AS (PARTITION BY user_id % 4 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "sse_events": f"WITH {TURNS} SELECT request_id, 'f' || turn AS finish_reason, text AS content FROM c",
    "merged_openai": f"""WITH {OPENAI}
SELECT request_id, id, 'chat.completion' AS object, 1700000000::BIGINT AS created, model, prompt_tokens, completion_tokens,
       turn % 2 AS choice, arg_max(role, turn) AS role, string_agg(text, '' ORDER BY turn) AS content,
       arg_max('f' || turn, turn) AS finish_reason, tool_calls
FROM c JOIN heads USING (request_id) JOIN tools ON tools.request_id = c.request_id AND tools.choice = turn % 2
GROUP BY ALL""",
    "merged_anthropic": f"""WITH {TURNS}
SELECT request_id, 'msg-' || conv_id AS id, 'model-a' AS model, 's' || last_turn AS stop_reason, 20::BIGINT AS input_tokens,
       (SELECT length(z.text) FROM c z WHERE z.request_id = c.request_id AND z.turn = c.last_turn) AS output_tokens,
       3::BIGINT AS cache_creation_input_tokens, 5::BIGINT AS cache_read_input_tokens, turn AS block,
       CASE WHEN role = 'assistant' THEN 'tool_use' ELSE 'text' END AS type,
       CASE WHEN role = 'assistant' THEN 't' || turn END AS tool_id,
       CASE WHEN role <> 'assistant' THEN text || '|' || text END AS text,
       CASE WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 3 THEN '{{}}' ELSE '{{"n":' || turn || '}}' END END AS input
FROM c""",
    "merged_anthropic_open": f"""WITH {TURNS}
SELECT request_id, 'standard' AS service_tier, last_turn::BIGINT AS web_searches,
       (SELECT length(z.text) FROM c z WHERE z.request_id = c.request_id AND z.turn = c.last_turn) AS output_tokens,
       turn AS block, CASE WHEN role = 'assistant' THEN 'use-' || turn END AS tool_use_id,
       CASE WHEN role <> 'assistant' THEN role END AS citation, CASE WHEN role <> 'assistant' THEN '' END AS start_text
FROM c""",
    "merged_documents": "SELECT 'd' || doc_id AS request_id, text AS content FROM documents",
    "tool_inputs": """SELECT 'c' || conv_id AS request_id, turn AS position, 't' || turn AS id, 'find' AS name,
       CASE WHEN turn % 4 <> 3 THEN turn END AS n FROM conversations WHERE role = 'assistant'""",
    "chunk_timing": """SELECT 'c' || conv_id AS request_id,
       TIMESTAMP '2024-01-01' + to_microseconds(conv_id * 1000000 + (2 * max(turn) + 1) * 10000) AS last_ts,
       (50 + (2 * max(turn) + 1) * 10)::DOUBLE AS duration_ms, 50.0::DOUBLE AS time_to_first_token_ms
FROM conversations GROUP BY conv_id""",
    "stats_from_chunks": f"""WITH {PIECES}
SELECT request_id, TIMESTAMP '2024-01-01' + to_microseconds(conv_id * 1000000 + (2 * n_turns + 1) * 10000) AS "timestamp",
       provider_type, 'p' || (conv_id % 4) AS provider_name, (50 + (2 * n_turns + 1) * 10)::DOUBLE AS latency_ms,
       true AS is_streaming, 50.0::DOUBLE AS time_to_first_token_ms, prompt AS input_tokens, out AS output_tokens,
       cached AS cached_tokens FROM pieces""",
    "streaming_requests": f"""WITH {STATS}, {spine("hour", 720)},
g AS (SELECT date_trunc('hour', "timestamp") AS "timestamp", count(*) AS n, sum(input_tokens) AS i, sum(output_tokens) AS o,
             sum(cached_tokens) AS c FROM s GROUP BY 1)
SELECT spine."timestamp"::TIMESTAMP AS "timestamp", coalesce(n, 0) AS count, coalesce(i, 0)::BIGINT AS input_tokens,
       coalesce(o, 0)::BIGINT AS output_tokens, coalesce(c, 0)::BIGINT AS cached_tokens,
       coalesce(i + o, 0)::BIGINT AS total_tokens
FROM spine LEFT JOIN g USING ("timestamp")""",
    "streaming_counters": f"""WITH {STATS}, {ATTEMPTS}, {PROVIDER_STATS}
SELECT provider_type, provider, total_requests, successful_requests, failed_requests, total_rate_limits, total_input_tokens,
       total_output_tokens, total_latency_ms, last_success_time FROM ps""",
    "streaming_cooldown": f"""WITH RECURSIVE {TRIGGERS}
SELECT provider_type, provider, make_timestamp(us) AS ts, seq FROM t""",
    "streaming_cooldown_unordered": f"""WITH RECURSIVE {TRIGGERS}
SELECT provider_type, provider, make_timestamp(us) AS ts, seq, false AS late FROM t""",
    "streaming_late_rows": f"""WITH {STATS}
SELECT date_trunc('hour', "timestamp") AS bucket, provider_type, provider_name, count(*) AS request_count,
       sum(input_tokens + output_tokens)::BIGINT AS total_tokens, max("timestamp") AS max_timestamp FROM s GROUP BY ALL""",
    "streaming_in_flight": f"""WITH {ATTEMPTS}
-- the stream reports an open call once its watermark (one minute) has passed the time-out (one minute)
SELECT rid AS request_id, prov AS provider, ts AS start_ts FROM a
WHERE is_open AND ts < least((SELECT max(ts) FROM a), (SELECT max(end_ts) FROM d)) - INTERVAL 2 MINUTE""",
    "streaming_assembly": """SELECT 'c' || conv_id AS request_id, turn % 2 AS choice,
       string_agg(text, '' ORDER BY turn) AS content FROM conversations GROUP BY ALL""",
}
ORACLES["merged_anthropic"] = ORACLES["merged_anthropic"].replace("{{", "{").replace("}}", "}")
ORACLES["streaming_stats"] = ORACLES["stats_from_chunks"]
