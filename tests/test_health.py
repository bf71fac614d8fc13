import datetime as dt
import json

from helpers import T0, log, usage
from pyspark.sql import functions as F

from gatelens import schemas
from gatelens.operators import providers as P
from gatelens.plans import health, publish
from gatelens.session import sizing


def call(rid, provider, at, status=None, endpoint="openai", prompt=10):
    start = {"type": "request", "request_id": rid, "provider": provider, "at": at, "stream": False, "endpoint": endpoint}
    end = {"request_id": rid, "provider": provider, "at": at + 1, "endpoint": endpoint}
    if status:
        return [start, end | {"type": "error", "error_type": "rate_limit_error", "error_message": "slow", "status_code": status}]
    return [start, end | {"type": "response", "duration_ms": 33.333, "usage": usage(prompt, 3, 1)}]


def test_status_document_and_metrics(spark):
    rows = [{"type": "configuration", "config_type": "router_start", "endpoint": "openai", "at": 0}]
    for n in range(3):
        rows += call(f"r{n}", "a", 10 * n, 429)
    rows += call("r3", "b", 40) + call("r4", "b", 50) + call("r5", "c", 60, endpoint="anthropic")
    events = log(spark, rows)
    config = spark.createDataFrame(
        [
            ("openai", "sk-secret-1234", 1, None, 30, 3, {"gpt-4": "x"}, "a", 0),
            ("openai", "sk-secret-5678", 2, "https://b", 30, 3, {}, "b", 1),
            ("anthropic", "sk-secret-9999", 1, None, 30, 3, {}, "idle \"x\"", 0),
        ],
        schemas.PROVIDERS,
    )
    names = P.with_names(config)
    as_of = T0 + dt.timedelta(seconds=100)
    stats = spark.createDataFrame([], schemas.REQUEST_STATS)
    everyone = names.select("provider_type", "provider")
    ps, totals = health.provider_health(events, stats, everyone, as_of)
    text = publish.status_json(names, P.provider_counts(config), ps, totals).first().status
    assert "secret" not in text
    doc = json.loads(text)
    assert doc["config"]["openai"]["provider_count"] == 2 and doc["config"]["anthropic"]["enabled"] is True
    assert doc["config"]["openai"]["providers"][0] == {
        "name": "a", "priority": 1, "base_url": None, "model_mapping": {"gpt-4": "x"},
    }
    assert doc["config"]["anthropic"]["providers"][0]["name"] == 'idle "x"'
    openai = doc["statistics"]["openai"]
    assert openai["uptime_seconds"] == 100.0 and openai["most_used_provider"] == "a" and openai["fastest_provider"] == "b"
    assert openai["total_tokens"] == 26
    a, b = openai["providers"]["a"], openai["providers"]["b"]
    assert a["rate_limits"] == {
        "total_rate_limits": 3,
        "recent_rate_limits": 0,
        "cooldown_count": 1,
        "total_cooldown_time_seconds": 0.0,
        "in_cooldown": True,
        "cooldown_remaining_seconds": 521.0,
        "last_cooldown_start_time": "2024-01-01T00:00:21+00:00",
    }
    assert a["last_error"] == "Rate limit error: slow" and a["success_rate"] == 0.0
    assert b["last_error"] is None and b["average_latency_ms"] == 33.33 and b["rate_limits"]["in_cooldown"] is False
    assert b["last_success_time"] == "2024-01-01T00:00:51+00:00"
    lines = [r.line for r in publish.metrics_text(publish.metrics(ps, totals), "1").collect()]
    assert 'gateway_provider_in_cooldown{provider_type="openai",provider="a"} 1' in lines
    assert 'gateway_provider_cooldown_remaining_seconds{provider_type="openai",provider="a"} 521' in lines
    assert not any(line.startswith('gateway_provider_cooldown_remaining_seconds{provider_type="openai",provider="b"}') for line in lines)


def test_metrics_file(spark, tmp_path):
    lines = spark.range(5).select(F.struct((4 - F.col("id")).alias("n")).alias("ord"), F.col("id").cast("string").alias("line"))
    publish.write_metrics_text(lines, str(tmp_path / "m"))
    assert next((tmp_path / "m").glob("*.txt")).read_text() == "4\n3\n2\n1\n0\n"


def test_sizing():
    assert sizing(10**14, 4000)["spark.sql.shuffle.partitions"] == "745059"
    assert sizing(0, 8)["spark.sql.shuffle.partitions"] == "24"
