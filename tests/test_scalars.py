import datetime as dt
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatelens.functions import derive as D
from gatelens.functions import usage as U


def docs(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return rows.select("i", F.try_parse_json("t").alias("d")).orderBy("i")


def test_usage(spark):
    openai = [
        {"choices": [], "usage": {"prompt_tokens": 10, "completion_tokens": 8, "total_tokens": 18}},
        {"usage": {"prompt_tokens": 10, "completion_tokens": 5, "prompt_tokens_details": {"cached_tokens": 2}}},
        {"choices": [], "served": "nothing"},
        {"usage": None},
    ]
    out = docs(spark, map(json.dumps, openai)).select(F.inline(F.array(U.usage_openai(F.col("d"))))).collect()
    assert [tuple(r) for r in out] == [(10, 8, 18, 0), (10, 5, 15, 2), (0, 0, 0, 0), (0, 0, 0, 0)]
    anthropic = [
        {"usage": {"input_tokens": 10, "output_tokens": 8}},
        {
            "usage": {
                "input_tokens": 10,
                "cache_creation_input_tokens": 3,
                "cache_read_input_tokens": 5,
                "output_tokens": 8,
            }
        },
    ]
    out = docs(spark, map(json.dumps, anthropic)).select(F.inline(F.array(U.usage_anthropic(F.col("d"))))).collect()
    assert [tuple(r) for r in out] == [(10, 8, 18, 0), (18, 8, 26, 5)]


def test_finish_reason_and_count_tokens(spark):
    texts = [
        {"choices": [{"finish_reason": "stop"}], "stop_reason": "x", "model": "m", "input_tokens": 3},
        {"choices": [], "stop_reason": "x"},
        {"stop_reason": "end_turn"},
        {"input_tokens": 42},
    ]
    out = docs(spark, map(json.dumps, texts)).select(U.finish_reason(F.col("d")), U.is_count_tokens(F.col("d"))).collect()
    assert [tuple(r) for r in out] == [("stop", False), (None, False), ("end_turn", False), (None, True)]


def test_request_profile(spark):
    texts = [
        {"model": "gpt-4", "messages": [{}, {}], "temperature": 0.5, "max_tokens": 9, "stream": True},
        {},
    ]
    out = docs(spark, map(json.dumps, texts)).select(F.inline(F.array(U.request_profile(F.col("d"))))).collect()
    assert [tuple(r) for r in out] == [("gpt-4", 2, 0.5, 9, True), ("", 0, None, None, False)]


def test_request_profile_with_user_agent(spark):
    profile = U.request_profile(F.col("d"), F.lit("curl/8"))
    assert docs(spark, ['{"model": "m"}']).select(profile.alias("p")).first().p.user_agent == "curl/8"


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.integers(0, 10**8).map(lambda n: n / 1000),
            st.floats(0, 1e9, allow_nan=False),
            st.integers(0, 10**6).map(lambda n: n / 8),
        ),
        min_size=30,
        max_size=300,
    )
)
def test_rounding_is_exact(spark, values):
    values += [2.675, 0.125, 0.375, 1.005, 4.395, 1e-9, 0.005, 0.015]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r[0] for r in df.select(D.round_ms(F.col("v"))).collect()]
    assert got == [round(float(v), 2) for v in values]


def test_small_derivations(spark):
    df = spark.createDataFrame(
        [("openai/x", 401), ("anthropic", 429), ("other", 500), (None, 302)], "endpoint string, status int"
    )
    out = df.select(
        D.provider_type(F.col("endpoint")), D.classify_error(F.col("status")), D.client_status(D.classify_error(F.col("status")))
    ).collect()
    assert [tuple(r) for r in out] == [
        ("openai", "authentication_error", 401),
        ("anthropic", "rate_limit_error", 429),
        ("unknown", "provider_error", 502),
        ("unknown", "llm_error", 500),
    ]


def test_times(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (None,)], "s double")
    assert [r[0] for r in df.select(D.iso_utc_epoch(F.col("s"))).collect()] == [
        dt.datetime.fromtimestamp(0, dt.timezone.utc).isoformat(),
        dt.datetime.fromtimestamp(1.5, dt.timezone.utc).isoformat(),
        None,
    ]
