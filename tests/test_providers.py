from gatelens import schemas
from gatelens.operators import chains
from gatelens.operators import providers as P


def dimension(spark, rows):
    filled = [
        (t, "key", priority, None, 30, 3, mapping, name, n) for n, (t, priority, name, mapping) in enumerate(rows)
    ]
    return spark.createDataFrame(filled, schemas.PROVIDERS)


def test_rank_priority_and_next(spark):
    df = dimension(
        spark, [("openai", 2, "b", {}), ("openai", 1, "a", {}), ("openai", 2, "c", {}), ("anthropic", 9, None, {})]
    )
    ranked = P.ranked_providers(df).orderBy("provider_type", "rank").collect()
    assert [(r.provider, r.rank) for r in ranked] == [("anthropic-priority-9", 1), ("a", 1), ("b", 2), ("c", 3)]
    asked = spark.createDataFrame([("openai", "c"), ("openai", "x")], "provider_type string, provider string")
    assert {(r.provider, r.priority) for r in P.priority_of(df, asked).collect()} == {("c", 2), ("x", None)}
    failed = spark.createDataFrame(
        [("r", "openai", "b"), ("r", "openai", "c")], "request_id string, provider_type string, provider string"
    )
    follow = {r.provider: r.to_provider for r in chains.next_provider(failed, df).collect()}
    assert follow == {"b": "c", "c": None}


def test_model_mapping(spark):
    df = dimension(spark, [("openai", 1, "a", {"gpt-4": "gpt-4-x"}), ("openai", 2, "a", None)])
    calls = spark.createDataFrame(
        [("openai", "a", "gpt-4"), ("openai", "a", "other"), ("openai", "z", "gpt-4"), ("openai", "a", None)],
        "provider_type string, provider string, model string",
    )
    mapped = P.map_model(calls, df).collect()
    assert sorted((r.provider, r.model or "", r.mapped_model or "") for r in mapped) == [
        ("a", "", ""), ("a", "gpt-4", "gpt-4-x"), ("a", "other", "other"), ("z", "gpt-4", "gpt-4"),
    ]


def test_counts_and_validation(spark):
    df = dimension(spark, [("openai", 1, "a", {"x": "y"}), ("openai", 1, "a", {}), ("openai", 0, "b", {})])
    counts = {r.provider_type: (r.enabled, r.provider_count, r.mapped_models) for r in P.provider_counts(df).collect()}
    assert counts == {"openai": (True, 3, 1), "anthropic": (False, 0, 0)}
    assert sorted((r.rule, r.provider) for r in P.validate_providers(df).collect() if r.provider) == [
        ("duplicate_name", "a"), ("value_out_of_range", "b"),
    ]


def test_idle_providers_are_listed(spark):
    df = dimension(spark, [("openai", 1, "a", {}), ("openai", 2, "idle", {})])
    seen = spark.createDataFrame([("openai", "a", 5), ("openai", "gone", 2)], "provider_type string, provider string, total_requests long")
    got = {r.provider: (r.configured, r.total_requests) for r in P.with_statistics(df, seen).collect()}
    assert got == {"a": (True, 5), "idle": (True, 0), "gone": (False, 2)}
