"""Plans that must hold at scale: no pairing joins, pruned scans, sums before the shuffle."""

import pytest

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
# the operators for training data may use Python inside tasks, but for the native ones
NATIVE = [n for n in QUERIES if n not in entry_module.LLM_QUERIES or n.startswith(("op3_", "op4_", "op8_", "op13_"))]
PYTHON = ["EvalPython", "InArrow", "InPandas", "MapPartitions"]
LAZY = [n for n in sorted(QUERIES) if not n.startswith("streaming_")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name in NATIVE:
        assert not [step for step in PYTHON if step in text]


def test_report_reads_one_column_with_the_bound_pushed_down(spark, sf_dir):
    text = plan(QUERIES["requests_hour"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text
    assert "GreaterThanOrEqual(ts,2023-12-31T12:34:56)" in text
    assert "partial_count" in text


def test_statistics_do_not_sort_rows(spark, sf_dir):
    from gatelens.operators.stats import event_counters
    from gatelens.plans import demo

    text = plan(event_counters(demo.router_events(spark, sf_dir)))
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_triggers_share_their_shuffles(spark):
    from gatelens.operators import cooldown

    log = spark.range(20000).selectExpr(
        "concat('p', id % 3) as provider", "timestamp_micros(id * 7000000) as ts", "id as seq",
        "if(id % 11 = 0, 'success', 'rate_limited') as outcome",
    )
    df = cooldown.triggers(log)
    assert df.collect()
    assert plan(df).split("Initial Plan")[0].count("ReusedExchange") >= 2


def test_events_are_decoded_once_for_a_merge(spark, sf_dir):
    from gatelens.operators import chunks
    from gatelens.plans import demo

    events = chunks.sse_events(demo.conversation_chunks(spark, sf_dir, "openai"))
    once = plan(events).count("Generate")
    # choices and tool calls are unfolded once each
    assert plan(chunks.merge_openai(events)).count("Generate") == once + 2


@pytest.mark.parametrize("name", ["sse_events", "merged_openai", "merged_anthropic", "stats_from_chunks"])
def test_lines_are_parsed_once(spark, sf_dir, name):
    """Not again in a filter, nor in each branch of the union of lines."""
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parseJson(concat([, payload") == 1
