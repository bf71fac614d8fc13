import datetime as dt

import pytest
from helpers import T0, log
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatelens.operators import cooldown as C
from gatelens.operators import daily
from gatelens.operators import running as running_module
from gatelens.operators.running import running, time_slice


def outcomes(spark, rows):
    """(provider, seconds, outcome) in log order."""
    data = [(p, T0 + dt.timedelta(seconds=s), n, o) for n, (p, s, o) in enumerate(rows)]
    return spark.createDataFrame(data, "provider string, ts timestamp, seq long, outcome string")


def limits(*seconds, provider="p"):
    return [(provider, s, C.RATE_LIMITED) for s in seconds]


def ok(s, provider="p"):
    return (provider, s, C.SUCCESS)


def state(spark, rows, at, **rule):
    """recent count, in cooldown, remaining seconds, triggers, credited seconds of provider p."""
    df = outcomes(spark, rows)
    as_of = T0 + dt.timedelta(seconds=at)
    trig = C.triggers(df, **rule)
    status = C.cooldown_status(
        spark.createDataFrame([("p",)], "provider string"),
        C.episodes(trig, as_of),
        C.recent_rate_limits(df, trig, as_of),
        as_of,
    ).first()
    return (
        status.recent_rate_limits,
        status.in_cooldown,
        status.cooldown_remaining_seconds,
        status.cooldown_count,
        status.total_cooldown_time_seconds,
    )


@pytest.mark.parametrize(
    ("rows", "at", "expected"),
    [
        ([], 10, (0, False, 0.0, 0, 0.0)),
        (limits(0), 10, (1, False, 0.0, 0, 0.0)),
        (limits(0, 1, 2), 10, (0, True, 592.0, 1, 0.0)),
        (limits(0, 1, 2), 602, (0, False, 0.0, 1, 600.0)),  # over at its deadline
        (limits(0, 1, 2), 601.999, (0, True, 0.001, 1, 0.0)),
        (limits(0, 1) + [ok(2)], 10, (0, False, 0.0, 0, 0.0)),
        (limits(0, 1, 2) + [ok(3)], 10, (0, True, 592.0, 1, 0.0)),  # a success does not end a cooldown
        (limits(0, 70), 80, (1, False, 0.0, 0, 0.0)),
        (limits(0, 30, 60), 61, (0, True, 599.0, 1, 0.0)),  # exactly as old as the window: counts
        (limits(0, 30, 60.000001), 61, (2, False, 0.0, 0, 0.0)),
        (limits(0, 1, 2, 3), 10, (1, True, 592.0, 1, 0.0)),
        (limits(5, 5, 5), 10, (0, True, 595.0, 1, 0.0)),
        (limits(0, 1, 2, 3, 4, 5), 700, (0, False, 0.0, 2, 600.0)),  # the first cooldown was replaced
        (limits(0, 1, 2) + limits(0, 1, provider="q"), 10, (0, True, 592.0, 1, 0.0)),
        (limits(0, 1, 2) + limits(700, 701, 702), 2000, (0, False, 0.0, 2, 1200.0)),
    ],
)
def test_rule(spark, rows, at, expected):
    got = state(spark, rows, at)
    assert got == pytest.approx(expected)


def walk(rows, k, window):
    """The rule, one event after the other."""
    found, open_limits = [], {}
    for n, (p, s, o) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        buffer = open_limits.setdefault(p, [])
        if o == C.SUCCESS:
            buffer.clear()
        elif o == C.RATE_LIMITED:
            buffer[:] = [b for b in buffer if s - b <= window] + [s]
            if len(buffer) >= k:
                found.append((p, n))
                buffer.clear()
    return sorted(found)


events = st.lists(
    st.tuples(
        st.sampled_from("pppq"),
        st.integers(0, 120),
        st.sampled_from([C.RATE_LIMITED] * 5 + [C.SUCCESS, C.OTHER]),
    ),
    max_size=150,
)


@settings(max_examples=12, deadline=None)
@given(events, st.integers(1, 4), st.integers(1, 30), st.integers(1, 50), st.integers(4, 9))
def test_same_as_one_after_the_other(spark, rows, k, window, slice_s, chunk):
    got = C.triggers(outcomes(spark, rows), k, window, slice_s=slice_s, chunk=chunk, group=3)
    assert sorted((r.provider, r.seq) for r in got.collect()) == walk(rows, k, window)


def test_long_storm_over_many_chunks(spark):
    rows = limits(*range(5000))
    got = C.triggers(outcomes(spark, rows), 3, 60, chunk=8, group=8)  # 625 chunks in 79 groups
    assert sorted(r.seq for r in got.collect()) == list(range(2, 5000, 3))


def test_one_time_for_everything(spark):
    rows = limits(*[5] * 600) + [ok(5)] + limits(*[5] * 10)
    df = outcomes(spark, rows)
    assert sorted(r.seq for r in C.triggers(df).collect()) == sorted(n for _, n in walk(rows, 3, 60))


def test_argument_checks(spark):
    with pytest.raises(ValueError):
        C.triggers(outcomes(spark, []), 0)
    with pytest.raises(ValueError):
        C.triggers(outcomes(spark, []), 5, chunk=4)


def test_resets_by_kind_of_success(spark):
    def call(rid, at, stream, counting=False):
        end = {"type": "response", "request_id": rid, "provider": "p", "at": at + 1, "duration_ms": 1.0}
        end |= {"input_tokens": 1} if counting else {"usage": (1, 1, 2, 0)}
        return [{"type": "request", "request_id": rid, "provider": "p", "at": at, "stream": stream}, end]

    rows = call("a", 0, True) + call("b", 10, False) + call("c", 20, False, counting=True)
    got = C.outcomes(log(spark, rows)).orderBy("seq").collect()
    assert [r.outcome for r in got] == [C.OTHER, C.SUCCESS, C.OTHER]
    every = C.outcomes(log(spark, rows), F.lit(True)).orderBy("seq").collect()
    assert [r.outcome for r in every] == [C.SUCCESS] * 3


@settings(max_examples=8, deadline=None)
@given(events, st.lists(st.tuples(st.sampled_from("pq"), st.integers(0, 200)), max_size=30))
def test_cooldown_at_a_time(spark, rows, asked):
    trig = C.triggers(outcomes(spark, rows), 2, 10)
    starts = [(r.provider, r.us) for r in trig.collect()]
    asks = spark.createDataFrame(
        [(n, p, T0 + dt.timedelta(seconds=s)) for n, (p, s) in enumerate(asked)], "n int, provider string, ts timestamp"
    )
    got = {r.n: r.in_cooldown for r in C.with_cooldown(asks, trig, 20).collect()}
    zero = int(T0.timestamp() * 1_000_000)
    for n, (p, s) in enumerate(asked):
        us = zero + s * 1_000_000
        assert got[n] == any(q == p and start <= us < start + 20_000_000 for q, start in starts)


def test_skipped_providers(spark):
    trig = C.triggers(outcomes(spark, limits(0, 1, 2, provider="a")), 3, 60)
    requests = spark.createDataFrame(
        [("r1", "t", T0 + dt.timedelta(seconds=10), 2), ("r2", "t", T0 + dt.timedelta(seconds=10), 1),
         ("r3", "t", T0 + dt.timedelta(seconds=10), None), ("r4", "t", T0 + dt.timedelta(seconds=700), 2)],
        "request_id string, provider_type string, ts timestamp, served_priority int",
    )
    dimension = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "provider_type string, provider string, priority int")
    got = C.skipped_providers(requests, dimension, trig)
    assert sorted((r.request_id, r.provider) for r in got.collect()) == [("r1", "a"), ("r3", "a")]


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(-5, 5)), max_size=60),
    st.integers(1, 70),
    st.sampled_from([2, 4096]),
)
@example([("a", 7, n % 5) for n in range(40)], 10, 2)  # one time for everything
@example([("a", n, n % 5) for n in range(40)], 1, 3)  # many blocks of slices
def test_running(spark, rows, slice_s, block):
    running_module.BLOCK = block
    data = [(k, us * 1_000_000, n, v) for n, (k, us, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, us long, n long, v long")
    got = running(
        df, ["k"], ["us", "n"], time_slice("us", slice_s), {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))},
    )
    back = running(
        df, ["k"], ["us", "n"], time_slice("us", slice_s), {"low": ("min", F.col("v"))}, reverse=True, inclusive=False,
    )
    low = {r.n: r.low for r in back.collect()}
    for r in got.collect():
        before = [v for k, us, n, v in data if k == r.k and (us, n) <= (r.us, r.n)]
        after = [v for k, us, n, v in data if k == r.k and (us, n) > (r.us, r.n)]
        assert (r.s, r.m, low[r.n]) == (sum(before), max(before), min(after, default=None))


@settings(max_examples=8, deadline=None)
@given(events, st.lists(st.tuples(st.sampled_from("pq"), st.integers(0, 200)), max_size=30), st.integers(1, 300))
def test_time_left(spark, rows, asked, slice_s):
    trig = C.triggers(outcomes(spark, rows), 2, 10)
    starts = [(r.provider, r.us) for r in trig.collect()]
    asks = spark.createDataFrame(
        [(n, p, T0 + dt.timedelta(seconds=s)) for n, (p, s) in enumerate(asked)], "us int, provider string, ts timestamp"
    )
    got = {r.us: r.remaining_s for r in C.with_remaining(asks, trig, 20, slice_s=slice_s).collect()}
    zero = int(T0.timestamp() * 1_000_000)
    assert len(got) == len(asked)
    for n, (p, s) in enumerate(asked):
        us = zero + s * 1_000_000
        last = max((start for q, start in starts if q == p and start <= us), default=None)
        left = None if last is None or last + 20_000_000 <= us else (last + 20_000_000 - us) / 1_000_000
        assert got[n] == left


@settings(max_examples=10, deadline=None)
@given(events, st.integers(1, 4), st.integers(1, 20), st.integers(4, 9), st.integers(1, 3))
def test_days_one_by_one(spark, rows, k, window, chunk, group):
    """Maps of short days, composed, give the triggers of one run."""
    rule = daily.DailyRule(k, window, slice_s=7, chunk=chunk, group=group, day_s=20)
    marks = daily.day_marks(outcomes(spark, rows), window, rule.day_s)
    maps = rule.maps(marks)
    got = rule.triggers(marks, daily.entry_states(maps))
    assert sorted((r.provider, r.seq) for r in got.collect()) == walk(rows, k, window)


def test_daily_table(spark, tmp_path):
    """Days come one by one and out of order, and one is computed again with more rows: later ones are named."""
    day0 = dt.date(2024, 1, 1)
    limits_at = [(0, 86_390), (0, 86_395), (1, 1), (1, 5), (1, 9), (2, 3)]

    def table(extra=()):
        rows = [("t", "p", dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=s), n, C.RATE_LIMITED) for n, (d, s) in enumerate([*limits_at, *extra])]
        df = spark.createDataFrame(rows, "provider_type string, provider string, ts timestamp, seq long, outcome string")
        path = str(tmp_path / f"outcomes{len(extra)}")
        df.withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(path)
        return spark.read.parquet(path), sorted(r.us for r in C.triggers(df, 3, 60).collect())

    first, expected = table()
    found = daily.DailyCooldown(str(tmp_path / "daily"), daily.DailyRule(3, 60))
    days = [day0 + dt.timedelta(days=n) for n in range(3)]
    for day in (days[0], days[2], days[1]):
        for later in found.run(first, [day]):
            found.pick(first, [later])
    assert sorted(r.us for r in found.triggers(spark).collect()) == expected and len(expected) == 1
    grown, expected = table([(0, 86_380)])
    assert found.run(grown, [days[0]]) == days[1:]  # three days' limits count as one row of them
    found.pick(grown, days[1:])
    assert sorted(r.us for r in found.triggers(spark).collect()) == expected and len(expected) == 2
    read = found.marks_of(grown, [days[1]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read and "2024-01-03" not in read
