import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F
from helpers import log
from test_chunks import delta, ending, recorded, start, stream

from gatelens.operators import chunks as B
from gatelens.operators import cooldown as C
from gatelens.operators import reports as R
from gatelens.operators.stats import event_counters
from gatelens.plans import demo
from gatelens.streaming import chunks as live_chunks
from gatelens.streaming import live, update_log
from gatelens.streaming.cooldown import LiveCooldown, live_outcomes, read_late, read_triggers
from gatelens.streaming.rollup import LiveRollup
from gatelens.streaming.stats import CLOSED, closed_responses

AS_OF = demo.AS_OF


def in_files(df, path, by, n):
    """Write a table as n files, in the order of a column."""
    part = df.withColumn("part", F.ntile(n).over(Window.orderBy(by)))
    for i in range(1, n + 1):
        part.filter(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(str(path))


def test_live_series_is_the_batch_series(spark, sf_dir, tmp_path):
    stats = demo.request_stats(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    in_files(stats, tmp_path / "in", "timestamp", 4)
    rows = live.stream_parquet(spark, str(tmp_path / "in"), files_per_trigger=1)
    out = str(tmp_path / "out")
    key = ["bucket", "provider_type", "provider_name"]
    changes = live.live_requests(rows, "hour")
    update_log.start(changes, out, str(tmp_path / "ck"), key, fan=2).awaitTermination()
    windows = update_log.latest(spark, out, key)
    got = live.live_series(windows, AS_OF, "hour", 48, "openai").collect()
    batch = R.requests_over_time(stats, AS_OF, "hour", 48, "openai").collect()
    # the live form keeps the first window whole
    assert [tuple(r)[:2] for r in got[1:]] == [tuple(r) for r in batch[1:]]
    tokens = R.tokens_over_time(stats, AS_OF, "hour", 48, "openai").collect()
    assert [r.total_tokens for r in got[1:]] == [r.total_tokens for r in tokens[1:]]


def test_live_counters_are_the_batch_counters(spark, sf_dir, tmp_path):
    log = demo.router_events(spark, sf_dir).filter("type in ('request', 'response', 'error')").drop("full_request", "full_response", "details")
    in_files(log, tmp_path / "in", "timestamp", 3)
    rows = live.stream_parquet(spark, str(tmp_path / "in"), files_per_trigger=1)
    out = str(tmp_path / "out")
    update_log.start(live.live_counters(rows), out, str(tmp_path / "ck"), ["provider_type", "provider"]).awaitTermination()
    got = update_log.latest(spark, out, ["provider_type", "provider"])
    batch = event_counters(log)
    assert sorted(map(tuple, got.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def _outcomes(spark, sf_dir):
    return C.outcomes(demo.router_events(spark, sf_dir)).filter(F.col("outcome") != C.OTHER)


def test_live_cooldown_finds_the_batch_triggers(spark, sf_dir, tmp_path):
    rows = _outcomes(spark, sf_dir)
    in_files(rows, tmp_path / "in", "ts", 5)
    path = str(tmp_path / "live")
    detector = LiveCooldown(path, 3, 40_000, slice_s=3600)
    source = live.stream_parquet(spark, str(tmp_path / "in"), files_per_trigger=1)
    detector.start(source, str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.provider_type, r.provider, r.us, r.seq) for r in read_triggers(spark, path).collect())
    batch = C.triggers(rows, 3, 40_000, slice_s=3600).collect()
    assert got == sorted((r.provider_type, r.provider, r.us, r.seq) for r in batch) and got
    assert read_late(spark, path).count() == 0


def test_live_cooldown_repeats_a_batch_and_sets_late_rows_aside(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)

    def batch(*rows):
        data = [("p", t0 + dt.timedelta(seconds=s), n, C.RATE_LIMITED) for n, s in rows]
        return spark.createDataFrame(data, "provider string, ts timestamp, seq long, outcome string")

    detector = LiveCooldown(str(tmp_path), 3, 60)
    detector.process(batch((0, 0), (1, 10)), 0)
    for _ in range(2):  # the same batch again after a failure
        detector.process(batch((2, 5), (3, 20)), 1)
    detector.process(batch((4, 25), (5, 26), (6, 27)), 2)
    assert sorted(r.seq for r in read_triggers(spark, str(tmp_path)).collect()) == [3, 6]
    assert [r.seq for r in read_late(spark, str(tmp_path)).collect()] == [2]


def test_live_cooldown_waits_for_events_out_of_order(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)

    def batch(*rows):
        data = [("p", t0 + dt.timedelta(seconds=s), n, kind) for n, s, kind in rows]
        return spark.createDataFrame(data, "provider string, ts timestamp, seq long, outcome string")

    hit, good = C.RATE_LIMITED, C.SUCCESS
    detector = LiveCooldown(str(tmp_path), 3, 60, lateness_s=10)
    detector.process(batch((0, 0, hit), (1, 12, hit)), 0)
    for _ in range(2):  # the same batch again after a failure; (2) is older than what came before, (1) is a copy
        detector.process(batch((2, 5, hit), (1, 12, hit)), 1)
    assert [r.seq for r in detector.expected(spark).collect()] == [1]
    detector.process(batch((3, 30, hit), (4, 31, hit)), 2)
    assert [r.seq for r in read_triggers(spark, str(tmp_path)).collect()] == [1]
    detector.process(batch((5, 40, hit), (6, 32, good)), 3)  # a success between that came too late for its batch
    detector.process(batch((7, 60, hit), (8, 11, hit)), 4)
    assert [r.seq for r in read_triggers(spark, str(tmp_path)).collect()] == [1]
    assert detector.expected(spark).count() == 0
    assert sorted(r.seq for r in read_late(spark, str(tmp_path)).collect()) == [1, 8]


def test_live_in_flight(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)

    def ev(kind, rid, s):
        return (kind, rid, "p", t0 + dt.timedelta(seconds=s))

    rows = [ev("request", "a", 0), ev("response", "a", 5), ev("request", "b", 1), ev("request", "c", 2), ev("error", "c", 3),
            ev("request", "c", 2), ev("error", "c", 3), ev("request", "z", 4000), ev("response", "z", 4001),
            ev("request", "zz", 9000), ev("response", "zz", 9001)]
    schema = "type string, request_id string, provider string, timestamp timestamp"
    for n, part in enumerate((rows[:7], rows[7:9], rows[9:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = live.stream_parquet(spark, str(tmp_path / "in"), files_per_trigger=1)
    found = live.live_in_flight(source, "1 minute", "1 minute")
    query = (
        found.writeStream.format("memory").queryName("open_calls").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    query.awaitTermination()
    assert [r.request_id for r in spark.table("open_calls").collect()] == ["b"]


def test_live_assembly(spark, tmp_path):
    full = stream([delta(content=f"é{n} ") for n in range(40)])
    streams = {"done": full, "broken": full[: len(full) // 2]}
    chunks = recorded(spark, streams, sizes=(5, 33, 1))
    late = recorded(spark, {"clock": stream([delta(content="x")])}).withColumn("ts", F.expr("ts + interval 2 hours"))
    # out of order inside and across files
    in_files(chunks, tmp_path / "in", F.hash("seq"), 3)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late.withColumn("ts", F.expr("ts + interval 2 hours")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = live.stream_parquet(spark, str(tmp_path / "in"), files_per_trigger=1)
    pieces = live_chunks.assemble(source, delay="10 minutes", timeout_s=600, piece_bytes=256)
    query = (
        pieces.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = spark.read.schema(live_chunks.PIECES).parquet(str(tmp_path / "out"))
    ends = {r.request_id: r.complete for r in out.filter("last").collect()}
    assert ends["done"] is True and ends["broken"] is False
    assert out.filter("request_id = 'done'").count() > 3  # handed on in pieces
    merged = B.merge_openai(B.sse_events(live_chunks.as_chunks(out)))
    batch = B.merge_openai(B.sse_events(chunks))

    def text(df):
        return {r.request_id: r.choices[0].message.content for r in df.filter("request_id != 'clock'").collect()}

    assert text(merged) == text(batch)


def test_refresh_after_late_rows(spark, tmp_path):
    stats = R.rollup
    raw = spark.createDataFrame(
        [(dt.datetime(2024, 1, d, 3), "openai", "p", 1.0, True, None, 1, 2, 0) for d in (1, 2, 2)],
        "timestamp timestamp, provider_type string, provider_name string, latency_ms double, is_streaming boolean, "
        "time_to_first_token_ms double, input_tokens long, output_tokens long, cached_tokens long",
    ).withColumn("date", F.to_date("timestamp"))
    out = str(tmp_path / "rollup")
    live.refresh_rollup(raw, out, [dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    grown = raw.unionByName(raw.filter("date = '2024-01-02'").withColumn("timestamp", F.expr("timestamp + interval 1 hour")))
    live.refresh_rollup(grown, out, [dt.date(2024, 1, 2)])
    got = spark.read.parquet(out).drop("date")
    assert sorted(map(tuple, got.select(stats(grown).columns).collect())) == sorted(map(tuple, stats(grown).collect()))


def _log(spark, rows):
    """(type, request, provider, second, stream, status) in log order, as a stream can read them."""
    names = ["type", "request_id", "provider", "at", "stream", "status_code"]
    full = [dict(zip(names, row, strict=True)) for row in rows]
    full = [r | {"usage": (1, 1, 2, 0)} if r["type"] == "response" else r for r in full]
    return log(spark, full).drop("full_request", "full_response", "details")


def test_live_outcomes_are_the_batch_outcomes(spark, tmp_path):
    """The stream flag comes from another file; requests come twice or late, and one end has no request."""
    ask, end = "request", "response"
    files = [
        [(end, "lost", "p", 31, None, None), (ask, "a", "p", 0, False, None), (ask, "a", "p", 0, False, None), (ask, "b", "p", 1, True, None)],
        [(end, "a", "p", 20, None, None), (end, "c", "p", 25, None, None), ("error", "d", "q", 26, None, 429)],
        [(ask, "c", "p", 24, True, None), (end, "b", "p", 30, None, None), (ask, "d", "q", 25, None, None)],
        [(ask, "z", "p", 5000, False, None), (end, "z", "p", 5001, None, None)],
        [(ask, "y", "p", 9000, False, None), (end, "y", "p", 9001, None, None)],
    ]
    rows = _log(spark, [row for part in files for row in part])
    at = 0
    for part in files:
        rows.filter(f"seq >= {at} and seq < {at + len(part)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        at += len(part)
    source = live.stream_parquet(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = (
        live_outcomes(source, "1 minute", "1 minute").writeStream.format("memory").queryName("live_outcomes")
        .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("live_outcomes").collect()))
    assert got == sorted(map(tuple, C.outcomes(rows).collect())) and len(got) == 7


def test_live_cooldown_from_raw_events(spark, tmp_path):
    """Both queries of live cooldowns at a size where events of a quarter overtake each other."""
    from gatelens.plans.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    rows = _outcomes(spark, sf_dir)
    batch = sorted(
        (r.provider_type, r.provider, r.seq) for r in C.triggers(rows, demo.THRESHOLD, demo.WINDOW_S, slice_s=3600).collect()
    )
    for name in ("streaming_cooldown", "streaming_cooldown_unordered"):
        got = QUERIES[name](spark, sf_dir).collect()
        assert sorted((r.provider_type, r.provider, r.seq) for r in got) == batch and batch
        assert not any(getattr(r, "late", False) for r in got)


def _stats_rows(spark, times):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(t0 + dt.timedelta(hours=h), "openai", f"p{h % 2}", float(h), True, None, 1, 2, 0) for h in times],
        "timestamp timestamp, provider_type string, provider_name string, latency_ms double, is_streaming boolean, "
        "time_to_first_token_ms double, input_tokens long, output_tokens long, cached_tokens long",
    )


def test_late_rows_make_their_dates_dirty(spark, tmp_path):
    table = LiveRollup(str(tmp_path), "hour", delay_s=3600)
    parts = [[0, 1, 2, 30], [30, 31, 60], [3, 29, 30, 61], [62, 4, 61]]
    for n, part in enumerate(parts):
        for _ in range(2):  # every batch once more, as after a failure
            table.process(_stats_rows(spark, part), n)
        if n == 2:
            assert table.refresh(spark) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)] and table.dirty(spark) == []
            assert table.refresh(spark) == []
    assert [str(d) for d in table.dirty(spark)] == ["2024-01-01"]
    assert table.late(spark).count() == 4

    def same():
        whole = R.rollup(_stats_rows(spark, [h for part in parts for h in part]), "hour")
        return sorted(map(str, table.windows(spark).select(whole.columns).collect())) == sorted(map(str, whole.collect()))

    assert not same()
    assert table.refresh(spark) == [dt.date(2024, 1, 1)] and same()
    table.process(_stats_rows(spark, [63, 63]), len(parts))
    parts.append([63, 63])
    assert same()


def test_live_stats_are_those_of_the_recording(spark, tmp_path):
    """Cut anywhere, out of order and twice; without an end, with a gap, with odd lines; one chunk after the closing."""
    use = {"prompt_tokens": 10, "completion_tokens": 5, "prompt_tokens_details": {"cached_tokens": 2}}
    last = b"data: " + b'{"usage": {"prompt_tokens": 3, "completion_tokens": null}}'
    plain = {
        "whole": stream([delta(content="xü"), {"usage": use}]),
        "no end": stream([{"usage": use}, delta(content="usage")], b""),
        "no line end": stream([{"usage": use}], last),
        "escaped": stream([], b'data: {"us\\u0061ge": {"prompt_tokens": "7"}}\r\ndata: {"usage": {"prompt_tokens": 9}} x\n\n'),
        "null": stream([{"usage": use}, {"usage": None}, b"data: {\xff usage\n\n", b"event: usage\n\n"]),
        "nothing": b"\n",
    }
    blocks = {
        "a": stream([start(input_tokens=10, cache_creation_input_tokens=3, cache_read_input_tokens=5, output_tokens=1), ending(output_tokens=8)], b""),
        "b": stream([start(input_tokens=4), ending(input_tokens=6, output_tokens=None)], b""),
    }
    chunks = recorded(spark, plain, sizes=(9, 2)).union(recorded(spark, blocks, sizes=(11, 3), provider_type="anthropic"))
    chunks = chunks.filter("request_id <> 'whole' OR seq <> 4")
    chunks = chunks.union(chunks.filter("seq % 7 = 0"))
    t0 = chunks.agg(F.min("ts")).first()[0]
    begun = spark.createDataFrame(
        [(name, "p", t0 - dt.timedelta(milliseconds=40)) for name in [*plain, *blocks]], "request_id string, provider_name string, start_ts timestamp"
    )
    wanted = sorted(map(tuple, B.stats_from_chunks(chunks, begun).collect()))
    assert len(wanted) == 8

    def shifted(request_id, minutes):
        one = chunks.filter("request_id = 'whole' AND seq = 1").limit(1)
        return one.select(F.lit(request_id).alias("request_id"), "provider_type", "seq", (F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("ts"), "data")

    for part in (chunks.filter("seq % 3 = 1"), chunks.filter("seq % 3 <> 1"), shifted("", 30), shifted("whole", 31), shifted("", 60)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    closed = closed_responses(live.stream_parquet(spark, str(tmp_path / "in"), files_per_trigger=1), delay="5 minutes")
    closed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "checkpoint")
    ).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(CLOSED).parquet(str(tmp_path / "out")).filter("request_id <> ''")
    assert sorted(map(tuple, B.stats_of_closed(out, begun).collect())) == wanted
    assert [tuple(r) for r in out.filter("late").select("request_id", "prompt_tokens").collect()] == [("whole", None)]


class _Store:
    """A map state that counts the calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        keys = {"containsKey": self.rows.__contains__, "getValue": self.rows.get, "removeKey": self.rows.pop}
        return {**keys, "updateValue": self.rows.__setitem__, "clear": self.rows.clear, "keys": lambda: list(self.rows)}[name]


def test_waiting_chunks_ask_the_store_only_beyond_the_list():
    from gatelens.streaming.waiting import LISTED_BYTES, Waiting

    store, held = _Store(), (None, 0)
    for seq in [5, 3, 4, 3]:
        waiting = Waiting(*held, store)
        waiting.add(seq, seq, b"%d" % seq)
        held = waiting.fields()
    assert Waiting(*held, store).take(4) == (4, b"4") and store.calls == 0
    big = bytes(LISTED_BYTES // 3)
    waiting = Waiting(*held, store)
    for seq in [9, 7, 8, 6, 7, 8, 9]:
        waiting.add(seq, seq, big)
    assert len(store.rows) == 2 and waiting.in_map == 2 and waiting.size <= LISTED_BYTES
    assert waiting.take(6) == (6, big) and waiting.take(6) is None
    waiting = Waiting(*waiting.fields(), store)
    assert [us for us, _ in waiting.drain()] == [3, 4, 5, 7, 8, 9]
    assert waiting.fields() == ([], 0) and not store.rows and list(waiting.drain()) == []


def test_chunks_beyond_the_list_wait_in_the_map(spark, tmp_path):
    """The first chunk of a response of 200 KB comes last; a gap in another one stays open."""
    texts = {"late": stream([delta(content="x" * 200_000)]), "gap": stream([delta(content="y" * 200_000)])}
    chunks = recorded(spark, texts, sizes=(9_000,)).filter("request_id <> 'gap' OR seq <> 3")
    for part in (chunks.filter("seq > 0"), chunks.filter("seq = 0")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    newest = chunks.agg(F.max("ts")).first()[0]
    end = spark.createDataFrame([("z", "openai", 0, newest + dt.timedelta(hours=1), bytearray(b""))], chunks.schema)
    end.write.mode("append").parquet(str(tmp_path / "in"))
    pieces = live_chunks.assemble(live.stream_parquet(spark, str(tmp_path / "in"), files_per_trigger=1), "10 minutes", 600)
    pieces.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "checkpoint")
    ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(live_chunks.PIECES).parquet(str(tmp_path / "out")).orderBy("seq").collect()
    for name, complete in (("late", True), ("gap", False)):
        wanted = b"".join(bytes(r.data) for r in chunks.filter(F.col("request_id") == name).orderBy("seq").collect())
        own = [r for r in rows if r.request_id == name]
        assert b"".join(bytes(r.data) for r in own) == wanted
        assert [r.complete for r in own if r.last] == [complete]


def test_state_store_looks_nothing_up_twice(spark):
    """Live queries set their store themselves: no look-up before a write, changes alone at a commit, one store a join."""
    from gatelens import session

    for key in session.STATE:
        spark.conf.unset(key)
    live_outcomes(spark.readStream.schema(log(spark, []).schema).parquet("/root/testdata/none*"))
    assert {key: spark.conf.get(key) for key in session.STATE} == session.STATE


def test_arrivals_have_as_many_files_in_every_part(spark, tmp_path, monkeypatch):
    from gatelens.plans import queries

    rows = spark.range(2_000).select((F.timestamp_micros(F.col("id") * 10_000_000)).alias("ts"), F.col("id").alias("seq"))
    monkeypatch.setattr(queries, "FILE_ROWS", 100)
    files = queries._arrivals(rows, str(tmp_path / "in"))
    assert files == 5 and len(list((tmp_path / "in").glob("part-*"))) == 4 * files
    batches = []
    live.stream_parquet(spark, str(tmp_path / "in"), files_per_trigger=files).writeStream.foreachBatch(
        lambda batch, _: batches.append(batch.agg(F.min("seq"), F.max("seq"), F.count("*")).first())
    ).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    assert len(batches) == 4 and sum(b[2] for b in batches) == 2_000
    # parts follow each other, but for half an hour
    assert all(b[0] >= a[1] - 2 * 180 for a, b in zip(batches, batches[1:]))
