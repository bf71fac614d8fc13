"""Rate-limit bursts and the cooldowns they cause.

Rule: ``threshold`` rate limits of one provider within ``window_s`` seconds, with no success in between, start a
cooldown; the count then starts again from zero.

How it is computed without walking a provider's log in one task:

1. Number the rate limits of a provider 1, 2, ... and count the successes before each (:func:`running`, time slices).
2. The k-th limit of a possible burst is *hot* if the limit k-1 places before it is at most ``window_s`` older and has
   the same success count. That needs only neighbours in rank: rows are cut into chunks of equal rank length, each
   with k-1 rows of overlap, so all chunks have the same size however the provider's traffic is spread.
3. Triggers are the hot limits taken from the left, each at least k ranks after the one before. What a chunk does to
   the ranks that are still blocked is a map over k possible entry states; the maps are small and compose, first
   inside groups of chunks, then per provider. With its entry state known each chunk picks its triggers alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions import derive
from gatelens.operators.facts import attempts_finished, count_tokens_event, terminals
from gatelens.operators.reports import ts_literal, utc_naive
from gatelens.operators.running import int_div, running, time_slice

# Defaults of the rule.
THRESHOLD = 3
WINDOW_S = 60
COOLDOWN_S = 600

SLICE_S = 10  # length of the time slices; bounds the rows one task sorts
CHUNK = 1024  # ranks per chunk
GROUP = 4096  # chunks per group

RATE_LIMITED, SUCCESS, OTHER = "rate_limited", "success", "other"


def keys_of(df: DataFrame) -> list[str]:
    """A provider is known by its name, and by its type too where the table has one (every type has its own router)."""
    return [c for c in ("provider_type", "provider") if c in df.columns]


def as_us(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


SEQ_RANGE = str(10**19)  # above any sequence number


def order_key_us(us: Column, seq: Column) -> Column:
    """(microseconds, seq) as one exact number that sorts the same way."""
    shifted = us.cast("decimal(18,0)") * F.lit(SEQ_RANGE).cast("decimal(20,0)")
    return (shifted + seq.cast("decimal(19,0)")).cast("decimal(38,0)")


def outcomes(
    events: DataFrame, reset_on: Column | None = None, *, only_marks: bool = False, finished: DataFrame | None = None
) -> DataFrame:
    """Provider outcomes in log order: ``provider_type, provider, ts, seq, outcome``.

    By default a success counts as a reset only if it is a non-streaming chat response; ``reset_on`` replaces that
    test (columns ``stream``, ``is_count_tokens``). The stream flag comes from the request event.

    ``only_marks`` leaves out what cannot matter to the rule before the log meets its request events: errors that are
    no rate limit and, under the default test, counted tokens. ``finished`` (default ``attempts_finished``) may be a
    stored attempts table; the events are not read then.
    """
    if only_marks and finished is None:
        limited = (F.col("type") == "error") & (F.col("status_code") == 429)
        answered = F.col("type") == "response"
        if reset_on is None:
            answered &= ~count_tokens_event()
        events = events.filter((F.col("type") == "request") | limited | answered)
    reset_on_given = reset_on is not None
    if not reset_on_given:
        reset_on = ~F.coalesce("stream", F.lit(False)) & ~F.col("is_count_tokens")
    outcome = (
        F.when((F.col("outcome") == "failed") & (F.col("status_code") == 429), RATE_LIMITED)
        .when((F.col("outcome") == "success") & reset_on, SUCCESS)
        .otherwise(OTHER)
    )
    needed = None if reset_on_given else ["endpoint", "stream"]
    if finished is None:
        finished = attempts_finished(events, start_columns=needed)
    rows = finished.select(
        derive.provider_type(F.col("endpoint")).alias("provider_type"),
        "provider",
        F.col("end_ts").alias("ts"),
        F.col("end_seq").alias("seq"),
        outcome.alias("outcome"),
    )
    return marks_only(rows) if only_marks else rows


def rate_limited_events(events: DataFrame) -> DataFrame:
    """Error events of a rate limit."""
    return terminals(events).filter((F.col("type") == "error") & (F.col("status_code") == 429))


def marks_only(outcomes_: DataFrame) -> DataFrame:
    """The outcomes that matter to the rule."""
    return outcomes_.filter(F.col("outcome").isin(RATE_LIMITED, SUCCESS))


def _marks(outcomes_: DataFrame) -> DataFrame:
    return marks_only(outcomes_).select(
        *keys_of(outcomes_),
        as_us(F.col("ts")).alias("us"),
        "seq",
        (F.col("outcome") == RATE_LIMITED).cast("bigint").alias("limited"),
    )


def _hot_chunks(marks: DataFrame, keys: list[str], k: int, window_us: int, slice_s: int, chunk: int) -> DataFrame:
    """Per key and chunk the hot rate limits in rank order, at most ``chunk`` of them.

    Marks with ``lead`` come before those of their key and have no rank; they only say how far back a limit must look.
    """
    lead = F.col("lead") if "lead" in marks.columns else F.lit(False)
    ranked = (
        running(
            marks,
            keys,
            ["us", "seq"],
            time_slice("us", slice_s),
            {"n": ("sum", F.when(lead, F.lit(0).cast("bigint")).otherwise(F.col("limited"))), "resets": ("sum", 1 - F.col("limited"))},
        )
        .filter("limited = 1")
        .select(*keys, "us", "seq", (F.col("n") - 1).alias("rank"), "resets", lead.alias("lead"))
    )
    home = int_div(F.col("rank"), chunk)
    overlap = F.when(F.col("rank") % chunk > chunk - k, F.array(home, home + 1)).otherwise(F.array(home))
    by_rank = Window.partitionBy(*keys, "chunk").orderBy("us", "seq")
    neighbours = ranked.select("*", F.explode(overlap).alias("chunk")).withColumns(
        {
            "us_k": F.lag("us", k - 1).over(by_rank),
            "resets_k": F.lag("resets", k - 1).over(by_rank),
        }
    )
    hot = neighbours.filter(
        (F.col("chunk") == home)
        & ~F.col("lead")
        & (F.col("resets_k") == F.col("resets"))
        & (F.col("us") - F.col("us_k") <= window_us)
    )
    return hot.groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("rank", "us", "seq"))).alias("hot")
    )


def _walk(cells: str, first: str, entry: str, seen: bool) -> str:
    """SQL text: run through sorted cells (idx, exit) from state ``entry`` at index ``first``.

    State = how many ranks at the start of the next chunk are still blocked. A missing index means a chunk without hot
    limits, which leaves nothing blocked. Result: next index and state, and with ``seen`` the entry state of each cell.
    """
    at = "if(c.idx = a.nxt, a.state, 0L)"
    step = f"'nxt', c.idx + 1, 'state', element_at(c.exit, cast({at} + 1 as int))"
    start = f"'nxt', {first}, 'state', {entry}"
    if seen:
        step += f", 'seen', array_append(a.seen, named_struct('idx', c.idx, 'entry', {at}))"
        start += ", 'seen', cast(array() as array<struct<idx: bigint, entry: bigint>>)"
    return f"aggregate({cells}, named_struct({start}), (a, c) -> named_struct({step}))"


def _entry_states(maps: DataFrame, keys: list[str], k: int, fan: int, start: DataFrame | None = None) -> DataFrame:
    """Entry state of every chunk from the maps ``(keys), idx, exit``, in two levels of bounded arrays.

    ``start`` (keys, start) has the entry state of the first chunk where it is not 0.
    """
    groups = maps.groupBy(*keys, int_div(F.col("idx"), fan).alias("grp")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "exit"))).alias("cells")
    )
    # state leaving the group for each entry state
    leave = F.expr(
        f"""transform(sequence(0L, {k - 1}L), e -> transform(array({_walk('cells', f'grp * {fan}L', 'e', False)}),
              w -> if(w.nxt = (grp + 1) * {fan}L, w.state, 0L))[0])"""
    )
    per_provider = (
        groups.select(*keys, F.col("grp").alias("idx"), leave.alias("exit"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("idx", "exit"))).alias("cells"))
    )
    first = F.lit(0).cast("bigint")
    if start is not None:
        per_provider, first = per_provider.join(start, keys, "left"), F.coalesce("start", first)
    per_provider = per_provider.withColumn("start", first)
    group_entry = per_provider.select(*keys, F.expr(f"inline({_walk('cells', '0L', 'start', True)}.seen)")).select(
        *keys, F.col("idx").alias("grp"), F.col("entry").alias("grp_entry")
    )
    return groups.join(group_entry, [*keys, "grp"]).select(
        *keys, F.expr(f"inline({_walk('cells', f'grp * {fan}L', 'grp_entry', True)}.seen)")
    )


def triggers(
    outcomes_: DataFrame,
    threshold: int = THRESHOLD,
    window_s: int = WINDOW_S,
    *,
    slice_s: int = SLICE_S,
    chunk: int = CHUNK,
    group: int = GROUP,
) -> DataFrame:
    """Cooldown starts: provider keys and ``us, seq, rank`` (rank = number of the rate limit that started it, from 0).

    A limit exactly ``window_s`` old still counts. Equal times are ordered by ``seq``.
    """
    check_rule(threshold, chunk)
    keys = keys_of(outcomes_)
    hot = _hot_chunks(_marks(outcomes_), keys, threshold, window_s * 1_000_000, slice_s, chunk)
    return _picked(hot, keys, threshold, chunk, group)


def check_rule(threshold: int, chunk: int) -> None:
    if threshold < 1 or chunk < threshold:
        raise ValueError("threshold must be at least 1 and at most the chunk length")


def _exits(k: int, chunk: int, end: str) -> Column:
    """Ranks still blocked behind ``end`` after a chunk's picks, for each number of blocked ranks at its start."""
    return F.expr(
        f"""transform(sequence(0L, {k - 1}L), e -> greatest(0L,
              aggregate(hot, chunk * {chunk}L + e, (free, h) -> if(h.rank >= free, h.rank + {k}L, free)) - {end}))"""
    )


def _picked(
    hot: DataFrame, keys: list[str], k: int, chunk: int, group: int, start: DataFrame | None = None
) -> DataFrame:
    """The hot limits taken from the left, each at least ``k`` ranks after the one before: keys, ``us, seq, rank``."""
    exits = _exits(k, chunk, f"(chunk + 1) * {chunk}L")
    entry = _entry_states(hot.select(*keys, F.col("chunk").alias("idx"), exits.alias("exit")), keys, k, group, start)
    picks = F.expr(
        f"""aggregate(hot,
              named_struct('free', chunk * {chunk}L + entry,
                           'out', cast(array() as array<struct<rank: bigint, us: bigint, seq: bigint>>)),
              (a, h) -> if(h.rank >= a.free,
                           named_struct('free', h.rank + {k}L, 'out', array_append(a.out, h)), a)).out"""
    )
    return (
        hot.join(entry.select(*keys, F.col("idx").alias("chunk"), "entry"), [*keys, "chunk"])
        .select(*keys, F.explode(picks).alias("t"))
        .select(*keys, "t.us", "t.seq", "t.rank")
    )


def episodes(
    triggers_: DataFrame, as_of: dt.datetime, cooldown_s: int = COOLDOWN_S, *, slice_s: int = SLICE_S
) -> DataFrame:
    """Cooldown episodes: start, deadline, end of effect and credited seconds.

    A trigger during a cooldown replaces it, so the replaced one earns nothing; the others earn ``cooldown_s`` once
    their deadline has passed.
    """
    as_of_us = as_us(ts_literal(as_of))
    span = cooldown_s * 1_000_000
    known = triggers_.filter(F.col("us") <= as_of_us)
    with_next = running(
        known,
        keys_of(known),
        ["us", "seq"],
        time_slice("us", slice_s),
        {"next_us": ("min", F.col("us"))},
        reverse=True,
        inclusive=False,
    )
    deadline = F.col("us") + span
    replaced = F.col("next_us").isNotNull() & (F.col("next_us") < deadline)
    return with_next.select(
        *keys_of(known),
        F.timestamp_micros("us").alias("start_ts"),
        F.timestamp_micros(deadline).alias("deadline_ts"),
        F.timestamp_micros(F.when(replaced, F.col("next_us")).otherwise(deadline)).alias("end_ts"),
        replaced.alias("replaced"),
        F.when(~replaced & (deadline <= as_of_us), F.lit(float(cooldown_s)))
        .otherwise(F.lit(0.0))
        .alias("credited_seconds"),
        "seq",
    )


def recent_rate_limits(
    outcomes_: DataFrame, triggers_: DataFrame, as_of: dt.datetime, window_s: int = WINDOW_S
) -> DataFrame:
    """Rate limits still counted at ``as_of``: within the window and after the last success or trigger."""
    keys = keys_of(outcomes_)
    # on the time column itself, so that the scan skips everything before the window
    ts_type = outcomes_.schema["ts"].dataType
    from_ts = utc_naive(as_of) - dt.timedelta(seconds=window_s)
    window = outcomes_.filter(F.col("ts").between(ts_literal(from_ts, ts_type), ts_literal(as_of, ts_type)))
    marks = _marks(window)
    inside = F.col("us").between(as_us(ts_literal(from_ts)), as_us(ts_literal(as_of)))
    resets = marks.filter("limited = 0").select(*keys, "us", "seq").unionByName(
        triggers_.filter(inside).select(*keys, "us", "seq")
    )
    last = resets.groupBy(*keys).agg(F.max(F.struct("us", "seq")).alias("last_reset"))
    limits = marks.filter("limited = 1").join(last, keys, "left")
    counted = limits.filter(F.col("last_reset").isNull() | (F.struct("us", "seq") > F.col("last_reset")))
    return counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("recent_rate_limits"))


def cooldown_status(
    providers: DataFrame,
    episodes_: DataFrame,
    recent: DataFrame,
    as_of: dt.datetime,
) -> DataFrame:
    """State of every provider in ``providers`` at ``as_of``; idle ones are listed as not cooling."""
    keys = keys_of(episodes_)
    at = ts_literal(as_of)
    per_provider = episodes_.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cooldown_count"),
        F.sum("credited_seconds").alias("total_cooldown_time_seconds"),
        F.max("start_ts").alias("last_start"),
        F.max("deadline_ts").alias("last_deadline"),
    )
    cooling = F.coalesce(F.col("last_deadline") > at, F.lit(False))
    return (
        providers.select(*keys)
        .distinct()
        .join(per_provider, keys, "left")
        .join(recent, keys, "left")
        .select(
            *keys,
            cooling.alias("in_cooldown"),
            F.when(cooling, (as_us(F.col("last_deadline")) - as_us(at)) / 1_000_000)
            .otherwise(F.lit(0.0))
            .alias("cooldown_remaining_seconds"),
            F.when(cooling, F.col("last_deadline")).alias("cooldown_end_ts"),
            F.when(cooling, F.col("last_start")).alias("last_cooldown_start_ts"),
            F.coalesce("recent_rate_limits", F.lit(0)).alias("recent_rate_limits"),
            F.coalesce("cooldown_count", F.lit(0)).alias("cooldown_count"),
            F.coalesce("total_cooldown_time_seconds", F.lit(0.0)).alias("total_cooldown_time_seconds"),
        )
    )


def _cover(triggers_: DataFrame, span: int) -> DataFrame:
    """What the starts cover, cut into buckets of one cooldown's length: keys, ``__bucket, __from, __until``.

    A time in a bucket is cooling from the bucket's first start on, and until one cooldown after the last start of the
    bucket before. So one row per provider and bucket says everything, however many starts a storm has.
    """
    keys = keys_of(triggers_)
    per_bucket = triggers_.groupBy(*keys, int_div(F.col("us"), span).alias("__bucket")).agg(
        F.min("us").alias("first"), (F.max("us") + span).alias("end")
    )
    none = F.lit(None).cast("bigint")
    own = F.struct("__bucket", F.col("first").alias("__from"), none.alias("__until"))
    after = F.struct((F.col("__bucket") + 1).alias("__bucket"), none.alias("__from"), F.col("end").alias("__until"))
    both = per_bucket.select(*keys, F.inline(F.array(own, after)))
    return both.groupBy(*keys, "__bucket").agg(F.max("__from").alias("__from"), F.max("__until").alias("__until"))


def _covered() -> Column:
    us = F.col("__us")
    return F.coalesce(us >= F.col("__from"), F.lit(False)) | F.coalesce(us < F.col("__until"), F.lit(False))


def with_cooldown(
    rows: DataFrame, triggers_: DataFrame, cooldown_s: int = COOLDOWN_S, *, ts: str = "ts"
) -> DataFrame:
    """Add ``in_cooldown``: is the row's provider cooling at its time, ``start <= t < start + cooldown``?

    A many-to-one equi-join on provider and bucket (see ``_cover``): rows meet one row each, are not sorted by time,
    and not shuffled at all where the few buckets with starts are small at run time.
    """
    keys, span = keys_of(triggers_), cooldown_s * 1_000_000
    us = as_us(F.col(ts))
    placed = rows.withColumns({"__us": us, "__bucket": int_div(us, span)})
    return placed.join(_cover(triggers_, span), [*keys, "__bucket"], "left").select(
        *[placed[c] for c in rows.columns], _covered().alias("in_cooldown")
    )


def skipped_providers(
    requests: DataFrame, providers: DataFrame, triggers_: DataFrame, cooldown_s: int = COOLDOWN_S
) -> DataFrame:
    """Providers a request passed over because they were cooling.

    ``requests``: request_id, provider_type, ts, served_priority (NULL if no provider served it, then all count).
    ``providers``: provider_type, provider, priority. A request meets only the providers of its own type that have a
    start within a cooldown or two of its time.
    """
    keys, span = keys_of(triggers_), cooldown_s * 1_000_000
    cooling = providers.join(_cover(triggers_, span), keys)
    us = as_us(F.col("ts"))
    met = requests.withColumns({"__us": us, "__bucket": int_div(us, span)}).join(cooling, ["provider_type", "__bucket"])
    above = F.col("served_priority").isNull() | (F.col("priority") < F.col("served_priority"))
    return met.filter(above & _covered()).drop("__us", "__bucket", "__from", "__until")


def with_last_start(
    rows: DataFrame, triggers_: DataFrame, *, ts: str = "ts", slice_s: int = SLICE_S
) -> DataFrame:
    """Add ``last_start_us``: the last cooldown start of the row's provider at or before its time, NULL before the first.

    An as-of lookup without pairs: starts and rows lie on one time line, along which the largest start is carried; the
    line of a hot provider is cut into slices (:func:`running`). Rows whose provider is NULL have no start.
    """
    keys = keys_of(triggers_)
    none = F.lit(None)
    asked = rows.select(*keys, as_us(F.col(ts)).alias("__us"), F.lit(1).alias("__kind"), F.struct(*rows.columns).alias("__row"),
                        none.cast("bigint").alias("__start"))
    marks = triggers_.select(*keys, F.col("us").alias("__us"), F.lit(0).alias("__kind"),
                             none.cast(asked.schema["__row"].dataType).alias("__row"), F.col("us").alias("__start"))
    line = running(
        asked.unionByName(marks), keys, ["__us", "__kind"], time_slice("__us", slice_s), {"last_start_us": ("max", F.col("__start"))}
    )
    return line.filter("__kind = 1").select("__row.*", "last_start_us")


def with_remaining(
    rows: DataFrame, triggers_: DataFrame, cooldown_s: int = COOLDOWN_S, *, ts: str = "ts", slice_s: int = SLICE_S
) -> DataFrame:
    """Add ``remaining_s``: how long the row's provider stays in cooldown from the row's time on, NULL if it is not in one.

    A start during a cooldown replaces it, so the last start at or before the time decides.
    """
    found = with_last_start(rows, triggers_, ts=ts, slice_s=slice_s)
    left = F.col("last_start_us") + cooldown_s * 1_000_000 - as_us(F.col(ts))
    return found.withColumn("remaining_s", F.when(left > 0, left / 1_000_000)).drop("last_start_us")
