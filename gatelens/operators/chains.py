"""A request's way through its provider attempts, and breakdowns of what went wrong."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions import derive
from gatelens.operators.cooldown import COOLDOWN_S, as_us, skipped_providers, with_remaining
from gatelens.operators.facts import KEY, starts, terminals
from gatelens.operators.reports import UNIT_US, bucket_us, check_interval, from_us, to_us, ts_literal, utc_naive
from gatelens.operators.running import running, time_slice
from gatelens.operators.stats import order_key

MIX = ["model", "user_agent", "stream"]
SKETCH_LG_K = 12  # a sketch takes 4 KB at most; its standard error is 1.04 / sqrt(2 ** 12), 1.6 %
ATTEMPT_SLICE_S = 60  # bounds the rows one task sorts when one request id is hot


def attempt_numbers(
    events: DataFrame,
    skips: DataFrame | None = None,
    *,
    slice_s: int = ATTEMPT_SLICE_S,
) -> DataFrame:
    """Number the attempts of each request in log order: a running count over time slices, the same for every request.

    The gateway also counts providers it passed over while they were cooling: ``skips`` (request_id, provider,
    priority; from ``passed_over``) are added where their priority is above the attempt's, which its request event has.
    """
    done = terminals(events).withColumn("us", as_us(F.col("timestamp")))
    if skips is not None:
        asked = starts(events, ["provider_priority"]).withColumnRenamed("provider_priority", "asked_priority")
        done = done.join(asked, KEY, "left").withColumn("provider_priority", F.coalesce("provider_priority", "asked_priority"))
        done = done.drop("asked_priority")
        # per request a short list of skipped priorities: one row per request, no pairs
        lists = skips.groupBy("request_id").agg(F.collect_set("priority").alias("skipped"))
        done = done.join(lists, "request_id", "left")
    key, order = ["request_id"], ["us", "seq"]
    one = F.lit(1).cast("bigint")
    numbered = running(done, key, order, time_slice("us", slice_s), {"attempt_no": ("sum", one)})
    if skips is not None:
        above = F.size(F.filter("skipped", lambda p: p < F.col("provider_priority")))
        numbered = numbered.withColumn("attempt_no", F.col("attempt_no") + F.coalesce(above, F.lit(0))).drop("skipped")
    return numbered.drop("us")


def request_chains(events: DataFrame) -> DataFrame:
    """One row per request: attempts, the provider that served it, tries before success, duration, all failed.

    One hash aggregation on the request: a hot request id is reduced on the map side like any other. The provider of
    the first success is looked up by the exact (time, seq) of that success.
    """
    done = terminals(events)
    ok = F.col("type") == "response"
    key = order_key()
    per_request = done.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(~ok).alias("failures"),
        F.min_by(F.when(ok, F.struct("provider")), F.when(ok, key)).alias("s"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    return per_request.select(
        "request_id",
        "attempts",
        "failures",
        F.col("s.provider").alias("serving_provider"),
        ((as_us(F.col("last_ts")) - as_us(F.col("first_ts"))) / 1000).alias("duration_ms"),
        F.col("s").isNull().alias("all_failed"),
    )


def error_breakdown(events: DataFrame, subtotals: bool = False) -> DataFrame:
    """Errors by provider, type and status; ``subtotals`` adds all partial totals (level tells which)."""
    errors = events.filter(F.col("type") == "error")
    keys = ["provider", "error_type", "status_code"]
    if not subtotals:
        return errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("errors"))
    # the cube runs over the small finest grouping, not over the log
    finest = errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return finest.cube(*keys).agg(F.sum("n").alias("errors"), F.grouping_id().alias("level"))


def retry_breakdown(events: DataFrame) -> DataFrame:
    """Retries by attempt, limit and error type with the average wait the vendor asked for."""
    return (
        events.filter(F.col("type") == "retry")
        .groupBy("attempt", "max_attempts", "error_type")
        .agg(
            F.count(F.lit(1)).alias("retries"),
            F.count("retry_after").alias("with_retry_after"),
            F.try_divide(F.sum(F.col("retry_after").cast("decimal(18,3)")).cast("double"), F.count("retry_after")).alias(
                "avg_retry_after"
            ),
        )
    )


def fallback_edges(events: DataFrame) -> DataFrame:
    """Fallbacks from provider to provider by reason."""
    return (
        events.filter(F.col("type") == "fallback")
        .groupBy("from_provider", "to_provider", "reason")
        .agg(F.count(F.lit(1)).alias("fallbacks"))
    )


def exhausted(events: DataFrame) -> DataFrame:
    """Requests that no provider served, and their share of all requests."""
    per_request = (
        events.filter(F.col("request_id").isNotNull() & F.col("type").isin("request", "error"))
        .groupBy("request_id")
        .agg(F.max(F.col("error_type").eqNullSafe("no_available_provider")).alias("failed"))
    )
    return per_request.agg(
        F.count_if("failed").alias("exhausted_requests"),
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(
            F.try_divide(F.count_if("failed").cast("double"), F.count(F.lit(1))), F.lit(0.0)
        ).alias("share"),
    )


def passed_over(
    events: DataFrame, providers: DataFrame, triggers_: DataFrame, cooldown_s: int = COOLDOWN_S
) -> DataFrame:
    """Providers that requests passed over because they were cooling: ``request_id, provider_type, ts, provider, priority,
    remaining_s``.

    ``providers``: provider_type, provider, priority. A request stands at the time of its first request event. Providers
    behind the one that served it were not looked at, and one that was tried was not passed over.
    """
    type_ = derive.provider_type(F.col("endpoint"))
    asked = events.filter((F.col("type") == "request") & F.col("request_id").isNotNull())
    answered = terminals(events).filter(F.col("type") == "response").select("request_id", type_.alias("provider_type"), "provider")
    priority = providers.groupBy("provider_type", "provider").agg(F.min("priority").alias("priority"))
    served = (
        answered.join(priority, ["provider_type", "provider"])
        .groupBy("request_id", "provider_type")
        .agg(F.min("priority").alias("served_priority"))
    )
    requests = (
        asked.groupBy("request_id", type_.alias("provider_type"))
        .agg(F.min("timestamp").alias("ts"))
        .join(served, ["request_id", "provider_type"], "left")
    )
    met = skipped_providers(requests, priority, triggers_, cooldown_s)
    tried = asked.select("request_id", "provider").distinct()
    skipped = met.join(tried, ["request_id", "provider"], "left_anti")
    return with_remaining(skipped, triggers_, cooldown_s).drop("served_priority")


def failure_summary(events: DataFrame, skips: DataFrame | None = None) -> DataFrame:
    """Text ``- provider: error`` per failed attempt, one line each, for requests that failed entirely.

    ``skips`` (from ``passed_over``) add a line for each provider that was not tried because it was cooling, with the whole
    seconds that were left. Lines follow the priority of their provider (for attempts as their request event has it),
    then time. They are first joined in short time slices or bands of priorities, then these in order.
    """
    failed = (
        events.filter((F.col("type") == "error") & F.col("error_type").eqNullSafe("no_available_provider"))
        .select("request_id")
        .distinct()
    )

    def line(text: Column) -> Column:
        return F.concat(F.lit("- "), F.col("provider"), F.lit(": "), text).alias("line")

    tries = terminals(events).filter(F.col("type") == "error").join(failed, "request_id", "left_semi")
    label = line(derive.attempt_label(F.col("error_type"), F.col("error_message")))
    when = as_us(F.col("timestamp")).alias("us")
    if skips is None:
        lines = tries.select("request_id", label, when, "seq")
        return ordered_concat(lines, ["request_id"], "line", ["us", "seq"], time_slice("us", ATTEMPT_SLICE_S), "\n", "summary")
    asked = starts(events.join(failed, "request_id", "left_semi"), ["provider_priority"])
    tried = tries.drop("provider_priority").join(asked, KEY, "left")
    lines = tried.select("request_id", label, when, "seq", F.coalesce("provider_priority", F.lit(0)).alias("priority"))
    waits = F.concat(F.lit("In cooldown for "), F.rint("remaining_s").cast("bigint").cast("string"), F.lit("s"))
    passed = skips.join(failed, "request_id", "left_semi").select(
        "request_id", line(waits), as_us(F.col("ts")).alias("us"), F.lit(-1).cast("bigint").alias("seq"), "priority"
    )
    both = lines.unionByName(passed)
    order = ["priority", "us", "seq"]
    piece = F.struct("priority", time_slice("us", ATTEMPT_SLICE_S))
    return ordered_concat(both, ["request_id"], "line", order, piece, "\n", "summary")


def ordered_concat(df, key, text, order, piece, separator: str, name: str) -> DataFrame:
    """Join texts of a key in order, in two steps: inside bounded pieces, then the pieces.

    Only the last step sees a whole key, and only as the text that is its result.
    """
    spec = ", ".join(order)
    pieces = (
        df.withColumn("__piece", piece)
        .groupBy(*key, "__piece")
        .agg(F.expr(f"listagg({text}, '{separator}') within group (order by struct({spec}))").alias("__text"))
    )
    return pieces.groupBy(*key).agg(
        F.expr(f"listagg(__text, '{separator}') within group (order by __piece)").alias(name)
    )


def request_mix(events: DataFrame, exact: bool = False) -> DataFrame:
    """Requests by model, client and stream flag, with the number of distinct request ids."""
    ids = F.count_distinct("request_id") if exact else F.approx_count_distinct("request_id")
    return (
        events.filter(F.col("type") == "request")
        .groupBy(*MIX)
        .agg(F.count(F.lit(1)).alias("attempts"), ids.alias("requests"))
    )


def request_mix_rollup(events: DataFrame, interval: str = "hour", lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Partial results of ``request_mix`` per bucket: ``bucket``, model, client, stream flag, ``attempts`` and ``ids``.

    ``ids`` is a HyperLogLog sketch of the request ids. Sketches merge without loss, so a request with attempts in several
    buckets counts once in any window over them, which sums of distinct counts would not give.
    """
    data_type = events.schema["timestamp"].dataType
    rows = events.filter(F.col("type") == "request")
    parts = rows.groupBy(bucket_us(check_interval(interval)).alias("us"), *MIX).agg(
        F.count(F.lit(1)).alias("attempts"), F.hll_sketch_agg("request_id", lg_k).alias("ids")
    )
    return parts.select(from_us("us", data_type).alias("bucket"), *MIX, "attempts", "ids")


def request_mix_from_rollup(
    rolled: DataFrame,
    events: DataFrame,
    lower: dt.datetime,
    upper: dt.datetime,
    interval: str = "hour",
    lg_k: int = SKETCH_LG_K,
) -> DataFrame:
    """``request_mix`` of the request events in ``[lower, upper)`` from a stored rollup of that interval.

    Whole buckets come from the rollup; raw rows are read only for the buckets that a bound cuts. ``attempts`` is exact,
    ``requests`` an estimate: counts up to some hundreds are exact but for hash collisions, above that the standard error
    is ``1.04 / sqrt(2 ** lg_k)``.
    """
    unit = dt.timedelta(microseconds=UNIT_US[check_interval(interval)])
    lower, upper = utc_naive(lower), utc_naive(upper)
    first = lower + dt.timedelta(microseconds=-to_us(lower) % UNIT_US[interval])
    end = upper - dt.timedelta(microseconds=to_us(upper) % UNIT_US[interval])
    kind = events.schema["timestamp"].dataType

    def raw(start: dt.datetime, stop: dt.datetime) -> DataFrame:
        rows = events
        if "date" in events.columns:
            rows = rows.filter((F.col("date") >= F.lit(start.date())) & (F.col("date") <= F.lit(stop.date())))
        at = F.col("timestamp")
        return request_mix_rollup(rows.filter((at >= ts_literal(start, kind)) & (at < ts_literal(stop, kind))), interval, lg_k)

    if first > end:  # both bounds cut the same bucket
        parts = raw(lower, upper)
    else:
        bucket = F.col("bucket")
        parts = rolled.filter((bucket >= ts_literal(first, kind)) & (bucket <= ts_literal(end - unit, kind)))
        for start, stop in ((lower, first), (end, upper)):
            if start < stop:
                parts = parts.unionByName(raw(start, stop))
    return parts.groupBy(*MIX).agg(
        F.sum("attempts").alias("attempts"), F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("requests")
    )


def offered_providers(events: DataFrame) -> DataFrame:
    """How often each provider was listed when a request chose its provider."""
    listed = events.filter(F.col("type") == "provider_selection").select(F.inline("available_providers"))
    return listed.groupBy("name", "priority").agg(F.count(F.lit(1)).alias("offered"))


def next_provider(failures: DataFrame, providers: DataFrame) -> DataFrame:
    """The provider that follows a failed attempt's provider in priority order (NULL after the last one)."""
    from gatelens.operators.providers import ranked_providers

    ranked = ranked_providers(providers)
    following = ranked.select(
        "provider_type",
        (F.col("rank") - 1).alias("rank"),
        F.col("provider").alias("to_provider"),
        F.col("priority").alias("to_priority"),
    )
    dimension = ranked.join(following, ["provider_type", "rank"], "left").select(
        "provider_type", "provider", "rank", F.col("priority").alias("from_priority"), "to_provider", "to_priority"
    )
    # a name may be configured twice; the entry tried first counts
    dimension = dimension.groupBy("provider_type", "provider").agg(
        *(F.min_by(c, "rank").alias(c) for c in ("from_priority", "to_provider", "to_priority"))
    )
    return failures.join(dimension, ["provider_type", "provider"], "left")
