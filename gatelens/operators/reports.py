"""Time-series and summary reports over request stats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVALS = ("minute", "hour", "day")
MAX_HOURS = 720
DEFAULT_HOURS = 24


def utc_naive(as_of: dt.datetime) -> dt.datetime:
    return as_of.astimezone(dt.timezone.utc).replace(tzinfo=None) if as_of.tzinfo else as_of


_EPOCH = dt.datetime(1970, 1, 1)
UNIT_US = {"minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}


def to_us(as_of: dt.datetime) -> int:
    """Microseconds since the epoch."""
    return (utc_naive(as_of) - _EPOCH) // dt.timedelta(microseconds=1)


def ts_literal(as_of: dt.datetime, data_type: T.DataType = T.TimestampType()) -> Column:
    """Literal of the given timestamp type, so that a comparison with the column is pushed to the scan as it is."""
    if isinstance(data_type, T.TimestampNTZType):
        return F.lit(utc_naive(as_of).isoformat(sep=" ", timespec="microseconds")).cast(data_type)
    return F.timestamp_micros(F.lit(to_us(as_of)))


def check_interval(interval: str) -> str:
    if interval not in INTERVALS:
        raise ValueError(f"invalid interval {interval!r}, must be one of {', '.join(INTERVALS)}")
    return interval


def check_hours(hours: int, strict: bool = True) -> int:
    if strict and not 1 <= hours <= MAX_HOURS:
        raise ValueError(f"hours must be between 1 and {MAX_HOURS}, got {hours}")
    return int(hours)


def parse_utc(text: str) -> dt.datetime:
    """ISO text to naive UTC; raises ValueError for anything else."""
    return utc_naive(dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00").replace("z", "+00:00")))


def since(df: DataFrame, lower: dt.datetime) -> DataFrame:
    """Rows at or after ``lower``; on a table partitioned by date, older partitions are not listed either."""
    if "date" in df.columns:
        df = df.filter(F.col("date") >= F.lit(utc_naive(lower).date()))
    return df.filter(F.col("timestamp") >= ts_literal(lower, df.schema["timestamp"].dataType))


def of_type(df: DataFrame, provider_type: str | None) -> DataFrame:
    """Optional provider-type filter; None and '' mean all."""
    return df.filter(F.col("provider_type") == provider_type) if provider_type else df


def bucket_us(interval: str, ts: str = "timestamp") -> Column:
    """Start of the bucket in microseconds (UTC). Whole-number arithmetic: cheaper per row than ``date_trunc``, and
    the group key is a plain bigint.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return us - F.pmod(us, F.lit(UNIT_US[interval]).cast("bigint"))


def from_us(us: str, data_type: T.DataType) -> Column:
    return F.timestamp_micros(us).cast(data_type)


def spine(df: DataFrame, as_of: dt.datetime, interval: str, hours: int) -> DataFrame:
    """All buckets from the one of ``as_of - hours`` to the one of ``as_of``, both included: column ``us``.

    One partition, in order: the sort of a report needs no shuffle after a broadcast join.
    """
    unit, stop = UNIT_US[interval], to_us(as_of)
    start = stop - hours * UNIT_US["hour"]
    start, stop = start - start % unit, stop - stop % unit
    return df.sparkSession.range(start, stop + unit, unit, 1).withColumnRenamed("id", "us")


def fill_gaps(
    df: DataFrame, totals: DataFrame, as_of: dt.datetime, interval: str, hours: int
) -> DataFrame:
    """Totals per bucket (column ``us``) on the whole spine, missing ones as 0, in time order."""
    measures = [c for c in totals.columns if c != "us"]
    joined = spine(df, as_of, interval, hours).join(totals, "us", "left")
    filled = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in measures]
    return joined.orderBy("us").select(from_us("us", df.schema["timestamp"].dataType).alias("timestamp"), *filled)


def _recent(df, as_of, interval, hours, provider_type, strict) -> DataFrame:
    check_interval(interval)
    check_hours(hours, strict)
    return of_type(since(df, utc_naive(as_of) - dt.timedelta(hours=hours)), provider_type)


def requests_over_time(
    df: DataFrame,
    as_of: dt.datetime,
    interval: str = "hour",
    hours: int = DEFAULT_HOURS,
    provider_type: str | None = None,
    *,
    strict: bool = True,
) -> DataFrame:
    """Requests per bucket, empty buckets as 0, in time order. The first bucket is cut at ``as_of - hours``."""
    rows = _recent(df, as_of, interval, hours, provider_type, strict)
    totals = rows.groupBy(bucket_us(interval).alias("us")).agg(F.count(F.lit(1)).alias("count"))
    return fill_gaps(df, totals, as_of, interval, hours)


def token_sums() -> list[Column]:
    return [
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cached_tokens").alias("cached_tokens"),
        # a row with either count missing adds nothing
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
    ]


def tokens_over_time(
    df: DataFrame,
    as_of: dt.datetime,
    interval: str = "hour",
    hours: int = DEFAULT_HOURS,
    provider_type: str | None = None,
    *,
    strict: bool = True,
) -> DataFrame:
    """Token sums per bucket, empty buckets as 0, in time order."""
    rows = _recent(df, as_of, interval, hours, provider_type, strict)
    totals = rows.groupBy(bucket_us(interval).alias("us")).agg(*token_sums())
    return fill_gaps(df, totals, as_of, interval, hours)


def summary_bound(as_of: dt.datetime, hours: int | None, from_utc: str | None) -> dt.datetime:
    """Lower bound of the summary: ``from_utc``, or ``hours`` (24 by default) back; both together are an error."""
    if hours is not None and from_utc is not None:
        raise ValueError("give either hours or from_utc, not both")
    if from_utc is not None:
        return parse_utc(from_utc)
    return utc_naive(as_of) - dt.timedelta(hours=DEFAULT_HOURS if hours is None else hours)


def whole_us(ms: str | Column) -> Column:
    """Milliseconds as whole microseconds: sums are exact in any order and stay fixed-width."""
    return F.rint((F.col(ms) if isinstance(ms, str) else ms) * 1000).cast("bigint")


def us_to_ms(total: Column) -> Column:
    return total / 1000


def provider_summary(
    df: DataFrame, as_of: dt.datetime, hours: int | None = None, from_utc: str | None = None
) -> DataFrame:
    """One row per provider: requests, tokens, average latency, streaming split, first and last time."""
    rows = since(df, summary_bound(as_of, hours, from_utc))
    grouped = rows.groupBy("provider_type", "provider_name").agg(
        F.count(F.lit(1)).alias("request_count"),
        *token_sums(),
        F.sum(whole_us("latency_ms")).alias("latency_us"),
        F.count("latency_ms").alias("latency_count"),
        F.count_if(F.col("is_streaming")).alias("streaming_count"),
        F.count_if(~F.col("is_streaming")).alias("non_streaming_count"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
    )
    return _summary_rows(grouped)


def _summary_rows(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "provider_type",
        "provider_name",
        "request_count",
        "total_tokens",
        "input_tokens",
        "output_tokens",
        "cached_tokens",
        F.try_divide(us_to_ms(F.col("latency_us")), F.col("latency_count")).alias("avg_latency_ms"),
        "streaming_count",
        "non_streaming_count",
        "min_timestamp",
        "max_timestamp",
    ).orderBy(F.col("request_count").desc(), "provider_type", "provider_name")


# ---- the same reports from a pre-aggregated table -------------------------------------------------------------------

_SUMS = [
    "request_count",
    "input_tokens",
    "output_tokens",
    "cached_tokens",
    "total_tokens",
    "latency_us",
    "latency_count",
    "streaming_count",
    "non_streaming_count",
]


def rollup(df: DataFrame, interval: str = "minute") -> DataFrame:
    """Partial sums per bucket and provider. All are re-aggregable, so coarser reports come from this table."""
    data_type = df.schema["timestamp"].dataType
    sums = df.groupBy(bucket_us(check_interval(interval)).alias("us"), "provider_type", "provider_name").agg(
        F.count(F.lit(1)).alias("request_count"),
        *token_sums(),
        F.sum(whole_us("latency_ms")).alias("latency_us"),
        F.count("latency_ms").alias("latency_count"),
        F.count_if(F.col("is_streaming")).alias("streaming_count"),
        F.count_if(~F.col("is_streaming")).alias("non_streaming_count"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
    )
    return sums.select(from_us("us", data_type).alias("bucket"), *[c for c in sums.columns if c != "us"])


def _rollup_since(rolled: DataFrame, df: DataFrame, lower: dt.datetime, interval: str) -> DataFrame:
    """Whole buckets from the rollup, and the bucket cut by the bound from the raw rows."""
    lower = utc_naive(lower)
    first_whole = lower + dt.timedelta(microseconds=-to_us(lower) % UNIT_US[interval])
    data_type = df.schema["timestamp"].dataType
    edge = since(df, lower).filter(F.col("timestamp") < ts_literal(first_whole, data_type))
    whole = rolled.filter(F.col("bucket") >= ts_literal(first_whole, data_type))
    return whole.unionByName(rollup(edge, interval))


def requests_over_time_from_rollup(
    rolled: DataFrame,
    df: DataFrame,
    as_of: dt.datetime,
    interval: str = "hour",
    hours: int = DEFAULT_HOURS,
    provider_type: str | None = None,
    *,
    rollup_interval: str = "minute",
) -> DataFrame:
    check_interval(interval)
    check_hours(hours)
    lower = utc_naive(as_of) - dt.timedelta(hours=hours)
    rows = of_type(_rollup_since(rolled, df, lower, rollup_interval), provider_type)
    totals = rows.groupBy(bucket_us(interval, "bucket").alias("us")).agg(F.sum("request_count").alias("count"))
    return fill_gaps(df, totals, as_of, interval, hours)


def tokens_over_time_from_rollup(
    rolled: DataFrame,
    df: DataFrame,
    as_of: dt.datetime,
    interval: str = "hour",
    hours: int = DEFAULT_HOURS,
    provider_type: str | None = None,
    *,
    rollup_interval: str = "minute",
) -> DataFrame:
    check_interval(interval)
    check_hours(hours)
    lower = utc_naive(as_of) - dt.timedelta(hours=hours)
    rows = of_type(_rollup_since(rolled, df, lower, rollup_interval), provider_type)
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens", "total_tokens")]
    totals = rows.groupBy(bucket_us(interval, "bucket").alias("us")).agg(*sums)
    return fill_gaps(df, totals, as_of, interval, hours)


def provider_summary_from_rollup(
    rolled: DataFrame,
    df: DataFrame,
    as_of: dt.datetime,
    hours: int | None = None,
    from_utc: str | None = None,
    *,
    rollup_interval: str = "minute",
) -> DataFrame:
    rows = _rollup_since(rolled, df, summary_bound(as_of, hours, from_utc), rollup_interval)
    return _summary_rows(
        rows.groupBy("provider_type", "provider_name").agg(
            *[F.sum(c).alias(c) for c in _SUMS],
            F.min("min_timestamp").alias("min_timestamp"),
            F.max("max_timestamp").alias("max_timestamp"),
        )
    )
