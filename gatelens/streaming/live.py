"""Live forms of the reports: tumbling windows, counters, in-flight calls, refresh after late data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.operators.facts import FINAL_FAILURE, KEY
from gatelens.operators.reports import (
    UNIT_US,
    bucket_us,
    check_hours,
    check_interval,
    fill_gaps,
    of_type,
    rollup,
    since,
    to_us,
    token_sums,
)
from gatelens.operators.stats import event_counters
from gatelens.session import is_directory

_EPOCH = dt.datetime(1970, 1, 1)


def stream_parquet(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream a Parquet table: a folder of closed files, or one file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if is_directory(spark, path):
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def live_requests(stats: DataFrame, interval: str = "minute", delay: str = "10 minutes") -> DataFrame:
    """Requests and tokens per tumbling window and provider. Rows later than ``delay`` are not counted any more."""
    check_interval(interval)
    return (
        stats.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", f"1 {interval}").alias("w"), "provider_type", "provider_name")
        .agg(F.count(F.lit(1)).alias("count"), *token_sums())
        .select(F.col("w.start").alias("bucket"), "provider_type", "provider_name", "count", "input_tokens",
                "output_tokens", "cached_tokens", "total_tokens")
    )


def live_series(
    windows: DataFrame, as_of: dt.datetime, interval: str, hours: int, provider_type: str | None = None
) -> DataFrame:
    """Gap-filled series at read time from the latest windows. Whole windows only, so the first bucket is not cut."""
    check_interval(interval)
    check_hours(hours)
    rows = windows.withColumnRenamed("bucket", "timestamp")
    lower = to_us(as_of) - hours * UNIT_US["hour"]
    first = _EPOCH + dt.timedelta(microseconds=lower - lower % UNIT_US[interval])
    rows = of_type(since(rows, first), provider_type)
    names = ["count", "input_tokens", "output_tokens", "cached_tokens", "total_tokens"]
    totals = rows.groupBy(bucket_us(interval).alias("us")).agg(*[F.sum(n).alias(n) for n in names])
    return fill_gaps(rows, totals, as_of, interval, hours)


def live_counters(events: DataFrame) -> DataFrame:
    """Running counters per provider; the same aggregation as in batch, kept by the state store."""
    return event_counters(events)


def live_in_flight(events: DataFrame, timeout: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Attempts without a terminal event within ``timeout`` of their start.

    Copies of an event are removed first, so that the join is one to one.
    """

    def side(rows: DataFrame, ts: str, keys: list[str]) -> DataFrame:
        named = rows.select(F.col("timestamp").alias(ts), *[F.col(k).alias(a) for k, a in zip(KEY, keys, strict=True)])
        return named.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)

    requests = side(events.filter(F.col("type") == "request"), "start_ts", KEY)
    ends = side(
        events.filter(F.col("type").isin("response", "error") & (F.col("provider") != FINAL_FAILURE)),
        "end_ts",
        ["end_request_id", "end_provider"],
    )
    within = F.col("end_ts").between(F.col("start_ts"), F.col("start_ts") + F.expr(f"INTERVAL {timeout}"))
    matched = (F.col("request_id") == F.col("end_request_id")) & (F.col("provider") == F.col("end_provider")) & within
    joined = requests.join(ends, matched, "left_outer")
    return joined.filter(F.col("end_ts").isNull()).select(*KEY, "start_ts")


def refresh_rollup(raw: DataFrame, out: str, dates: list[dt.date] | None = None, interval: str = "minute") -> None:
    """Recompute the rollup of the given dates (all by default) after rows arrived; other dates are not touched.

    ``raw`` has a ``date`` partition column, so only these partitions are read.
    """
    rows = raw if dates is None else raw.filter(F.col("date").isin(dates))
    rolled = rollup(rows, interval).withColumn("date", F.to_date("bucket"))
    (
        rolled.hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(out)
    )
