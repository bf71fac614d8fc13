"""Writers of tables, archives and text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens import schemas

WARNING_TYPES = ["retry", "fallback", "error"]  # fixed values: event types logged at WARNING or above


def write_request_stats(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append request stats: Parquet partitioned by date, or CSV in the gateway's own text shapes."""
    if fmt == "csv":
        stamp = F.when(
            F.unix_micros("timestamp") % 1_000_000 == 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ).otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        text = df.select(*schemas.REQUEST_STATS.fieldNames()).withColumns(
            {"timestamp": stamp, "is_streaming": F.initcap(F.col("is_streaming").cast("string"))}
        )
        text.write.mode("append").option("header", True).csv(path)
        return
    # REBALANCE gathers a date's rows into few files and splits a hot date, by runtime sizes
    dated = df.select(*schemas.REQUEST_STATS.fieldNames(), F.to_date("timestamp").alias("date"))
    dated.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)


def write_router_events(events: DataFrame, path: str) -> None:
    """Append the event log as Parquet by date and type: text logs are parsed once, and reports read only their types."""
    dated = events.withColumn("date", F.to_date("timestamp"))
    dated.hint("rebalance", "date", "type").write.mode("append").partitionBy("date", "type").parquet(path)


def error_events(events: DataFrame) -> DataFrame:
    """The part of the log at WARNING and above."""
    return events.filter(F.col("type").isin(WARNING_TYPES))


def archive_report(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Bytes before and after and the reduction in percent (0 if there was nothing). File contents are not read."""

    def files(path: str, side: str) -> DataFrame:
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.{parquet,jsonl,zst}")
            .load(path)
        )
        return found.select(F.lit(side).alias("side"), "length")

    def bytes_of(side: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("length"))), F.lit(0))

    both = files(before, "before").unionByName(files(after, "after"))
    sums = both.agg(bytes_of("before").alias("bytes_before"), bytes_of("after").alias("bytes_after"))
    ratio = F.try_divide(F.col("bytes_after").cast("double"), F.col("bytes_before"))
    return sums.withColumn("reduction_pct", F.coalesce((1 - ratio) * 100, F.lit(0.0)))


def to_json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON record per report row; NULLs are kept as null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))
