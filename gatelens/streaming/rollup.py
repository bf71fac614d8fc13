"""A live rollup that loses no late row.

Each micro-batch stores its rows by date, and sums up those in time per bucket and provider. Rows behind the watermark
(newest time of earlier batches less ``delay_s``) go to the table ``late`` and mark their date as dirty; ``refresh`` rolls
dirty dates up again from the stored rows and swaps them in. Which dates these are is part of the table's own version,
so that nobody keeps a list, and a refresh that dies is repeated by the next.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gatelens.operators.reports import check_interval, rollup
from gatelens.streaming.store import LiveStore, totals_by

_KEY = ["bucket", "provider_type", "provider_name", "date", "generation"]
#: A date's sums count in its newest generation only; each refresh of a date begins one.
_GENERATIONS = "date date, current bigint"


@dataclass(frozen=True)
class LiveRollup:
    """Streaming rollup below ``path``: tables ``windows`` and ``late``, rows by date and batch in ``rows``."""

    path: str
    interval: str = "minute"
    delay_s: int = 600

    def _store(self, spark: SparkSession) -> LiveStore:
        merge = totals_by(_KEY, lowest=["min_timestamp"], highest=["max_timestamp"])
        return LiveStore(spark, self.path, {"windows": merge})

    def start(self, stats: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """``stats``: streaming request stats."""
        check_interval(self.interval)
        self._store(stats.sparkSession).vacuum()
        return (
            stats.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(self.process)
            .start()
        )

    def process(self, batch: DataFrame, batch_id: int) -> None:
        version = self._store(batch.sparkSession).batch(batch_id)
        if version is None:
            return
        rows = self._stored(batch, batch_id)
        border = version.info.get("watermark_us")
        if border is None:
            in_time = rows
        else:
            behind = F.unix_micros(F.col("timestamp").cast("timestamp")) < border
            in_time = rows.filter(~F.coalesce(behind, F.lit(False)))
            late = version.add("late", rows.filter(behind))
            dates = {str(r.date) for r in late.select("date").distinct().collect()}  # as many as there are days
            version.info["dirty"] = sorted(set(version.info.get("dirty", [])) | dates)
        generations = self._generations(rows.sparkSession, version.info)
        summed = rollup(in_time, self.interval).withColumn("date", F.to_date("bucket"))
        placed = summed.join(generations, "date", "left").withColumn("generation", F.coalesce("current", F.lit(0).cast("bigint")))
        version.add("windows", placed.drop("current"))
        newest = rows.agg(F.max(F.unix_micros(F.col("timestamp").cast("timestamp")))).first()[0]
        if newest is not None:
            version.info["watermark_us"] = max(border or newest - self.delay_s * 1_000_000, newest - self.delay_s * 1_000_000)
        version.commit()

    def _stored(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The batch as stored rows; a repeated batch replaces itself."""
        spark = batch.sparkSession
        dated = batch.withColumns({"date": F.to_date("timestamp"), "batch": F.lit(batch_id).cast("bigint")})
        (
            dated.hint("rebalance", "date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch", "date")
            .parquet(f"{self.path}/rows")
        )
        return self._rows(spark, dated.schema).filter(F.col("batch") == batch_id)

    def _rows(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")

    def _generations(self, spark: SparkSession, info: dict) -> DataFrame:
        """Dates that were ever refreshed: a row per day at most."""
        found = [(dt.date.fromisoformat(d), g) for d, g in info.get("generations", {}).items()]
        return spark.createDataFrame(found, _GENERATIONS)

    def dirty(self, spark: SparkSession) -> list[dt.date]:
        """Dates whose windows lack late rows."""
        return [dt.date.fromisoformat(d) for d in self._store(spark).current()["info"].get("dirty", [])]

    def refresh(self, spark: SparkSession) -> list[dt.date]:
        """Roll the dirty dates up again from all stored rows of these dates, and swap them in. Gives the dates back."""
        store = self._store(spark)
        version = store.batch()
        dates = [dt.date.fromisoformat(d) for d in version.info.get("dirty", [])]
        if not dates:
            return []
        late = store.read("late")
        # rows of batches that are not in the tables yet come with their own batch
        rows = self._rows(spark, late.schema).filter(F.col("date").isin(dates) & (F.col("batch") <= version.batch_id))
        known = version.info.get("generations", {})
        version.info["generations"] = known | {str(d): known.get(str(d), 0) + 1 for d in dates}
        summed = rollup(rows, self.interval).withColumn("date", F.to_date("bucket"))
        generations = self._generations(spark, version.info)
        version.add("windows", summed.join(generations, "date").withColumnRenamed("current", "generation"))
        version.info["dirty"] = []
        version.commit()
        return dates

    def windows(self, spark: SparkSession) -> DataFrame:
        """The rollup as it stands: columns of ``reports.rollup``."""
        store = self._store(spark)
        version = store.current()
        rows = store.read("windows", version)
        if rows is None:
            raise FileNotFoundError(f"no batches below {self.path}")
        generations = self._generations(spark, version["info"])
        counted = rows.join(generations, "date", "left").filter(F.col("generation") == F.coalesce("current", F.lit(0)))
        return counted.drop("date", "generation", "current")

    def late(self, spark: SparkSession) -> DataFrame | None:
        """All rows that came behind the watermark."""
        return self._store(spark).read("late")
