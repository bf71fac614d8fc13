"""The three dashboard reports over one stored request-stats source."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.operators import reports
from gatelens.session import path_exists
from gatelens.sources import readers


@dataclass(frozen=True)
class Dashboard:
    """Reports over ``path``: request-stats CSV (a file, folder or glob), or our Parquet table.

    ``as_of`` defaults to now. Hours outside 1–720 are an error unless ``strict`` is off. A missing source gives reports
    without any row, not even empty buckets.

    ``rollup`` names the stored rollup of the source, kept by ``live.refresh_rollup``. Reports then read its partitions
    from their bound on, and raw rows only for the minute that the bound cuts. It must be refreshed after each append.
    """

    spark: SparkSession
    path: str
    fmt: str = "parquet"
    as_of: dt.datetime | None = None
    strict: bool = True
    rollup: str | None = None

    def _now(self) -> dt.datetime:
        return self.as_of or dt.datetime.now(dt.timezone.utc)

    def _rows(self) -> DataFrame:
        if self.fmt == "csv":
            return readers.read_request_stats(self.spark, self.path)
        return readers.read_request_stats_table(self.spark, self.path)

    def _rolled(self, lower: dt.datetime) -> DataFrame:
        dated = readers.read_rollup_table(self.spark, self.rollup)
        return dated.filter(F.col("date") >= F.lit(reports.utc_naive(lower).date())).drop("date")

    def _known(self, report: DataFrame) -> DataFrame:
        return report if path_exists(self.spark, self.path) else report.limit(0)

    def requests(self, interval: str = "hour", hours: int = 24, provider_type: str | None = None) -> DataFrame:
        """Requests per bucket: ``timestamp, count``."""
        if self.rollup:
            rolled = self._rolled(self._now() - dt.timedelta(hours=hours))
            return self._known(
                reports.requests_over_time_from_rollup(rolled, self._rows(), self._now(), interval, hours, provider_type)
            )
        return self._known(
            reports.requests_over_time(
                self._rows(), self._now(), interval, hours, provider_type, strict=self.strict
            )
        )

    def tokens(self, interval: str = "hour", hours: int = 24, provider_type: str | None = None) -> DataFrame:
        """Tokens per bucket: ``timestamp, input_tokens, output_tokens, cached_tokens, total_tokens``."""
        if self.rollup:
            rolled = self._rolled(self._now() - dt.timedelta(hours=hours))
            return self._known(
                reports.tokens_over_time_from_rollup(rolled, self._rows(), self._now(), interval, hours, provider_type)
            )
        return self._known(
            reports.tokens_over_time(self._rows(), self._now(), interval, hours, provider_type, strict=self.strict)
        )

    def summary(self, hours: int | None = None, from_utc: str | None = None) -> DataFrame:
        """One row per provider; ``hours`` (24 by default) or ``from_utc``, not both."""
        if self.rollup:
            rolled = self._rolled(reports.summary_bound(self._now(), hours, from_utc))
            return self._known(
                reports.provider_summary_from_rollup(rolled, self._rows(), self._now(), hours, from_utc)
            )
        return self._known(reports.provider_summary(self._rows(), self._now(), hours, from_utc))
