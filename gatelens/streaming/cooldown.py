"""Live cooldown detection.

``live_outcomes`` joins the end events of a streaming log with their request events. ``LiveCooldown`` finds the triggers
in such outcomes: each micro-batch runs the distributed batch operator over its own events plus what is still open from
before, which is at most ``threshold - 1`` rate limits per provider, and the events held back. That is the whole state. It
is written with the triggers as one version of the tables (see ``store``), so a repeated batch gives the same result and
a lost executor loses nothing.

Events newer than the newest event time less ``lateness_s`` are held back, so that others may still come before them. What
is released is final: an arrival not newer than the newest released event of its provider is set aside in ``late``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatelens.operators import cooldown as C
from gatelens.operators.facts import KEY as ATTEMPT
from gatelens.operators.facts import count_tokens_event, terminals
from gatelens.session import use_state_store
from gatelens.streaming.store import Batch, LiveStore

KEY = ["provider_type", "provider"]
# is_limit: an open rate limit, or else the newest released event; null in rows held back, which have their outcome
_STATE = "provider_type string, provider string, us bigint, seq bigint, is_limit boolean, held string"


def live_outcomes(
    events: DataFrame, delay: str = "10 minutes", timeout: str = "10 minutes", reset_on: Column | None = None
) -> DataFrame:
    """Outcomes from a streaming event log, as ``cooldown.outcomes`` has them from a stored one.

    Whether a success resets the count depends on the stream flag of its request event, so both are joined: an end event
    goes out with its request event as soon as both are there. ``timeout`` is the longest that an attempt may take; an end
    event without a request event within it goes out alone once the watermark has passed it, hence as late as ``delay``
    and ``timeout`` together. Copies of a request event do not multiply rows. What comes later than ``delay`` is dropped by
    Spark's watermark; give as much as the log can be out of order.
    """
    use_state_store(events.sparkSession)
    asked = events.filter(F.col("type") == "request").select(
        *[F.col(k).alias(f"start_{k}") for k in ATTEMPT],
        F.col("timestamp").alias("start_ts"),
        F.col("endpoint").alias("start_endpoint"),
        "stream",
    )
    asked = asked.withWatermark("start_ts", delay).dropDuplicatesWithinWatermark([f"start_{k}" for k in ATTEMPT])
    ended = terminals(events).select(
        *ATTEMPT,
        F.col("timestamp").alias("end_ts"),
        F.col("seq").alias("end_seq"),
        "endpoint",
        F.when(F.col("type") == "response", F.lit("success")).otherwise(F.lit("failed")).alias("outcome"),
        count_tokens_event().alias("is_count_tokens"),
        "status_code",
    )
    same = (F.col("request_id") == F.col("start_request_id")) & (F.col("provider") == F.col("start_provider"))
    within = F.col("start_ts").between(F.col("end_ts") - F.expr(f"INTERVAL {timeout}"), F.col("end_ts"))
    joined = ended.withWatermark("end_ts", delay).join(asked, same & within, "left_outer")
    finished = joined.withColumns(
        {"endpoint": F.coalesce("start_endpoint", "endpoint"), "stream": F.coalesce("stream", F.lit(False))}
    )
    return C.outcomes(events, reset_on, finished=finished)


@dataclass(frozen=True)
class LiveCooldown:
    """Streaming cooldown triggers below ``path``: tables ``triggers``, ``state`` and ``late``."""

    path: str
    threshold: int = C.THRESHOLD
    window_s: int = C.WINDOW_S
    slice_s: int = C.SLICE_S
    lateness_s: int = 0

    def start(self, outcomes: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """``outcomes``: streaming provider (and provider_type), ts, seq, outcome."""
        LiveStore(outcomes.sparkSession, self.path).vacuum()
        return (
            outcomes.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(self.process)
            .start()
        )

    def process(self, batch: DataFrame, batch_id: int) -> None:
        version = LiveStore(batch.sparkSession, self.path).batch(batch_id)
        if version is None:
            return
        batch = batch.persist()  # read several times below
        try:
            self._process(batch, version)
        finally:
            batch.unpersist()

    def _process(self, batch: DataFrame, version: Batch) -> None:
        if "provider_type" not in batch.columns:
            batch = batch.withColumn("provider_type", F.lit(""))
        state = self._state(batch.sparkSession)
        # the newest event seen per provider: older arrivals cannot change a decision any more and are set aside
        seen = state.filter("not is_limit").select(*KEY, _key().alias("seen"))
        rows = batch.select(*KEY, C.as_us(F.col("ts")).alias("us"), "seq", "outcome").join(
            seen, KEY, "left"
        )
        waiting = _held(state)
        known = waiting.select(*KEY, "us", "seq", F.lit(True).alias("known")).distinct()  # copies of events held back are late too
        rows = rows.join(known, [*KEY, "us", "seq"], "left")
        is_late = F.coalesce(_key() <= F.col("seen"), F.lit(False)) | F.col("known").isNotNull()
        late = rows.filter(is_late).drop("seen", "known")
        pool = rows.filter(~is_late).drop("seen", "known").unionByName(waiting)
        newest = pool.select("us").unionByName(state.select("us")).agg(F.max("us")).first()[0]
        border = F.lit(None if newest is None else newest - self.lateness_s * 1_000_000).cast("bigint")
        fresh = pool.filter(F.col("us") <= border)
        both = fresh.unionByName(_open_limits(state))
        found = C.triggers(
            both.withColumn("ts", F.timestamp_micros("us")), self.threshold, self.window_s, slice_s=self.slice_s
        )
        version.add("late", late)
        found = version.add("triggers", found.select(*KEY, "us", "seq"))
        held = pool.filter(F.col("us") > border).select(
            *KEY, "us", "seq", F.lit(None).cast("boolean").alias("is_limit"), F.col("outcome").alias("held")
        )
        decided = self._next_state(both, state, found).withColumn("held", F.lit(None).cast("string"))
        version.add("state", decided.unionByName(held), replace=True)
        version.commit()

    def expected(self, spark: SparkSession) -> DataFrame:
        """Triggers among the events still held back, if nothing comes before them; columns as ``read_triggers``."""
        state = self._state(spark)
        rows = _held(state).unionByName(_open_limits(state)).withColumn("ts", F.timestamp_micros("us"))
        return C.triggers(rows, self.threshold, self.window_s, slice_s=self.slice_s).select(*KEY, "us", "seq")

    def _state(self, spark: SparkSession) -> DataFrame:
        found = LiveStore(spark, self.path).read("state")
        return spark.createDataFrame([], _STATE) if found is None else found

    def _next_state(self, rows: DataFrame, state: DataFrame, found: DataFrame) -> DataFrame:
        resets = rows.filter(F.col("outcome") == C.SUCCESS).select(*KEY, "us", "seq").unionByName(found)
        last_reset = resets.groupBy(*KEY).agg(F.max(_key()).alias("last_reset"))
        old = state.filter("not is_limit").select(*KEY, "us", "seq")
        newest = (
            rows.select(*KEY, "us", "seq")
            .unionByName(old)
            .groupBy(*KEY)
            .agg(F.max(_key()).alias("k"), F.max("us").alias("last_us"))
        )
        limits = (
            rows.filter(F.col("outcome") == C.RATE_LIMITED)
            .join(last_reset, KEY, "left")
            .join(newest, KEY)
            .filter(
                (F.col("last_reset").isNull() | (_key() > F.col("last_reset")))
                & (F.col("us") >= F.col("last_us") - self.window_s * 1_000_000)
            )
            .select(*KEY, "us", "seq", F.lit(True).alias("is_limit"))
        )
        marks = newest.select(
            *KEY,
            F.col("last_us").alias("us"),
            # the sequence number is the rest of the key
            (F.col("k") - C.order_key_us(F.col("last_us"), F.lit(0))).cast("bigint").alias("seq"),
            F.lit(False).alias("is_limit"),
        )
        return limits.unionByName(marks)


def _held(state: DataFrame) -> DataFrame:
    return state.filter("held is not null").select(*KEY, "us", "seq", F.col("held").alias("outcome"))


def _open_limits(state: DataFrame) -> DataFrame:
    return state.filter("is_limit").select(*KEY, "us", "seq", F.lit(C.RATE_LIMITED).alias("outcome"))


def _key() -> Column:
    return C.order_key_us(F.col("us"), F.col("seq"))


def read_triggers(spark: SparkSession, path: str) -> DataFrame:
    """All triggers found so far."""
    return LiveStore(spark, path).read("triggers").select(*KEY, "us", "seq")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """All events that came too late to count."""
    return LiveStore(spark, path).read("late")
