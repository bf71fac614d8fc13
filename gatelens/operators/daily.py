"""Cooldown triggers day by day, from stored maps.

What a day does to a provider is small: how many of its next rate limits are still blocked behind the day, for each number
that may be blocked before it (0 to ``threshold - 1``). These maps are computed for every day on its own, in any order or
all at once, from the day's outcomes and those of the last ``window_s`` seconds before it. Composed they give every day's
entry state, and with it the day picks its triggers alone. So a new day reads one day of the log; a day that is
computed again touches later days only where its map changed theirs.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.operators import cooldown as C
from gatelens.operators.running import int_div
from gatelens.session import path_exists

DAY_S = 86_400
KEY = ["provider_type", "provider"]
_EPOCH = dt.date(1970, 1, 1)


def day_marks(outcomes: DataFrame, window_s: int, day_s: int = DAY_S) -> DataFrame:
    """Marks of each day, with those of the window before it once more as ``lead``: keys, ``day, us, seq, limited, lead``."""
    if window_s > day_s:
        raise ValueError("the window must not be longer than a day")
    span, window_us = day_s * 1_000_000, window_s * 1_000_000
    marks = C._marks(outcomes).withColumn("day", int_div(F.col("us"), span))
    own = marks.withColumn("lead", F.lit(False))
    before = marks.filter(F.col("us") >= (F.col("day") + 1) * span - window_us)
    return own.unionByName(before.withColumns({"day": F.col("day") + 1, "lead": F.lit(True)}))


@dataclass(frozen=True)
class DailyRule:
    threshold: int = C.THRESHOLD
    window_s: int = C.WINDOW_S
    slice_s: int = C.SLICE_S
    chunk: int = C.CHUNK
    group: int = C.GROUP
    day_s: int = DAY_S

    def _hot(self, marks: DataFrame, keys: list[str]) -> DataFrame:
        C.check_rule(self.threshold, self.chunk)
        return C._hot_chunks(marks, keys, self.threshold, self.window_s * 1_000_000, self.slice_s, self.chunk)

    def maps(self, marks: DataFrame) -> DataFrame:
        """Keys, ``day, limits, exit``: the rate limits of a day, and its map as an array over the entry states."""
        keys, k, chunk = [*C.keys_of(marks), "day"], self.threshold, self.chunk
        counts = marks.filter("limited = 1 and not lead").groupBy(*keys).agg(F.count(F.lit(1)).alias("limits"))
        # the day's last chunk ends with the day
        end = f"least((chunk + 1) * {chunk}L, limits)"
        cells = self._hot(marks, keys).join(counts, keys).select(
            *keys, F.col("chunk").alias("idx"), C._exits(k, chunk, end).alias("exit")
        )
        groups = cells.groupBy(*keys, int_div(F.col("idx"), self.group).alias("grp")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "exit"))).alias("cells")
        )
        walked = f"transform(sequence(0L, {k - 1}L), e -> {C._walk('cells', f'grp * {self.group}L', 'e', False)})"
        groups = groups.withColumn("ends", F.expr(walked)).select(
            *keys,
            F.struct(
                F.col("grp").alias("idx"),
                F.expr(f"transform(ends, w -> if(w.nxt = (grp + 1) * {self.group}L, w.state, 0L))").alias("exit"),
                "ends",
            ).alias("cell"),
        )
        whole = groups.groupBy(*keys).agg(F.array_sort(F.collect_list("cell")).alias("cells"))
        before = "slice(cells, 1, size(cells) - 1)"
        last = "element_at(cells, -1)"
        entry = f"transform(array({C._walk(before, '0L', 'e', False)}), w -> if(w.nxt = {last}.idx, w.state, 0L))[0]"
        # behind the last chunk with a hot limit: ranks from the start of the chunk that follows, or from the day's end
        left = f"""transform(array(element_at({last}.ends, cast({entry} + 1 as int))),
                     w -> if(w.nxt = (limits - 1) div {chunk}L + 1, w.state,
                             greatest(0L, w.nxt * {chunk}L + w.state - limits)))[0]"""
        quiet = f"transform(sequence(0L, {k - 1}L), e -> greatest(0L, e - limits))"
        exits = F.expr(f"if(cells is null, {quiet}, transform(sequence(0L, {k - 1}L), e -> {left}))")
        return counts.join(whole, keys, "left").select(*keys, "limits", exits.alias("exit"))

    def triggers(self, marks: DataFrame, entries: DataFrame) -> DataFrame:
        """Keys, ``day, us, seq`` of the days in ``marks``, given their entry states (keys, ``day, entry``)."""
        keys = [*C.keys_of(marks), "day"]
        start = entries.withColumnRenamed("entry", "start")
        return C._picked(self._hot(marks, keys), keys, self.threshold, self.chunk, self.group, start).drop("rank")


def entry_states(maps: DataFrame) -> DataFrame:
    """Keys, ``day, entry``: the maps of all days before, one after the other. A row per provider and day."""
    keys = C.keys_of(maps)
    days = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "exit"))).alias("cells"))
    seen = """aggregate(cells,
        named_struct('state', 0L, 'seen', cast(array() as array<struct<day: bigint, entry: bigint>>)),
        (a, c) -> named_struct('state', element_at(c.exit, cast(a.state + 1 as int)),
                               'seen', array_append(a.seen, named_struct('day', c.day, 'entry', a.state)))).seen"""
    return days.select(*keys, F.expr(f"inline({seen})"))


@dataclass(frozen=True)
class DailyCooldown:
    """Triggers below ``path`` by day, with the maps and the entry states they were picked with."""

    path: str
    rule: DailyRule = DailyRule()

    def _write(self, rows: DataFrame, name: str) -> None:
        (
            rows.hint("rebalance", "day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(f"{self.path}/{name}")
        )

    def _read(self, spark: SparkSession, name: str, columns: str) -> DataFrame:
        schema = f"provider_type string, provider string, {columns}, day bigint"
        if not path_exists(spark, f"{self.path}/{name}"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def maps(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "maps", "limits bigint, exit array<bigint>")

    def triggers(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "triggers", "us bigint, seq bigint")

    def marks_of(self, outcomes: DataFrame, days: list[dt.date]) -> DataFrame:
        """Marks of some days from outcomes with a ``date`` partition: these dates and the ends of those before are read."""
        window = dt.timedelta(seconds=self.rule.window_s)
        starts = {d: dt.datetime.combine(d, dt.time()) for d in days}
        wanted = F.lit(False)
        for d, start in starts.items():
            before = (F.col("date") == d - dt.timedelta(days=1)) & (C.as_us(F.col("ts")) >= C.as_us(F.lit(start - window)))
            wanted |= (F.col("date") == d) | before
        marks = day_marks(outcomes.filter(F.col("date").isin([*days, *[d - dt.timedelta(days=1) for d in days]]) & wanted), self.rule.window_s)
        return marks.filter(F.col("day").isin([(d - _EPOCH).days for d in days]))

    def run(self, outcomes: DataFrame, days: list[dt.date]) -> list[dt.date]:
        """Compute some days (one, or many at once for a backfill); gives back later days whose triggers no longer hold.

        A run replaces what its days had, so that a run that died is simply repeated.
        """
        spark = outcomes.sparkSession
        marks = self.marks_of(outcomes, days)
        self._write(self.rule.maps(marks), "maps")
        self.pick(outcomes, days)
        states = entry_states(self.maps(spark))
        used = self._read(spark, "entries", "entry bigint").withColumnRenamed("entry", "used")
        stale = states.join(used, [*KEY, "day"]).filter("entry <> used").select("day").distinct()
        return sorted(_EPOCH + dt.timedelta(days=r.day) for r in stale.collect())  # a row per day at most

    def pick(self, outcomes: DataFrame, days: list[dt.date]) -> None:
        """The triggers of some days from the maps as they stand."""
        numbers = [(d - _EPOCH).days for d in days]
        entries = entry_states(self.maps(outcomes.sparkSession)).filter(F.col("day").isin(numbers))
        self._write(entries, "entries")
        self._write(self.rule.triggers(self.marks_of(outcomes, days), entries), "triggers")
