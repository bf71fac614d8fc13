"""Provider health: cooldown status, counters and totals as of a moment, from the event log and the request stats."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.operators import cooldown, stats
from gatelens.operators.facts import KEY, attempts_finished
from gatelens.session import materialize


@dataclass(frozen=True)
class Rule:
    """Cooldown rule."""

    threshold: int = cooldown.THRESHOLD
    window_s: int = cooldown.WINDOW_S
    cooldown_s: int = cooldown.COOLDOWN_S
    slice_s: int = cooldown.SLICE_S


def stored_attempts(events: DataFrame) -> DataFrame:
    """What health needs of the finished attempts, so that the log meets its request events once per run."""
    rate_limited = (F.col("type") == "error") & (F.col("status_code") == 429)
    needed = events.filter(F.col("type").isin("request", "response") | rate_limited)
    finished = attempts_finished(needed, start_columns=["endpoint", "stream"])
    return materialize(
        finished.select(
            *KEY, "endpoint", "end_ts", "end_seq", "outcome", "status_code", "stream", "is_count_tokens", "duration_ms",
            "output_tokens",
        ),
        "attempts",
    )


def status(
    events: DataFrame,
    providers: DataFrame,
    as_of: dt.datetime,
    rule: Rule = Rule(),
    finished: DataFrame | None = None,
) -> DataFrame:
    """Cooldown status of all ``providers`` at ``as_of``.

    The outcomes need a join over the log (unless ``finished`` is given) and are read by three steps, the triggers by
    two: both are written once.
    """
    marks = materialize(cooldown.outcomes(events, only_marks=True, finished=finished), "marks")
    triggers = materialize(
        cooldown.triggers(marks, rule.threshold, rule.window_s, slice_s=rule.slice_s), "triggers"
    )
    episodes = cooldown.episodes(triggers, as_of, rule.cooldown_s, slice_s=rule.slice_s)
    recent = cooldown.recent_rate_limits(marks, triggers, as_of, rule.window_s)
    return cooldown.cooldown_status(providers, episodes, recent, as_of)


def provider_health(
    events: DataFrame, request_stats: DataFrame, providers: DataFrame, as_of: dt.datetime, rule: Rule = Rule()
) -> tuple[DataFrame, DataFrame]:
    """Statistics per provider, with cooldown columns, and totals per provider type with the uptime.

    The statistics have one row per provider and feed the totals and every export, so they are written once.
    """
    finished = stored_attempts(events)
    cooling = status(events, providers, as_of, rule, finished)
    per_provider = materialize(
        stats.provider_stats(events, request_stats, cooling, finished=finished), "provider-stats"
    )
    return per_provider, stats.router_totals(per_provider, stats.uptime(events, as_of))
