"""One query per operator, over the test tables. Every query reads its tables whole."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens import schemas
from gatelens.functions import derive
from gatelens.functions import usage as U
from gatelens.operators import chains, chunks, cooldown, daily, facts, reports, stats
from gatelens.operators import providers as P
from gatelens.operators.running import running, time_slice
from gatelens.plans import demo, health, publish
from gatelens.plans.dashboard import Dashboard
from gatelens.session import materialize, scratch_path
from gatelens.sources import archive, readers, writers
from gatelens.streaming import chunks as live_chunks
from gatelens.streaming import cooldown as live_cooldown
from gatelens.streaming import live, update_log
from gatelens.streaming import rollup as live_rollup
from gatelens.streaming import stats as live_stats

AS_OF = demo.AS_OF
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Zoned timestamps as plain UTC ones, whole numbers as bigint."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# ---- reports over request stats -------------------------------------------------------------------------------------


@query
def requests_minute(spark, sf_dir):
    return reports.requests_over_time(demo.request_stats(spark, sf_dir), AS_OF, "minute", 720)


@query
def requests_hour(spark, sf_dir):
    return reports.requests_over_time(demo.request_stats(spark, sf_dir), AS_OF, "hour", 720)


@query
def requests_hour_default(spark, sf_dir):
    return reports.requests_over_time(demo.request_stats(spark, sf_dir), AS_OF)


@query
def requests_hour_openai(spark, sf_dir):
    return reports.requests_over_time(demo.request_stats(spark, sf_dir), AS_OF, "hour", 720, "openai")


@query
def requests_day(spark, sf_dir):
    return reports.requests_over_time(demo.request_stats(spark, sf_dir), AS_OF, "day", 720)


@query
def tokens_hour(spark, sf_dir):
    return reports.tokens_over_time(demo.request_stats(spark, sf_dir), AS_OF, "hour", 720)


@query
def tokens_day_anthropic(spark, sf_dir):
    return reports.tokens_over_time(demo.request_stats(spark, sf_dir), AS_OF, "day", 720, "anthropic")


@query
def provider_summary_hours(spark, sf_dir):
    return reports.provider_summary(demo.request_stats(spark, sf_dir), AS_OF, hours=720)


@query
def provider_summary_from(spark, sf_dir):
    return reports.provider_summary(demo.request_stats(spark, sf_dir), AS_OF, from_utc=demo.FROM_UTC)


@query
def requests_from_rollup(spark, sf_dir):
    rows = demo.request_stats(spark, sf_dir)
    return reports.requests_over_time_from_rollup(reports.rollup(rows), rows, AS_OF, "hour", 720)


@query
def tokens_from_rollup(spark, sf_dir):
    rows = demo.request_stats(spark, sf_dir)
    return reports.tokens_over_time_from_rollup(reports.rollup(rows, "hour"), rows, AS_OF, "day", 719, rollup_interval="hour")


@query
def summary_from_rollup(spark, sf_dir):
    rows = demo.request_stats(spark, sf_dir)
    return reports.provider_summary_from_rollup(reports.rollup(rows), rows, AS_OF, hours=720)


LATE_DATES = [dt.date(2024, 1, day) for day in (9, 10, 11)]


def _stored_board(spark, sf_dir):
    """A stored source with its rollup: some rows of three days come late, and only these days are rolled up again."""
    path, out = scratch_path(spark, "stats"), scratch_path(spark, "rollup")
    events = demo.table(spark, sf_dir, "events")
    is_late = F.to_date("ts").isin(LATE_DATES) & (F.col("event_id") % 3 == 0)
    for rows, dates in ((events.filter(~is_late), None), (events.filter(is_late), LATE_DATES)):
        stamped = demo.stats_of(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        writers.write_request_stats(stamped, path)
        live.refresh_rollup(readers.read_request_stats_table(spark, path), out, dates)
    return Dashboard(spark, path, as_of=AS_OF, rollup=out)


@query
def stored_rollup_requests(spark, sf_dir):
    return _stored_board(spark, sf_dir).requests("day", 720)


@query
def stored_rollup_tokens(spark, sf_dir):
    return _stored_board(spark, sf_dir).tokens("hour", 720)


@query
def stored_rollup_summary(spark, sf_dir):
    return _stored_board(spark, sf_dir).summary(from_utc=demo.FROM_UTC)


@query
def report_json(spark, sf_dir):
    report = reports.requests_over_time(demo.request_stats(spark, sf_dir), AS_OF, "day", 720)
    return writers.to_json_rows(report.select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "count"))


# ---- files ----------------------------------------------------------------------------------------------------------


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("provider_type", "provider_name", "is_streaming").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("input_tokens").alias("input_tokens"),
        F.count("time_to_first_token_ms").alias("with_ttft"),
        reports.us_to_ms(F.sum(reports.whole_us("latency_ms"))).alias("latency_ms"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


@query
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = demo.request_stats(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    writers.write_request_stats(rows, path, "csv")
    good, _ = readers.split_corrupt(readers.read_request_stats(spark, path, corrupt_column="_bad"), "_bad")
    return _counted(good)


@query
def parquet_round_trip(spark, sf_dir):
    path = scratch_path(spark, "stats")
    rows = demo.request_stats(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    writers.write_request_stats(rows, path)
    return _counted(reports.since(readers.read_request_stats_table(spark, path), reports.parse_utc(demo.FROM_UTC)))


@query
def event_log_round_trip(spark, sf_dir):
    path = scratch_path(spark, "log")
    log = demo.router_events(spark, sf_dir).drop("seq")
    log.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX").json(path)
    events = readers.read_router_events(spark, path, glob="*.json")
    return events.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("usage.prompt_tokens").alias("prompt_tokens"),
        F.max("timestamp").alias("last_ts"),
        F.sum(F.size("available_providers")).alias("offered"),
        F.count("details").alias("with_details"),
    )


def _renamed(spark, folder, suffix):
    """Give the part files of a folder a name that ends in ``suffix``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(folder)):
        old = status.getPath()
        if old.getName().startswith("part-") and not old.getName().endswith(".jsonl"):
            fs.rename(old, path(old.getParent(), old.getName().split(".")[0] + suffix))


@query
def missing_source(spark, sf_dir):
    """A folder that is not there adds no rows to a source that is."""
    missing = readers.read_request_stats(spark, scratch_path(spark, "missing") + "/*.csv")
    there = demo.request_stats(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return _counted(there.unionByName(missing.select(*there.columns)))


@query
def error_copies(spark, sf_dir):
    """The log beside its ``_errors`` files: copies of warnings and errors count once."""
    path = scratch_path(spark, "log")
    log = demo.router_events(spark, sf_dir).drop("seq")
    stamps = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"
    writers.error_events(log).write.option("timestampFormat", stamps).json(path)
    _renamed(spark, path, readers.ERROR_COPY_SUFFIX)
    log.write.mode("append").option("timestampFormat", stamps).json(path)
    _renamed(spark, path, ".jsonl")
    events = readers.read_router_events(spark, path)
    return events.groupBy("type", "request_id").agg(F.count(F.lit(1)).alias("n"))


@query
def log_files(spark, sf_dir):
    """Rows per log file, told by its name: start and session of the file."""
    log = demo.table(spark, sf_dir, "events").select(
        F.concat(
            F.lit("router_"), F.date_format(F.date_trunc("hour", F.col("ts")), "yyyyMMdd_HHmmss"), F.lit("_u"),
            F.col("user_id").cast("string"), F.lit(".jsonl"),
        ).alias("file_name")
    )
    named = readers.with_log_file(log)
    return named.groupBy("log_started_at", "log_session").agg(F.count(F.lit(1)).alias("n"))


@query
def read_configuration(spark, sf_dir):
    """Suppliers as configuration files, a thousand in each; what a file leaves out gets its default."""
    path = scratch_path(spark, "configuration")
    n = F.col("position")
    given = demo.providers(spark, sf_dir).withColumns(
        {
            "priority": F.when(n % 3 > 0, F.col("priority")),
            "timeout": F.when(n % 4 > 0, F.col("timeout")),
            "max_retries": F.when(n % 5 > 0, F.col("max_retries")),
            "model_mapping": F.when(n % 6 > 0, F.col("model_mapping")),
        }
    )
    fields = ["api_key", "priority", "base_url", "timeout", "max_retries", "model_mapping", "provider_name"]
    entry = F.struct(*fields)
    of_type = [F.collect_list(F.when(F.col("provider_type") == t, entry)).alias(t) for t in ("openai", "anthropic")]
    files = given.groupBy(F.call_function("div", n, F.lit(1000)).alias("file")).agg(*of_type)
    files.select("file", F.to_json(F.struct("openai", "anthropic")).alias("value")).write.partitionBy("file").text(path)
    found = readers.read_providers(spark, path)
    return found.select(
        "provider_type", "api_key", "priority", "base_url", "timeout", "max_retries", "provider_name",
        F.col("model_mapping")["m1"].alias("m1"),
    )


@query
def recorded_chunks(spark, sf_dir):
    path = scratch_path(spark, "chunks")
    demo.conversation_chunks(spark, sf_dir, "openai").write.parquet(path)
    found = readers.read_chunks(spark, path)
    return found.groupBy("request_id", "provider_type").agg(
        F.count("data").alias("chunks"), F.countDistinct("seq").alias("numbers"), F.max("ts").alias("last_ts")
    )


@query
def archive_round_trip(spark, sf_dir):
    """Two runs, the second with rows that came late for archived dates; then live and archived rows together."""
    path = scratch_path(spark, "archive")
    events = demo.router_events(spark, sf_dir)
    archive.archive_events(events.filter("seq % 5 <> 1"), path, AS_OF - dt.timedelta(days=4))
    archive.archive_events(events, path, AS_OF)
    kept = archive.read_archive(spark, path).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_ts"))
    both = archive.with_archive(events, path).groupBy("date").agg(F.count(F.lit(1)).alias("n_all"))
    return both.join(kept, "date", "left")


@query
def archive_bytes(spark, sf_dir):
    """Rows by date as the archive records them, and whether its files are smaller than plain ones of the same date."""
    path = scratch_path(spark, "archive")
    events = demo.router_events(spark, sf_dir).withColumn("date", F.to_date("timestamp"))
    events.write.option("compression", "none").partitionBy("date").parquet(path + "/plain")
    archive.archive_events(events, path + "/zstd", AS_OF.replace(year=2025))
    report = writers.archive_report(spark, path + "/plain", path + "/zstd")
    smaller = report.select(((F.col("bytes_after") < F.col("bytes_before")) & F.col("reduction_pct").between(0, 100)).alias("smaller"))
    dates = archive.archived_dates(spark, path + "/zstd").select("date", "rows", (F.col("bytes") > 0).alias("has_bytes"))
    return dates.withColumn("smaller", F.lit(smaller.first().smaller))


@query
def warning_events(spark, sf_dir):
    return writers.error_events(demo.router_events(spark, sf_dir)).select("type", "request_id", "timestamp")


# ---- scalar derivations ---------------------------------------------------------------------------------------------


@query
def usage_from_json(spark, sf_dir):
    """Vendor documents built from the rows, read back by both adapters."""
    rows = demo.table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    k, n = F.col("k"), F.col("event_id") % 97
    openai = F.struct(
        F.lit("m").alias("model"),
        F.array(F.struct(F.lit(0).alias("index"), F.col("event_type").alias("finish_reason"))).alias("choices"),
        F.struct(
            k.alias("prompt_tokens"),
            n.alias("completion_tokens"),
            F.when(k % 2 == 0, F.struct((k / 2).cast("bigint").alias("cached_tokens"))).alias("prompt_tokens_details"),
        ).alias("usage"),
    )
    anthropic = F.struct(
        F.lit("m").alias("model"),
        F.col("event_type").alias("stop_reason"),
        F.struct(
            k.alias("input_tokens"),
            n.alias("output_tokens"),
            F.when(k % 2 == 0, k).alias("cache_creation_input_tokens"),
            F.when(k % 3 == 0, k * 2).alias("cache_read_input_tokens"),
        ).alias("usage"),
    )
    counting = F.to_json(F.struct(k.alias("input_tokens")))
    documents = rows.select(
        "event_id",
        F.inline(
            F.array(
                F.struct(F.lit("openai").alias("format"), F.to_json(openai).alias("text")),
                F.struct(F.lit("anthropic").alias("format"), F.to_json(anthropic).alias("text")),
                F.struct(F.lit("openai").alias("format"), counting.alias("text")),
            )
        ),
    ).withColumn("doc", F.try_parse_json("text"))
    doc = F.col("doc")
    return documents.select(
        "event_id",
        "format",
        U.is_count_tokens(doc).alias("is_count_tokens"),
        U.finish_reason(doc).alias("finish_reason"),
        F.inline(F.array(U.usage(doc, F.col("format")))),
    )


def _profiled(spark, sf_dir):
    turns = demo.table(spark, sf_dir, "conversations")
    doc = F.struct(
        F.when(F.col("turn") % 3 > 0, F.concat(F.lit("m"), F.col("turn").cast("string"))).alias("model"),
        F.when(
            F.col("turn") % 4 > 0,
            F.array_repeat(F.struct("role", F.col("text").alias("content")), F.col("turn").cast("int")),
        ).alias("messages"),
        F.when(F.col("turn") % 2 == 0, F.col("turn") / 4).alias("temperature"),
        F.when(F.col("turn") % 2 == 1, F.col("turn") * 100).alias("max_tokens"),
        F.when(F.col("turn") % 5 == 0, True).alias("stream"),
    )
    return turns.select("conv_id", "turn", "role", F.parse_json(F.to_json(doc)).alias("doc"))


@query
def request_profiles(spark, sf_dir):
    return _profiled(spark, sf_dir).select("conv_id", "turn", F.inline(F.array(U.request_profile(F.col("doc")))))


@query
def request_profiles_sent(spark, sf_dir):
    agent = F.when(F.col("turn") % 2 == 0, F.concat(F.col("role"), F.lit("/1.0")))
    profile = U.request_profile(F.col("doc"), agent)
    return _profiled(spark, sf_dir).select("conv_id", "turn", profile.alias("p")).select(
        "conv_id", "turn", "p.message_count", "p.user_agent"
    )


@query
def rounded_latency(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "events")
    return rows.select("event_id", derive.round_ms(F.col("value") / 4).alias("ttft_ms"))


@query
def classified_errors(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "signup", 401).otherwise(350 + k)
    kind = derive.classify_error(status)
    return rows.select(
        "event_id",
        status.alias("status"),
        kind.alias("error_class"),
        derive.failure_label(kind, F.col("event_type")).alias("label"),
        derive.attempt_label(kind, F.col("event_type")).alias("attempt_label"),
        derive.client_status(kind).alias("client_status"),
    )


@query
def iso_times(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.select(
        "event_id",
        derive.iso_utc(F.col("at")).alias("iso"),
        derive.iso_utc_epoch(F.floor(F.unix_micros("at") / 1_000_000)).alias("iso_second"),
    )


# ---- facts ----------------------------------------------------------------------------------------------------------


@query
def finished_attempts(spark, sf_dir):
    done = facts.attempts_finished(demo.router_events(spark, sf_dir))
    return done.select(
        "request_id", "provider", "start_ts", "end_ts", "outcome", "stream", "is_count_tokens", "input_tokens",
        "output_tokens", "user_agent", "error_type",
    )


@query
def in_flight(spark, sf_dir):
    return facts.in_flight(demo.router_events(spark, sf_dir)).select("request_id", "provider", "start_ts", "endpoint")


@query
def attempt_outcomes(spark, sf_dir):
    rows = facts.attempts(demo.router_events(spark, sf_dir))
    return rows.groupBy("provider_type", "provider", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def request_stats_from_events(spark, sf_dir):
    return facts.build_request_stats(demo.router_events(spark, sf_dir))


@query
def usage_filled(spark, sf_dir):
    """Response events that carry only the vendor document: usage, finish reason and counted tokens are read from it."""
    log = demo.router_events(spark, sf_dir).filter("type = 'response'")
    own = F.struct(
        F.lit("m").alias("model"),
        F.array(F.struct(F.lit("stop").alias("finish_reason"))).alias("choices"),
        F.lit("end_turn").alias("stop_reason"),
        F.struct(
            F.col("usage.prompt_tokens").alias("prompt_tokens"),
            F.col("usage.completion_tokens").alias("completion_tokens"),
            F.struct(F.col("usage.cached_tokens").alias("cached_tokens")).alias("prompt_tokens_details"),
            F.col("usage.prompt_tokens").alias("input_tokens"),
            F.col("usage.completion_tokens").alias("output_tokens"),
            F.col("usage.cached_tokens").alias("cache_read_input_tokens"),
        ).alias("usage"),
    )
    counted = F.to_json(F.struct("input_tokens"))
    document = F.when(F.col("usage").isNull(), counted).otherwise(F.to_json(own))
    bare = log.withColumn("full_response", F.parse_json(document)).withColumns(
        {"usage": F.lit(None).cast(schemas.USAGE), "finish_reason": F.lit(None).cast("string")}
    )
    return facts.with_usage(bare).select(
        "request_id", "endpoint", "input_tokens", "finish_reason", "usage.prompt_tokens", "usage.completion_tokens",
        "usage.total_tokens", "usage.cached_tokens",
    )


# ---- statistics -----------------------------------------------------------------------------------------------------


def _marks(spark, sf_dir):
    return materialize(cooldown.outcomes(demo.router_events(spark, sf_dir), only_marks=True), "marks")


def _triggers(marks):
    return cooldown.triggers(marks, demo.THRESHOLD, demo.WINDOW_S, slice_s=3600)


def _stored_triggers(spark, sf_dir):
    return materialize(_triggers(_marks(spark, sf_dir)), "triggers")


RULE = health.Rule(demo.THRESHOLD, demo.WINDOW_S, demo.COOLDOWN_S, 3600)


def _health(spark, sf_dir):
    return health.provider_health(
        demo.router_events(spark, sf_dir),
        demo.request_stats(spark, sf_dir),
        demo.event_providers(spark, sf_dir),
        AS_OF,
        RULE,
    )


def _provider_stats(spark, sf_dir):
    return stats.provider_stats(demo.router_events(spark, sf_dir), demo.request_stats(spark, sf_dir))


@query
def provider_stats(spark, sf_dir):
    return _provider_stats(spark, sf_dir)


@query
def router_totals(spark, sf_dir):
    return stats.router_totals(_provider_stats(spark, sf_dir))


@query
def uptime(spark, sf_dir):
    return stats.uptime(demo.router_events(spark, sf_dir), AS_OF)


@query
def metrics_long(spark, sf_dir):
    ps, totals = _health(spark, sf_dir)
    return publish.metrics(ps, totals).select("name", "type", "provider_type", "provider", "value")


@query
def metrics_lines(spark, sf_dir):
    ps = materialize(_provider_stats(spark, sf_dir), "provider-stats")
    counters = publish.metrics(ps, stats.router_totals(ps)).filter("type = 'counter'")
    return publish.metrics_text(counters, "1.0").select("line")


@query
def status_document(spark, sf_dir):
    """The status document, read back at a few paths per provider."""
    names = P.with_names(demo.providers(spark, sf_dir))
    ps, totals = _health(spark, sf_dir)
    doc = publish.status_json(names, P.provider_counts(demo.providers(spark, sf_dir)), ps, totals)
    parsed = doc.select(F.parse_json("status").alias("d"))
    types = parsed.select(F.explode(F.array(*[F.lit(t) for t in ("openai", "anthropic", "unknown")])).alias("t"), "d")

    def at(t: str, path: str, kind: str):
        return F.try_variant_get("d", f"$.{path.replace('<t>', t)}", kind)

    def pick(path: str, kind: str):
        column = F.lit(None).cast(kind)
        for t in ("openai", "anthropic", "unknown"):
            column = F.when(F.col("t") == t, at(t, path, kind)).otherwise(column)
        return column

    return types.select(
        F.col("t").alias("provider_type"),
        pick("statistics.<t>.total_requests", "bigint").alias("total_requests"),
        pick("statistics.<t>.most_used_provider", "string").alias("most_used_provider"),
        pick("statistics.<t>.providers.p0.total_requests", "bigint").alias("p0_requests"),
        pick("statistics.<t>.providers.p1.rate_limits.total_rate_limits", "bigint").alias("p1_limits"),
        pick("statistics.<t>.providers.p2.success_rate", "double").alias("p2_success_rate"),
        pick("config.<t>.provider_count", "bigint").alias("configured"),
    )


@query
def error_breakdown(spark, sf_dir):
    return chains.error_breakdown(demo.router_events(spark, sf_dir))


@query
def error_subtotals(spark, sf_dir):
    return chains.error_breakdown(demo.router_events(spark, sf_dir), subtotals=True)


@query
def retry_breakdown(spark, sf_dir):
    return chains.retry_breakdown(demo.router_events(spark, sf_dir))


@query
def fallback_edges(spark, sf_dir):
    return chains.fallback_edges(demo.router_events(spark, sf_dir))


@query
def exhausted_requests(spark, sf_dir):
    return chains.exhausted(demo.router_events(spark, sf_dir))


@query
def request_mix(spark, sf_dir):
    return chains.request_mix(demo.router_events(spark, sf_dir), exact=True)


MIX_FROM, MIX_TO = dt.datetime(2024, 1, 9, 4, 30), dt.datetime(2024, 1, 23, 17, 15)


@query
def request_mix_from_rollup(spark, sf_dir):
    """Two weeks of the request mix from stored sketches by hour, requests of many attempts on several days included.

    The estimates are compared with the exact counts: ``within`` says that one is at most four standard errors off.
    """
    events = demo.router_events(spark, sf_dir, chained=True)
    rolled = materialize(chains.request_mix_rollup(events), "request-mix")
    mix = chains.request_mix_from_rollup(rolled, events, MIX_FROM, MIX_TO).withColumnRenamed("requests", "estimate")
    at = F.col("timestamp")
    exact = chains.request_mix(events.filter((at >= F.lit(MIX_FROM)) & (at < F.lit(MIX_TO))), exact=True)
    exact = exact.select(*[F.col(c).alias(f"exact_{c}") for c in chains.MIX], "requests")
    same = [F.col(c).eqNullSafe(F.col(f"exact_{c}")) for c in chains.MIX]
    error = 4 * 1.04 / 2 ** (chains.SKETCH_LG_K / 2)
    return mix.join(exact, same, "full").select(
        *chains.MIX,
        "attempts",
        "requests",
        (F.abs(F.col("estimate") - F.col("requests")) <= error * F.col("requests")).alias("within"),
    )


@query
def offered_providers(spark, sf_dir):
    return chains.offered_providers(demo.router_events(spark, sf_dir))


# ---- providers ------------------------------------------------------------------------------------------------------


@query
def provider_names(spark, sf_dir):
    named = P.with_names(demo.providers(spark, sf_dir))
    return named.select("position", "provider_type", "provider", "effective_base_url", "api_key")


@query
def ranked_providers(spark, sf_dir):
    return P.ranked_providers(demo.providers(spark, sf_dir)).select("provider_type", "provider", "priority", "rank")


@query
def provider_priorities(spark, sf_dir):
    asked = demo.table(spark, sf_dir, "supplier").select(
        F.lit("openai").alias("provider_type"), F.col("s_name").alias("provider")
    )
    return P.priority_of(demo.providers(spark, sf_dir), asked)


@query
def validated_providers(spark, sf_dir):
    return P.validate_providers(demo.providers(spark, sf_dir))


@query
def provider_counts(spark, sf_dir):
    return P.provider_counts(demo.providers(spark, sf_dir))


@query
def mapped_models(spark, sf_dir):
    lines = demo.table(spark, sf_dir, "lineitem")
    calls = lines.select(
        F.when(F.col("l_suppkey") % 2 == 0, "openai").otherwise("anthropic").alias("provider_type"),
        F.format_string("Supplier#%09d", "l_suppkey").alias("provider"),
        F.concat(F.lit("m"), (F.col("l_linenumber") % 4).cast("string")).alias("model"),
    )
    mapped = P.map_model(calls, demo.providers(spark, sf_dir))
    return mapped.groupBy("provider_type", "model", "mapped_model").agg(F.count(F.lit(1)).alias("calls"))


@query
def providers_with_statistics(spark, sf_dir):
    """Configured suppliers and the order lines they had: idle ones have zero."""
    lines = demo.table(spark, sf_dir, "lineitem")
    seen = lines.groupBy(
        F.when(F.col("l_suppkey") % 2 == 0, "openai").otherwise("anthropic").alias("provider_type"),
        F.format_string("Supplier#%09d", "l_suppkey").alias("provider"),
    ).agg(F.count(F.lit(1)).alias("total_requests"))
    both = P.with_statistics(demo.providers(spark, sf_dir), seen)
    return both.select("provider_type", "provider", "priority", "configured", "total_requests")


@query
def next_providers(spark, sf_dir):
    failed = demo.router_events(spark, sf_dir).filter("type = 'error' and provider <> 'all'")
    failures = failed.select("request_id", derive.provider_type(F.col("endpoint")).alias("provider_type"), "provider")
    return chains.next_provider(failures, demo.event_providers(spark, sf_dir))


# ---- chains ---------------------------------------------------------------------------------------------------------


@query
def request_chains(spark, sf_dir):
    return chains.request_chains(demo.router_events(spark, sf_dir, chained=True))


def _passed_over(spark, sf_dir, log):
    """Providers that the chained requests passed over, judged by the cooldowns of the plain log."""
    providers = demo.event_providers(spark, sf_dir).drop("position")
    return chains.passed_over(log, providers, _stored_triggers(spark, sf_dir), demo.COOLDOWN_S)


@query
def passed_over(spark, sf_dir):
    skips = _passed_over(spark, sf_dir, demo.router_events(spark, sf_dir, chained=True))
    return skips.select("request_id", "provider_type", "provider", "priority", "remaining_s")


@query
def attempt_numbers(spark, sf_dir):
    numbered = chains.attempt_numbers(demo.router_events(spark, sf_dir, chained=True))
    return numbered.select("request_id", "provider", "timestamp", "type", "attempt_no")


@query
def attempt_numbers_skips(spark, sf_dir):
    """Providers passed over count as attempts."""
    log = demo.router_events(spark, sf_dir, chained=True)
    numbered = chains.attempt_numbers(log, _passed_over(spark, sf_dir, log))
    return numbered.select("request_id", "provider", "timestamp", "type", "attempt_no")


@query
def failure_summaries(spark, sf_dir):
    log = demo.router_events(spark, sf_dir, chained=True)
    return chains.failure_summary(log, _passed_over(spark, sf_dir, log))


# ---- cooldown -------------------------------------------------------------------------------------------------------


@query
def cooldown_triggers(spark, sf_dir):
    return _triggers(_marks(spark, sf_dir)).select("provider_type", "provider", F.timestamp_micros("us").alias("ts"), "seq")


@query
def cooldown_triggers_daily(spark, sf_dir):
    """Stored maps by day: all days but the last three and one in the middle at once, then these one by one."""
    path = scratch_path(spark, "daily")
    cooldown.outcomes(demo.router_events(spark, sf_dir), only_marks=True).withColumn("date", F.to_date("ts")).write.partitionBy(
        "date"
    ).parquet(path + "/outcomes")
    stored = spark.read.parquet(path + "/outcomes")
    days = [r.date for r in stored.select("date").distinct().orderBy("date").collect()]
    table = daily.DailyCooldown(path, daily.DailyRule(demo.THRESHOLD, demo.WINDOW_S, slice_s=3600))
    single = [*days[-3:], days[len(days) // 2]]
    table.run(stored, [d for d in days if d not in single])
    for day in single:
        later = table.run(stored, [day])
        if later:
            table.pick(stored, later)
    return table.triggers(spark).select("provider_type", "provider", F.timestamp_micros("us").alias("ts"), "seq")


@query
def cooldown_episodes(spark, sf_dir):
    return cooldown.episodes(_stored_triggers(spark, sf_dir), AS_OF, demo.COOLDOWN_S, slice_s=3600)


@query
def cooldown_status(spark, sf_dir):
    return health.status(demo.router_events(spark, sf_dir), demo.event_providers(spark, sf_dir), AS_OF, RULE)


@query
def recent_rate_limits(spark, sf_dir):
    marks = _marks(spark, sf_dir)
    return cooldown.recent_rate_limits(marks, _triggers(marks), AS_OF, demo.WINDOW_S)


def _requests(spark, sf_dir):
    return demo.router_events(spark, sf_dir).filter("type = 'request'").select(
        "request_id",
        derive.provider_type(F.col("endpoint")).alias("provider_type"),
        "provider",
        F.col("timestamp").alias("ts"),
        "provider_priority",
    )


@query
def cooldown_hits(spark, sf_dir):
    flagged = cooldown.with_cooldown(_requests(spark, sf_dir), _stored_triggers(spark, sf_dir), demo.COOLDOWN_S)
    return flagged.select("request_id", "provider_type", "provider", "in_cooldown")


@query
def skipped_providers(spark, sf_dir):
    log = demo.router_events(spark, sf_dir)
    served = (
        log.filter("type = 'response'").select("request_id").distinct().withColumn("ok", F.lit(True))
    )
    asked = _requests(spark, sf_dir).drop("provider").join(served, "request_id", "left")
    asked = asked.withColumn("served_priority", F.when(F.col("ok"), F.col("provider_priority"))).drop("ok", "provider_priority")
    return cooldown.skipped_providers(
        asked,
        demo.event_providers(spark, sf_dir).drop("position"),
        _stored_triggers(spark, sf_dir),
        demo.COOLDOWN_S,
    ).select("request_id", "provider_type", "provider", "priority")


@query
def running_latency(spark, sf_dir):
    """Running count, maximum and remaining minimum per provider along time."""
    rows = demo.table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 4).alias("p"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value"
    )
    forward = running(
        rows, ["p"], ["us", "event_id"], time_slice("us", 3600),
        {"n": ("sum", F.lit(1).cast("bigint")), "highest": ("max", F.col("value"))},
    )
    return running(
        forward, ["p"], ["us", "event_id"], time_slice("us", 3600), {"lowest_ahead": ("min", F.col("value"))},
        reverse=True, inclusive=False,
    ).select("event_id", "n", "highest", "lowest_ahead")


# ---- response streams -----------------------------------------------------------------------------------------------


@query
def sse_events(spark, sf_dir):
    events = chunks.sse_events(demo.conversation_chunks(spark, sf_dir, "openai"))
    return events.select(
        "request_id",
        F.try_variant_get("v", "$.choices[0].finish_reason", "string").alias("finish_reason"),
        F.try_variant_get("v", "$.choices[0].delta.content", "string").alias("content"),
    )


@query
def merged_openai(spark, sf_dir):
    merged = chunks.merge_openai(chunks.sse_events(demo.conversation_chunks(spark, sf_dir, "openai")))
    calls = F.expr(
        "array_join(transform(c.message.tool_calls, t -> concat_ws(':', coalesce(t.id, '-'), "
        "coalesce(t.function.name, '-'), coalesce(t.function.arguments, '-'))), ',')"
    )
    return merged.select(
        "request_id", "id", "object", "created", "model", F.explode("choices").alias("c"),
        F.try_variant_get("usage", "$.prompt_tokens", "bigint").alias("prompt_tokens"),
        F.try_variant_get("usage", "$.completion_tokens", "bigint").alias("completion_tokens"),
    ).select(
        "request_id", "id", "object", "created", "model", "prompt_tokens", "completion_tokens",
        F.col("c.index").alias("choice"),
        F.col("c.message.role").alias("role"),
        F.col("c.message.content").alias("content"),
        F.col("c.finish_reason").alias("finish_reason"),
        calls.alias("tool_calls"),
    )


@query
def merged_anthropic(spark, sf_dir):
    merged = chunks.merge_anthropic(chunks.sse_events(demo.conversation_chunks(spark, sf_dir, "anthropic")))
    return merged.select(
        "request_id", "id", "model", "stop_reason", "usage.*", F.posexplode("content").alias("block", "b")
    ).select(
        "request_id", "id", "model", "stop_reason",
        "input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
        "block",
        F.col("b.type").alias("type"),
        F.col("b.id").alias("tool_id"),
        F.col("b.text").alias("text"),
        F.col("b.input").alias("input"),
    )


@query
def merged_anthropic_open(spark, sf_dir):
    """What the merge keeps beside its typed columns."""
    merged = chunks.merge_anthropic(chunks.sse_events(demo.conversation_chunks(spark, sf_dir, "anthropic")))
    return merged.select("request_id", "whole_usage", F.posexplode("start_blocks").alias("block", "b")).select(
        "request_id",
        F.try_variant_get("whole_usage", "$.service_tier", "string").alias("service_tier"),
        F.try_variant_get("whole_usage", "$.server_tool_use.web_search_requests", "bigint").alias("web_searches"),
        F.try_variant_get("whole_usage", "$.output_tokens", "bigint").alias("output_tokens"),
        "block",
        F.try_variant_get("b", "$.tool_use_id", "string").alias("tool_use_id"),
        F.try_variant_get("b", "$.citations[0]", "string").alias("citation"),
        F.try_variant_get("b", "$.text", "string").alias("start_text"),
    )


@query
def merged_documents(spark, sf_dir):
    merged = chunks.merge_openai(chunks.sse_events(demo.document_chunks(spark, sf_dir)))
    return merged.select("request_id", F.col("choices")[0]["message"]["content"].alias("content"))


@query
def tool_inputs(spark, sf_dir):
    merged = chunks.merge_anthropic(chunks.sse_events(demo.conversation_chunks(spark, sf_dir, "anthropic")))
    return chunks.tool_inputs(merged).select(
        "request_id", "position", "id", "name", F.try_variant_get("input", "$.n", "bigint").alias("n")
    )


@query
def chunk_timing(spark, sf_dir):
    timing = chunks.chunk_timing(
        demo.conversation_chunks(spark, sf_dir, "openai"), demo.chunk_requests(spark, sf_dir)
    )
    return timing.select("request_id", "last_ts", "duration_ms", "time_to_first_token_ms")


def _both_formats(spark, sf_dir):
    openai = demo.conversation_chunks(spark, sf_dir, "openai")
    anthropic = demo.conversation_chunks(spark, sf_dir, "anthropic")
    return openai.unionByName(
        anthropic.withColumn("request_id", F.concat(F.lit("a"), F.col("request_id")))
    )


def _both_requests(spark, sf_dir):
    asked = demo.chunk_requests(spark, sf_dir)
    return asked.unionByName(asked.withColumn("request_id", F.concat(F.lit("a"), F.col("request_id"))))


@query
def stats_from_chunks(spark, sf_dir):
    return chunks.stats_from_chunks(_both_formats(spark, sf_dir), _both_requests(spark, sf_dir))


# ---- streaming ------------------------------------------------------------------------------------------------------


WINDOW_KEY = ["bucket", "provider_type", "provider_name"]


def _event_stream(spark, sf_dir):
    return live.stream_parquet(spark, f"{sf_dir}/events.parquet")


@query
def streaming_requests(spark, sf_dir):
    path = scratch_path(spark, "live")
    rows = demo.stats_of(_event_stream(spark, sf_dir)).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    update_log.start(live.live_requests(rows, "hour"), path, path + "-checkpoint", WINDOW_KEY).awaitTermination()
    windows = update_log.latest(spark, path, WINDOW_KEY)
    return live.live_series(windows, AS_OF, "hour", 720)


@query
def streaming_counters(spark, sf_dir):
    path = scratch_path(spark, "live")
    counters = live.live_counters(demo.events_of(_event_stream(spark, sf_dir)))
    update_log.start(counters, path, path + "-checkpoint", stats.KEY).awaitTermination()
    latest = update_log.latest(spark, path, ["provider_type", "provider"])
    return latest.select(
        "provider_type", "provider", "total_requests", "successful_requests", "failed_requests", "total_rate_limits",
        "total_input_tokens", "total_output_tokens", "total_latency_ms", "last_success_time",
    )


DELAY_S = 1800
FILE_ROWS = 500_000


def _arrivals(rows, path: str, parts: int = 4) -> int:
    """Rows in parts in the order of their arrival, up to half an hour out of the order of their times.

    Every part has the same number of files, which is returned: they come in one micro-batch, whatever the writer.
    """
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("seq"), F.lit(DELAY_S * 1_000_000))
    rows = materialize(rows.withColumn("arrival", arrival), "arrivals")
    edges = rows.approxQuantile("arrival", [n / parts for n in range(1, parts)], 0.01)
    files = max(1, -(-rows.count() // (parts * FILE_ROWS)))
    for low, high in zip([None, *edges], [*edges, None]):
        part = rows if low is None else rows.filter(F.col("arrival") >= low)
        part = part if high is None else part.filter(F.col("arrival") < high)
        part = part.drop("arrival")
        # closed files, as a gateway hands over; rows have a number each, so none of these is empty
        part = part.coalesce(1) if files == 1 else part.repartition(files, "seq")
        part.write.mode("append").parquet(path)
    return files


@query
def streaming_cooldown(spark, sf_dir):
    """From raw request and end events in several files, out of order, under the default reset rule."""
    path = scratch_path(spark, "live")
    log = demo.router_events(spark, sf_dir).filter("type in ('request', 'response', 'error')")
    names = ["type", "request_id", "provider", "endpoint", "stream", "usage", "input_tokens", "status_code", "seq"]
    files = _arrivals(log.select(F.col("timestamp").alias("ts"), *names), path + "/in")
    source = live.stream_parquet(spark, path + "/in", files_per_trigger=files).withColumnRenamed("ts", "timestamp")
    outcomes = live_cooldown.live_outcomes(source, f"{DELAY_S} seconds")
    detector = live_cooldown.LiveCooldown(path, demo.THRESHOLD, demo.WINDOW_S, slice_s=3600, lateness_s=DELAY_S)
    detector.start(outcomes, path + "-checkpoint").awaitTermination()
    found = live_cooldown.read_triggers(spark, path).unionByName(detector.expected(spark))
    return found.select("provider_type", "provider", F.timestamp_micros("us").alias("ts"), "seq")


@query
def streaming_cooldown_unordered(spark, sf_dir):
    """From outcomes in files whose events are up to half an hour out of order; what came too late is in the result."""
    path = scratch_path(spark, "live")
    rows = cooldown.outcomes(demo.router_events(spark, sf_dir))
    files = _arrivals(rows.withColumn("ts", F.col("ts").cast("timestamp")), path + "/in")
    detector = live_cooldown.LiveCooldown(path, demo.THRESHOLD, demo.WINDOW_S, slice_s=3600, lateness_s=DELAY_S)
    source = live.stream_parquet(spark, path + "/in", files_per_trigger=files)
    detector.start(source, path + "-checkpoint").awaitTermination()
    found = live_cooldown.read_triggers(spark, path).unionByName(detector.expected(spark)).withColumn("late", F.lit(False))
    late = live_cooldown.read_late(spark, path).select("provider_type", "provider", "us", "seq", F.lit(True).alias("late"))
    return found.unionByName(late).select("provider_type", "provider", F.timestamp_micros("us").alias("ts"), "seq", "late")


@query
def streaming_late_rows(spark, sf_dir):
    """A live rollup of four files; rows of a fifth of all hours come with the last one, days behind the watermark."""
    path = scratch_path(spark, "live")
    rows = demo.request_stats(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    hour = F.call_function("div", F.unix_micros("timestamp"), F.lit(3_600_000_000))
    quarter = F.ntile(4).over(Window.orderBy("day"))
    days = rows.select(F.to_date("timestamp").alias("day")).distinct().withColumn("part", quarter)
    placed = rows.withColumn("day", F.to_date("timestamp")).join(days, "day").withColumn("part", F.when(hour % 5 == 0, 4).otherwise(F.col("part")))
    placed = materialize(placed.drop("day"), "placed")
    for n in range(1, 5):
        placed.filter(f"part = {n}").drop("part").coalesce(1).write.mode("append").parquet(path + "/in")
    table = live_rollup.LiveRollup(path + "/table", "hour", delay_s=3600)
    table.start(live.stream_parquet(spark, path + "/in", files_per_trigger=1), path + "-checkpoint").awaitTermination()
    table.refresh(spark)
    return table.windows(spark).select("bucket", "provider_type", "provider_name", "request_count", "total_tokens", "max_timestamp")


@query
def streaming_in_flight(spark, sf_dir):
    path = scratch_path(spark, "live")
    log = demo.events_of(_event_stream(spark, sf_dir))
    found = live.live_in_flight(log, timeout="1 minute", delay="1 minute")
    started = (
        found.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(found.schema).parquet(path)


def _cut_files(recorded, path: str) -> int:
    """Chunks in files that each have some of a response's chunks; returns how many are half of them at most."""
    files = max(1, -(-recorded.count() // (4 * FILE_ROWS)))
    own = [F.pmod(F.xxhash64("request_id"), F.lit(files))] if files > 1 else []
    recorded.repartition(4 * files, F.col("seq") % 4, *own).write.parquet(path)
    return 2 * files


@query
def streaming_assembly(spark, sf_dir):
    """Text per choice from the live pieces; the files cut every response, so that it pauses for whole batches."""
    path = scratch_path(spark, "live")
    recorded = demo.conversation_chunks(spark, sf_dir, "openai")
    half = _cut_files(recorded, path + "/in")
    pieces = live_chunks.assemble(live.stream_parquet(spark, path + "/in", files_per_trigger=half))
    started = (
        pieces.writeStream.format("parquet")
        .option("path", path + "/out")
        .option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    done = spark.read.schema(live_chunks.PIECES).parquet(path + "/out")
    merged = chunks.merge_openai(chunks.sse_events(live_chunks.as_chunks(done)))
    return merged.select("request_id", F.explode("choices").alias("c")).select(
        "request_id", F.col("c.index").cast("bigint").alias("choice"), F.col("c.message.content").alias("content")
    )


@query
def streaming_stats(spark, sf_dir):
    """Request stats from live chunks of both formats; the files cut every response, and a chunk three days after the
    others closes them all."""
    path = scratch_path(spark, "live-stats")
    recorded = _both_formats(spark, sf_dir)
    half = _cut_files(recorded, path + "/in")
    end = recorded.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts")).select(
        F.lit("").alias("request_id"), F.lit(None).cast("string").alias("provider_type"), F.lit(0).cast("bigint").alias("seq"),
        "ts", F.lit("").cast("binary").alias("data"),
    )
    end.filter("ts IS NOT NULL").select(*recorded.columns).write.mode("append").parquet(path + "/in")
    closed = live_stats.closed_responses(live.stream_parquet(spark, path + "/in", files_per_trigger=half), delay="1 day")
    started = (
        closed.writeStream.format("parquet")
        .option("path", path + "/out")
        .option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    done = spark.read.schema(live_stats.CLOSED).parquet(path + "/out")
    return chunks.stats_of_closed(done, _both_requests(spark, sf_dir))
