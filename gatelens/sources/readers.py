"""Scans of the gateway's files and of our own tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens import schemas
from gatelens.operators.reports import rollup
from gatelens.session import path_exists

ERROR_COPY_SUFFIX = "_errors.jsonl"
LINE_BITS = 41  # of a sequence number, for the place within its file


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_request_stats(
    spark: SparkSession, path: str, *, missing_ok: bool = True, corrupt_column: str | None = None
) -> DataFrame:
    """Request-stats CSV with header. A missing path gives no rows.

    Malformed rows keep the fields that parse and have NULL for the rest; with ``corrupt_column`` their raw line is
    kept in that column, see :func:`split_corrupt`.
    """
    schema = schemas.REQUEST_STATS
    if corrupt_column:
        schema = T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
    if missing_ok and not path_exists(spark, path):
        return _empty(spark, schema)
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    if corrupt_column:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.csv(path)


def split_corrupt(df: DataFrame, corrupt_column: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows."""
    good = df.filter(F.col(corrupt_column).isNull()).drop(corrupt_column)
    return good, df.filter(F.col(corrupt_column).isNotNull())


def read_request_stats_table(spark: SparkSession, path: str, *, missing_ok: bool = True) -> DataFrame:
    """Our Parquet form of the same table, partitioned by ``date``."""
    schema = T.StructType([*schemas.REQUEST_STATS.fields, T.StructField("date", T.DateType())])
    if missing_ok and not path_exists(spark, path):
        return _empty(spark, schema)
    return spark.read.schema(schema).parquet(path)


def read_rollup_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored rollup by minute of request stats, partitioned by ``date``."""
    fields = rollup(_empty(spark, schemas.REQUEST_STATS)).schema.fields
    return spark.read.schema(T.StructType([*fields, T.StructField("date", T.DateType())])).parquet(path)


def read_router_events(
    spark: SparkSession,
    path: str,
    *,
    glob: str = "*.{jsonl,jsonl.zst}",
    missing_ok: bool = True,
    corrupt_column: str | None = None,
) -> DataFrame:
    """All event types of the JSONL logs below ``path``, plain and archived (``.jsonl.zst``).

    ``*_errors.jsonl`` only holds copies of warnings and errors and is left out. Adds ``file_name`` and ``seq``, one order
    over all files below ``path``: files by their path, lines of a file as they stand. A split's lines are numbered from its
    byte offset, and no split has more lines than bytes, so numbers of later splits are always larger. There may be four
    million files, of two terabytes each. A line that is no JSON has no type; with ``corrupt_column`` its text is kept
    there, see :func:`split_corrupt`.
    """
    fields = [*schemas.ROUTER_EVENTS.fields]
    if corrupt_column:
        fields.append(T.StructField(corrupt_column, T.StringType()))
    read = T.StructType(fields)
    schema = T.StructType([*fields, T.StructField("file_name", T.StringType()), T.StructField("seq", T.LongType())])
    if missing_ok and not path_exists(spark, path):
        return _empty(spark, schema)
    reader = spark.read.schema(read)
    if corrupt_column:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    lines = (
        reader.option("pathGlobFilter", glob)
        .json(path)
        .filter(
            ~F.col("_metadata.file_name").endswith(ERROR_COPY_SUFFIX)
            & ~F.col("_metadata.file_name").endswith(ERROR_COPY_SUFFIX + ".zst")
        )
    )
    line_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = lines.select(
        *read.fieldNames(),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("__path"),
        (F.col("_metadata.file_block_start") + line_in_task).alias("__line"),
    )
    return placed.join(_file_ranks(lines), "__path").select(
        *read.fieldNames(), "file_name", (F.col("__rank") * (1 << LINE_BITS) + F.col("__line")).alias("seq")
    )


def _file_ranks(lines: DataFrame) -> DataFrame:
    """``__path, __rank`` of the files of a scan, from its listing. Spark broadcasts it if it is small."""
    # the listing writes local paths with three slashes, the metadata column with one
    names = sorted(re.sub("^file:/+", "file:/", name) for name in lines.inputFiles())
    if len(names) >= 1 << (63 - LINE_BITS):
        raise ValueError(f"{len(names)} files are too many for one order")
    return lines.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "__path string, __rank bigint")


def read_router_events_table(spark: SparkSession, path: str, *, missing_ok: bool = True) -> DataFrame:
    """Our Parquet form of the event log, partitioned by ``date`` and ``type``."""
    fields = [*schemas.ROUTER_EVENTS.fields, T.StructField("seq", T.LongType()), T.StructField("date", T.DateType())]
    schema = T.StructType(fields)
    if missing_ok and not path_exists(spark, path):
        return _empty(spark, schema)
    return spark.read.schema(schema).parquet(path)


def with_log_file(df: DataFrame) -> DataFrame:
    """Start time and session of the log file, from the name ``router_YYYYMMDD_HHMMSS_<session>``."""
    pattern = r"^router_(\d{8}_\d{6})_([^_.]+)"
    started = F.nullif(F.regexp_extract("file_name", pattern, 1), F.lit(""))
    return df.withColumns(
        {
            "log_started_at": F.try_to_timestamp(started, F.lit("yyyyMMdd_HHmmss")),
            "log_session": F.nullif(F.regexp_extract("file_name", pattern, 2), F.lit("")),
        }
    )


def read_providers(spark: SparkSession, path: str) -> DataFrame:
    """Provider configuration as a dimension: ``{type: provider | [provider, ...]}``, defaults applied.

    ``position`` keeps the order inside the file. A provider without ``api_key`` is an error.
    """
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    parts = []
    for type_ in ("openai", "anthropic"):
        found = F.try_variant_get("doc", f"$.{type_}", "variant")
        as_list = F.when(F.schema_of_variant(found).startswith("ARRAY"), found.cast("array<variant>")).when(
            found.isNotNull() & ~F.is_variant_null(found), F.array(found)
        )
        parts.append(
            doc.select(F.posexplode(as_list).alias("position", "p")).select(
                F.lit(type_).alias("provider_type"), "position", "p"
            )
        )
    rows = parts[0].unionByName(parts[1])

    def field(name: str, as_type: str) -> Column:
        return F.try_variant_get("p", f"$.{name}", as_type)

    return rows.select(
        "provider_type",
        F.coalesce(field("api_key", "string"), F.raise_error(F.lit("provider without api_key"))).alias("api_key"),
        F.coalesce(field("priority", "int"), F.lit(1)).alias("priority"),
        field("base_url", "string").alias("base_url"),
        F.coalesce(field("timeout", "int"), F.lit(30)).alias("timeout"),
        F.coalesce(field("max_retries", "int"), F.lit(3)).alias("max_retries"),
        F.coalesce(field("model_mapping", "map<string,string>"), F.create_map().cast("map<string,string>")).alias(
            "model_mapping"
        ),
        field("provider_name", "string").alias("provider_name"),
        "position",
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Recorded response chunks: ``request_id, provider_type, seq, ts, data``."""
    return spark.read.schema(schemas.CHUNKS).parquet(path)
