"""Operators on the provider dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions import derive
from gatelens.operators.running import int_div, running


def with_names(providers: DataFrame) -> DataFrame:
    """Display name, effective base URL and number of mapped models; the API key only masked."""
    return providers.withColumns(
        {
            "provider": derive.display_name(F.col("provider_name"), F.col("provider_type"), F.col("priority")),
            "effective_base_url": derive.effective_base_url(F.col("base_url"), F.col("provider_type")),
            "api_key": derive.mask_key(F.col("api_key")),
            "mapped_models": F.coalesce(F.size("model_mapping"), F.lit(0)),
        }
    )


def ranked_providers(providers: DataFrame) -> DataFrame:
    """Providers of each type in priority order; equal priorities keep their position in the configuration."""
    named = providers if "provider" in providers.columns else with_names(providers)
    return running(
        named,
        ["provider_type"],
        ["priority", "position"],
        int_div(F.col("priority"), 1024),
        {"rank": ("sum", F.lit(1).cast("bigint"))},
    )


def priority_of(providers: DataFrame, names: DataFrame) -> DataFrame:
    """Priority of each asked (provider_type, provider), NULL if unknown."""
    known = ranked_providers(providers).groupBy("provider_type", "provider").agg(F.min("priority").alias("priority"))
    return names.join(known, ["provider_type", "provider"], "left")


def map_model(df: DataFrame, providers: DataFrame) -> DataFrame:
    """Vendor model name of each row's (provider_type, provider, model); names without a mapping stay."""
    named = providers if "provider" in providers.columns else with_names(providers)
    # one row per provider (the first in order), so that the join cannot multiply rows
    place = F.when(F.col("model_mapping").isNotNull(), F.struct("priority", "position"))
    mapping = named.groupBy("provider_type", "provider").agg(F.min_by("model_mapping", place).alias("mapping"))
    return (
        df.join(mapping, ["provider_type", "provider"], "left")
        .withColumn("mapped_model", F.coalesce(F.try_element_at("mapping", F.col("model")), F.col("model")))
        .drop("mapping")
    )


def provider_counts(providers: DataFrame) -> DataFrame:
    """Per type: providers, enabled flag, size of all model mappings. Types without a provider are listed too."""
    spark = providers.sparkSession
    types = spark.createDataFrame([(t,) for t in derive.PROVIDER_TYPES], "provider_type string")
    counted = providers.groupBy("provider_type").agg(
        F.count(F.lit(1)).alias("provider_count"),
        F.sum(F.coalesce(F.size("model_mapping"), F.lit(0))).alias("mapped_models"),
    )
    return types.join(counted, "provider_type", "full").select(
        "provider_type",
        (F.coalesce("provider_count", F.lit(0)) > 0).alias("enabled"),
        F.coalesce("provider_count", F.lit(0)).alias("provider_count"),
        F.coalesce("mapped_models", F.lit(0)).alias("mapped_models"),
    )


def validate_providers(providers: DataFrame) -> DataFrame:
    """Violations, one row each: repeated priority in a type, repeated display name, value out of range."""
    named = providers if "provider" in providers.columns else with_names(providers)
    priorities = (
        named.groupBy("provider_type", "priority")
        .count()
        .filter("count > 1")
        .select("provider_type")
        .distinct()
        .select("provider_type", F.lit("duplicate_priority").alias("rule"), F.lit(None).cast("string").alias("provider"))
    )
    names = (
        named.groupBy("provider_type", "provider")
        .count()
        .filter("count > 1")
        .select("provider_type", F.lit("duplicate_name").alias("rule"), "provider")
    )
    ranges = named.filter(
        (F.col("priority") < 1) | (F.col("timeout") < 1) | (F.col("max_retries") < 0)
    ).select("provider_type", F.lit("value_out_of_range").alias("rule"), "provider")
    return priorities.unionByName(names).unionByName(ranges)


def with_statistics(providers: DataFrame, stats: DataFrame) -> DataFrame:
    """Configured providers and observed ones side by side; idle ones have zero requests."""
    named = providers if "provider" in providers.columns else with_names(providers)
    # a name may be configured twice; the entry tried first counts
    first = F.struct("priority", "position")
    config = named.groupBy("provider_type", "provider").agg(
        *(F.min_by(c, first).alias(c) for c in ("priority", "base_url", "model_mapping"))
    )
    return (
        config.join(stats, ["provider_type", "provider"], "full")
        .withColumns(
            {
                "configured": F.col("priority").isNotNull(),
                "total_requests": F.coalesce("total_requests", F.lit(0)),
            }
        )
    )
