"""Token usage, finish reason and request profile from vendor documents held as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(doc: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, path, "bigint"), F.lit(0).cast("bigint"))


def has_key(doc: Column, path: str) -> Column:
    """True if the path exists, even with a JSON null."""
    return F.try_variant_get(doc, path, "variant").isNotNull()


def _usage_struct(prompt: Column, completion: Column, cached: Column) -> Column:
    return F.struct(
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
        cached.alias("cached_tokens"),
    )


def usage_openai(doc: Column) -> Column:
    """prompt / completion / cached tokens; a missing count is 0. Prompt tokens already include the cached ones."""
    return _usage_struct(
        _long(doc, "$.usage.prompt_tokens"),
        _long(doc, "$.usage.completion_tokens"),
        _long(doc, "$.usage.prompt_tokens_details.cached_tokens"),
    )


def usage_anthropic(doc: Column) -> Column:
    """Input is reported without cache traffic here, so cache writes and reads are added to the prompt tokens."""
    cached = _long(doc, "$.usage.cache_read_input_tokens")
    prompt = _long(doc, "$.usage.input_tokens") + _long(doc, "$.usage.cache_creation_input_tokens") + cached
    return _usage_struct(prompt, _long(doc, "$.usage.output_tokens"), cached)


# The plug-in surface: one usage expression per response format.
USAGE_BY_TYPE: dict[str, Callable[[Column], Column]] = {"openai": usage_openai, "anthropic": usage_anthropic}


def usage(doc: Column, provider_type: Column) -> Column:
    """Usage struct for the row's response format, zeros for a format without an adapter."""
    zero = F.lit(0).cast("bigint")
    column = _usage_struct(zero, zero, zero)
    for name, extract in USAGE_BY_TYPE.items():
        column = F.when(provider_type == name, extract(doc)).otherwise(column)
    return column


def finish_reason(doc: Column) -> Column:
    """Finish reason of the first choice if the document has choices, else the stop reason."""
    return F.when(has_key(doc, "$.choices"), F.try_variant_get(doc, "$.choices[0].finish_reason", "string")).otherwise(
        F.try_variant_get(doc, "$.stop_reason", "string")
    )


def is_count_tokens(doc: Column) -> Column:
    """A token-count answer has ``input_tokens`` and no ``model``."""
    return has_key(doc, "$.input_tokens") & ~has_key(doc, "$.model")


def request_profile(doc: Column, user_agent: Column | None = None) -> Column:
    """Model, message count, sampling settings and stream flag of a request document.

    ``user_agent`` is not part of the document; if its column is given, it is the last field.
    """
    messages = F.try_variant_get(doc, "$.messages", "array<variant>")
    sender = [] if user_agent is None else [user_agent.cast("string").alias("user_agent")]
    return F.struct(
        F.coalesce(F.try_variant_get(doc, "$.model", "string"), F.lit("")).alias("model"),
        F.coalesce(F.size(messages), F.lit(0)).alias("message_count"),
        F.try_variant_get(doc, "$.temperature", "double").alias("temperature"),
        F.try_variant_get(doc, "$.max_tokens", "int").alias("max_tokens"),
        F.coalesce(F.try_variant_get(doc, "$.stream", "boolean"), F.lit(False)).alias("stream"),
        *sender,
    )
