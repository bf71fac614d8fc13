"""Scalar derivations: provider type, rounding, error classes, masking, time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Must equal the gateway's own.
PROVIDER_TYPES = ["openai", "anthropic"]
DEFAULT_BASE_URL = {"openai": "https://api.openai.com/v1", "anthropic": "https://api.anthropic.com"}
FAILURE_PREFIX = {
    "authentication_error": "Authentication error: ",
    "rate_limit_error": "Rate limit error: ",
    "provider_error": "Provider error: ",
    "unexpected_error": "Unexpected error: ",
}
ATTEMPT_PREFIX = {"rate_limit_error": "Rate limited: ", "unexpected_error": "Unexpected error: "}
CLIENT_STATUS = {
    "no_available_provider": 503,
    "rate_limit_error": 429,
    "authentication_error": 401,
    "provider_error": 502,
    "llm_error": 500,
}


def _lookup(key: Column, table: dict, default: Column) -> Column:
    column = default
    for name, value in table.items():
        column = F.when(key == name, F.lit(value)).otherwise(column)
    return column


def provider_type(endpoint: Column) -> Column:
    column = F.lit("unknown")
    for name in PROVIDER_TYPES:
        column = F.when(endpoint.startswith(name), F.lit(name)).otherwise(column)
    return column


def round_ms(value: Column) -> Column:
    """Two digits, by the exact binary value of the number, a true tie to the even digit; NULL stays NULL.

    ``bround`` works on the shortest decimal text of a double, so it takes 4.395 (stored a little lower) for a tie.
    Only numbers that close to a tie take the exact way: the fraction times 2^60 is a whole number.
    """
    size = F.abs(value)
    scaled = size * 100
    near_tie = F.abs(scaled - F.floor(scaled) - 0.5) < 1e-6
    whole = F.floor(size)
    bits = ((size - whole) * float(1 << 60)).cast("bigint").cast("decimal(19,0)") * F.lit(100).cast("decimal(3,0)")
    unit = F.lit(str(1 << 60)).cast("decimal(19,0)")
    down = F.call_function("div", bits, unit)
    rest = bits - down.cast("decimal(3,0)") * unit
    half = F.lit(str(1 << 59)).cast("decimal(19,0)")
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    digits = whole * 100 + down + F.when(up, 1).otherwise(0)
    exact = digits.cast("double") / 100 * F.signum(value)
    return F.when(near_tie & (size < 1e12), exact).otherwise(F.bround(value, 2))


def display_name(provider_name: Column, type_: Column, priority: Column) -> Column:
    """The given name, or ``{type}-priority-{n}``; an empty name counts as none."""
    return F.coalesce(F.nullif(provider_name, F.lit("")), F.concat(type_, F.lit("-priority-"), priority.cast("string")))


def effective_base_url(base_url: Column, type_: Column) -> Column:
    return F.coalesce(F.nullif(base_url, F.lit("")), _lookup(type_, DEFAULT_BASE_URL, F.lit(None).cast("string")))


def mask_key(api_key: Column) -> Column:
    """Eight stars and the last four characters, or twelve stars for a key of four or fewer."""
    return F.concat(F.lit("*" * 8), F.when(F.length(api_key) > 4, F.right(api_key, F.lit(4))).otherwise(F.lit("****")))


def classify_error(status: Column) -> Column:
    """Error class of an HTTP status of the vendor."""
    return (
        F.when(status == 401, F.lit("authentication_error"))
        .when(status == 429, F.lit("rate_limit_error"))
        .when(status >= 400, F.lit("provider_error"))
        .otherwise(F.lit("llm_error"))
    )


def failure_label(error_type: Column, message: Column) -> Column:
    """Text of the last error of a provider."""
    return F.concat(_lookup(error_type, FAILURE_PREFIX, F.lit("")), F.coalesce(message, F.lit("")))


def attempt_label(error_type: Column, message: Column) -> Column:
    """Text of one failed attempt in the summary of an exhausted request."""
    return F.concat(_lookup(error_type, ATTEMPT_PREFIX, F.lit("")), F.coalesce(message, F.lit("")))


def client_status(error_type: Column) -> Column:
    """HTTP status shown to the client for an error class."""
    return _lookup(error_type, CLIENT_STATUS, F.lit(500))


def iso_utc(ts: Column) -> Column:
    """ISO text with offset; the fraction is left out when it is zero. The session zone must be UTC."""
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    )


def iso_utc_epoch(seconds: Column) -> Column:
    """The same for epoch seconds."""
    return iso_utc(F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint")))
