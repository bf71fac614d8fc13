"""Rows of the event log for tests."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens import schemas

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

_JSON = {"full_request", "full_response", "details"}
_SCHEMA = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name in _JSON else f.dataType) for f in schemas.ROUTER_EVENTS.fields]
    + [T.StructField("seq", T.LongType())]
)


def log(spark, rows):
    """Event log from dicts; ``at`` is seconds after T0, payloads are JSON text."""
    filled = []
    for n, row in enumerate(rows):
        row = {"session_id": "s", "endpoint": "openai", "seq": n} | row
        row["timestamp"] = T0 + dt.timedelta(seconds=row.pop("at", n))
        filled.append(tuple(row.get(f) for f in _SCHEMA.fieldNames()))
    df = spark.createDataFrame(filled, _SCHEMA)
    return df.withColumns({c: F.try_parse_json(c) for c in _JSON})


def usage(prompt, completion, cached=0):
    return (prompt, completion, prompt + completion, cached)
