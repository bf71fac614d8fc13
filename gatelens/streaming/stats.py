"""Live request stats of streamed responses, read from the chunks as they come.

Per request the state has the line being written, the usage reported so far, the first and last time, and chunks that wait
for a missing one. Texts are not kept: a line is looked at once it is whole, and then forgotten.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatelens.session import use_state_store
from gatelens.streaming.waiting import CHUNK, FIELDS, SEQ, Waiting

# the processor travels to the workers as a whole, so they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE = ["prompt_tokens", "completion_tokens", "cached_tokens"]  # reported as a whole, the last report counts
PARTS = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]  # each by itself
_COUNTS = [T.StructField(name, T.LongType()) for name in WHOLE + PARTS]
_SPAN = [T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType())]
_PROVIDER = T.StructField("provider_type", T.StringType())

_ID, _LATE = T.StructField("request_id", T.StringType()), T.StructField("late", T.BooleanType())
_ROW = T.StructType([_ID, _PROVIDER, *_SPAN, *_COUNTS, _LATE])
_TIMES = [T.StructField("first_ts", T.TimestampType()), T.StructField("last_ts", T.TimestampType())]
CLOSED = T.StructType([_ID, _PROVIDER, *_TIMES, *_COUNTS, _LATE])
_OPEN = T.StructType(
    [
        _PROVIDER,
        *_SPAN,
        *_COUNTS,
        T.StructField("next_seq", T.LongType()),
        T.StructField("due_ms", T.LongType()),
        T.StructField("line", T.BinaryType()),
        T.StructField("closed", T.BooleanType()),
        *FIELDS,
    ]
)


def _unknown(name: str):
    raise ValueError(name)  # NaN and Infinity are no JSON


def _count(value) -> int | None:
    """A count as a 64-bit number, from a number or its text."""
    try:
        number = int(value) if isinstance(value, (bool, int, float, str)) else None
    except (ValueError, OverflowError):
        return None
    return number if number is not None and -(2**63) <= number < 2**63 else None


def _at(doc, *path):
    for key in path:
        doc = doc.get(key) if isinstance(doc, dict) else None
    return doc


def read_line(line: bytes, provider_type: str | None, usage: dict) -> None:
    """Takes the usage that a whole line of a stream reports, if it does, into ``usage``."""
    if not line.startswith(b"data:") or not (b"usage" in line or b"\\u" in line):
        return
    try:
        event = json.loads(line[5:].strip(b" \t\r").decode("utf-8", "replace"), parse_constant=_unknown)
    except (ValueError, RecursionError):
        return
    if provider_type == "openai":
        if _at(event, "usage") is not None:
            found = [("usage", "prompt_tokens"), ("usage", "completion_tokens")]
            found.append(("usage", "prompt_tokens_details", "cached_tokens"))
            usage.update({name: _count(_at(event, *path)) or 0 for name, path in zip(WHOLE, found)})
    elif provider_type == "anthropic":
        path = {"message_start": ("message", "usage"), "message_delta": ("usage",)}.get(str(_at(event, "type")))
        for name in PARTS if path else ():
            number = _count(_at(event, *path, name))
            if number is not None:
                usage[name] = number


class UsageReader(StatefulProcessor):
    """Reads the chunks of one request in order.

    A request is closed a time-out after its newest chunk, with or without an end marker: chunks behind a missing one are
    then read in their order, and its row goes out. It is remembered as closed for another time-out, in which a further
    chunk gives a row marked ``late`` with its time and no usage. A request that is known has one timer: if that comes
    before the request is due, it is set anew then, not with every chunk.
    """

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.waiting = handle.getMapState("waiting", SEQ, CHUNK)

    def _keep(self, state: dict, ms: int) -> None:
        """Stores the state, due a time-out after ``ms``."""
        state["due_ms"] = ms + self.timeout_ms
        state["listed"], state["in_map"] = state["waiting"].fields()
        self.open.update(tuple(state[name] for name in _OPEN.names))

    def _state(self) -> dict | None:
        found = self.open.get()
        if found is None:
            return None
        state = dict(zip(_OPEN.names, tuple(found)))
        return state | {"waiting": Waiting(state["listed"], state["in_map"], self.waiting)}

    def _new(self) -> dict:
        fields = {name: None for name in _OPEN.names}
        return fields | {"next_seq": 0, "line": b"", "closed": False, "waiting": Waiting(None, 0, self.waiting)}

    @staticmethod
    def _read(state: dict, data) -> None:
        *lines, rest = (bytes(state["line"]) + bytes(data)).replace(b"\r", b"\n").split(b"\n")
        for line in lines:
            read_line(line, state["provider_type"], state)
        state["line"] = rest

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found, now = self._state(), timerValues.getCurrentWatermarkInMs()
        state = self._new() if found is None else found
        if state["due_ms"] is not None and state["due_ms"] <= now and not state["closed"]:
            yield self._close(key, state)  # the timers of a batch come after its rows
        for row in rows:
            us, seq = row["us"], row["seq"]
            if state["closed"]:
                state["last_us"] = max(state["last_us"], us)
                yield self._row(key[0], {"provider_type": row["provider_type"], "first_us": us, "last_us": us}, True)
                continue
            state["provider_type"] = row["provider_type"]
            state["first_us"] = us if state["first_us"] is None else min(state["first_us"], us)
            state["last_us"] = us if state["last_us"] is None else max(state["last_us"], us)
            if seq > state["next_seq"]:
                state["waiting"].add(seq, None, bytes(row["data"]))
            elif seq == state["next_seq"]:
                data = row["data"]
                while data is not None:
                    self._read(state, data)
                    state["next_seq"] += 1
                    _, data = state["waiting"].take(state["next_seq"]) or (None, None)
        self._keep(state, max(state["last_us"] // 1000, now))
        if found is None:
            self.handle.registerTimer(state["due_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, now = self._state(), timerValues.getCurrentWatermarkInMs()
        if state is None:
            return
        if state["due_ms"] > now:
            self.handle.registerTimer(state["due_ms"])
            return
        if state["closed"]:
            self.open.clear()
            return
        yield self._close(key, state)
        self._keep(state, now)
        self.handle.registerTimer(state["due_ms"])

    def _close(self, key, state: dict) -> Row:
        for _, data in state["waiting"].drain():
            self._read(state, data)
        self._read(state, b"\n")  # the last line may have no end
        state["closed"] = True
        return self._row(key[0], state)

    @staticmethod
    def _row(request_id, state: dict, late: bool = False) -> Row:
        return Row(request_id=request_id, late=late, **{f.name: state.get(f.name) for f in (_PROVIDER, *_SPAN, *_COUNTS)})

    def close(self) -> None:
        pass


def closed_responses(chunks: DataFrame, delay: str = "1 minute", timeout_s: int = 600) -> DataFrame:
    """One row per response of streaming ``chunks``, ``timeout_s`` after its last chunk in event time: its span of time
    and the usage counts as its format reports them, null where it never did.

    The times move on with the newest chunk of all requests, so the last responses close when later chunks come; a chunk
    of a request that nobody asked for does it too. ``operators.chunks.stats_of_closed`` makes request stats of the rows.
    """
    # this kind of state needs the RocksDB store
    use_state_store(chunks.sparkSession)
    rows = (
        chunks.withWatermark("ts", delay)
        .withColumn("us", F.unix_micros("ts"))
        .groupBy("request_id")
        .transformWithState(
            statefulProcessor=UsageReader(timeout_s * 1000),
            outputStructType=_ROW,
            outputMode="append",
            timeMode="EventTime",
        )
    )
    first, last = F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts")
    return rows.select("request_id", "provider_type", first, last, *WHOLE, *PARTS, "late")
