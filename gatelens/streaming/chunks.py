"""Live assembly of streamed responses.

Per request the chunks that arrived are put in order and handed on as larger pieces; what stays in the state is only
chunks that wait for a missing one and the piece being filled. Pieces are chunks again (``seq`` = piece number), so the
batch merge reads them like a recording. The last piece says whether the stream ended properly; no byte is left out.
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

PIECE_BYTES = 1 << 16  # the size of a large network chunk

_ID = [T.StructField("request_id", T.StringType()), T.StructField("provider_type", T.StringType())]
_SPAN = [T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType())]
_TIMES = [T.StructField("first_ts", T.TimestampType()), T.StructField("last_ts", T.TimestampType())]
_SEQ = T.StructField("seq", T.LongType())
_BODY = [
    T.StructField("data", T.BinaryType()),
    T.StructField("last", T.BooleanType()),
    T.StructField("complete", T.BooleanType()),
    T.StructField("late", T.BooleanType()),
]
_ROW = T.StructType([*_ID, _SEQ, *_SPAN, *_BODY])
PIECES = T.StructType([*_ID, _SEQ, *_TIMES, *_BODY])
_OPEN = T.StructType(
    [
        T.StructField("provider_type", T.StringType()),
        T.StructField("next_seq", T.LongType()),
        T.StructField("piece", T.LongType()),
        *_SPAN,
        T.StructField("data", T.BinaryType()),
        T.StructField("tail", T.BinaryType()),
        T.StructField("ended", T.BooleanType()),
        T.StructField("closed", T.BooleanType()),
        T.StructField("newest_ms", T.LongType()),
        T.StructField("due_ms", T.LongType()),
        *FIELDS,
    ]
)


def _ends(tail: bytes) -> bool:
    """Is one of the whole lines an end marker of either format?"""
    for line in tail.split(b"\n"):
        if not line.startswith(b"data:"):
            continue
        payload = line[5:].strip()
        if payload == b"[DONE]":
            return True
        if b"message_stop" in payload:
            try:
                event = json.loads(payload)
            except ValueError:
                continue
            if isinstance(event, dict) and event.get("type") == "message_stop":
                return True
    return False


class Assembler(StatefulProcessor):
    """Orders the chunks of one request.

    A request stays open for a time-out after its newest chunk, whatever it said so far: an end marker only makes the
    bytes go out at once. Then it is closed, and remembered as closed for another time-out, in which late chunks go out
    as pieces marked ``late``. A request that is known has one timer: if that comes before the time-out has passed since
    the newest chunk, it is set anew then, not with every chunk.
    """

    def __init__(self, timeout_ms: int, piece_bytes: int = PIECE_BYTES) -> None:
        self.timeout_ms = timeout_ms
        self.piece_bytes = piece_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.waiting = handle.getMapState("waiting", SEQ, CHUNK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        request_id, found = key[0], self.open.get()
        state = (None, 0, 0, None, None, b"", b"", False, False, 0, 0, None, 0) if found is None else tuple(found)
        provider_type, next_seq, piece, first_us, last_us, data, tail, ended, closed, newest, _, *held = state
        waiting, buffer = Waiting(*held, self.waiting), bytearray(data)
        for row in rows:
            provider_type = row["provider_type"]
            newest = max(newest, row["us"] // 1000)
            if row["seq"] < next_seq:
                continue
            if closed:
                yield self._piece(request_id, provider_type, piece, row["us"], row["us"], row["data"], None, True)
                piece += 1
                continue
            if row["seq"] > next_seq:
                waiting.add(row["seq"], row["us"], bytes(row["data"]))
                continue
            more = row["us"], bytes(row["data"])
            while more is not None:
                us, more = more
                next_seq += 1
                first_us = us if first_us is None else min(first_us, us)
                last_us = us if last_us is None else max(last_us, us)
                buffer += more
                window = bytes(tail) + bytes(more)
                ended = ended or _ends(window)
                # keep the line being written; a long one is no end marker, whatever follows
                tail = window[window.rfind(b"\n") + 1 :]
                tail = tail if len(tail) <= 256 else b"-"
                if len(buffer) >= self.piece_bytes:
                    yield self._piece(request_id, provider_type, piece, first_us, last_us, buffer, None)
                    piece, first_us, buffer = piece + 1, None, bytearray()
                more = waiting.take(next_seq)
        if ended and buffer and not closed:
            yield self._piece(request_id, provider_type, piece, first_us, last_us, buffer, None)
            piece, first_us, buffer = piece + 1, None, bytearray()
        due = max(newest, timerValues.getCurrentWatermarkInMs()) + self.timeout_ms
        if found is None:
            self.handle.registerTimer(due)
        self.open.update(
            (provider_type, next_seq, piece, first_us, last_us, bytes(buffer), bytes(tail), ended, closed, newest, due)
            + waiting.fields()
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """No more chunks: hand on what is there, also behind a gap, and close; the second time forget the request."""
        found, now = self.open.get(), timerValues.getCurrentWatermarkInMs()
        if found is None:
            return
        provider_type, next_seq, piece, first_us, last_us, data, tail, ended, closed, newest, due, *held = tuple(found)
        if due > now:
            self.handle.registerTimer(due)
            return
        if closed:
            self.open.clear()
            return
        buffer, gap = bytearray(data), False
        for us, more in Waiting(*held, self.waiting).drain():
            first_us = us if first_us is None else min(first_us, us)
            last_us = us if last_us is None else max(last_us, us)
            buffer += more
            gap = True
        yield self._piece(key[0], provider_type, piece, first_us, last_us, buffer, ended and not gap)
        due = now + self.timeout_ms
        self.open.update(
            (provider_type, next_seq, piece + 1, None, last_us, b"", b"", ended, True, newest, due, None, 0)
        )
        self.handle.registerTimer(due)

    def _piece(self, request_id, provider_type, piece, first_us, last_us, data, complete, late=False) -> Row:
        return Row(
            request_id=request_id,
            provider_type=provider_type,
            seq=piece,
            first_us=first_us,
            last_us=last_us,
            data=bytes(data),
            last=complete is not None,
            complete=complete,
            late=late,
        )

    def close(self) -> None:
        pass


def assemble(
    chunks: DataFrame, delay: str = "1 minute", timeout_s: int = 600, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """Streaming ``chunks`` to ordered pieces.

    A response is closed ``timeout_s`` after its last chunk (in event time) by a last piece, which says if it had an end
    marker and no gap (``complete``). Chunks that come after that go out as they are, as pieces with ``late`` true.
    Chunks behind a missing one wait in the state until it comes or the response is closed. Copies are left out.
    """
    # this kind of state needs the RocksDB store
    use_state_store(chunks.sparkSession)
    rows = (
        chunks.withWatermark("ts", delay)
        .withColumn("us", F.unix_micros("ts"))
        .groupBy("request_id")
        .transformWithState(
            statefulProcessor=Assembler(timeout_s * 1000, piece_bytes),
            outputStructType=_ROW,
            outputMode="append",
            timeMode="EventTime",
        )
    )
    times = {"first_ts": F.timestamp_micros("first_us"), "last_ts": F.timestamp_micros("last_us")}
    return rows.withColumns(times).select(*PIECES.names)


def as_chunks(pieces: DataFrame) -> DataFrame:
    """Pieces in the form the batch merge reads."""
    return pieces.select("request_id", "provider_type", "seq", F.col("last_ts").alias("ts"), "data")
