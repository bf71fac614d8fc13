"""Chunks of one request that wait for a missing one.

A call of a stateful processor asks the state store over a socket, so each question costs more than the work on a chunk.
Waiting chunks are therefore a list in the request's own row, read and written once a call, up to ``LISTED_BYTES``; what
goes beyond that is in a map, a chunk at a time, so that no row grows with the response.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import types as T

# travels to the workers with the processors, so they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTED_BYTES = 1 << 16
_ROW_BYTES = 64  # what a chunk takes beside its data

SEQ = T.StructType([T.StructField("seq", T.LongType())])
CHUNK = T.StructType([T.StructField("us", T.LongType()), T.StructField("data", T.BinaryType())])
# fields of the request's row
FIELDS = [
    T.StructField("listed", T.ArrayType(T.StructType([*SEQ.fields, *CHUNK.fields]))),
    T.StructField("in_map", T.LongType()),
]


class Waiting:
    """Opened from the two fields of the request's row and the map; ``fields`` gives them back."""

    def __init__(self, listed, in_map: int | None, store) -> None:
        self.listed = {seq: (us, bytes(data)) for seq, us, data in listed or ()}
        self.size = sum(len(data) + _ROW_BYTES for _, data in self.listed.values())
        self.in_map, self.store = in_map or 0, store

    def fields(self) -> tuple[list, int]:
        return [(seq, us, data) for seq, (us, data) in self.listed.items()], self.in_map

    def add(self, seq: int, us: int, data: bytes) -> None:
        """A copy of a chunk that waits is left out."""
        if seq in self.listed or (self.in_map and self.store.containsKey((seq,))):
            return
        size = len(data) + _ROW_BYTES
        if self.size + size <= LISTED_BYTES:
            self.listed[seq] = (us, data)
            self.size += size
        else:
            self.store.updateValue((seq,), (us, data))
            self.in_map += 1

    def take(self, seq: int):
        """The chunk's time and data, or None if it is not here."""
        found = self.listed.pop(seq, None)
        if found is not None:
            self.size -= len(found[1]) + _ROW_BYTES
        elif self.in_map and self.store.containsKey((seq,)):
            found = self.store.getValue((seq,))
            self.store.removeKey((seq,))
            self.in_map -= 1
        return found

    def drain(self) -> Iterator[tuple]:
        """All chunks in their order, which are then gone."""
        keys = [tuple(k)[0] for k in self.store.keys()] if self.in_map else []
        for seq in sorted([*self.listed, *keys]):
            yield self.listed[seq] if seq in self.listed else self.store.getValue((seq,))
        if keys:
            self.store.clear()
        self.listed, self.size, self.in_map = {}, 0, 0
