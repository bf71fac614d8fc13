"""Best-fit packing by vectors: documents are tokenised, cut, and packed into sequences of a fixed capacity.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths). Pieces, longest
first, go to the open sequence that has room in every one of them and fits best: by the smallest weighted norm of what
would be left (``norm``), or by the largest weighted dot product of need and room (``dot``). Pieces are dealt by hash to
shards of a fixed expected size, so at most the last sequence of a shard is worse filled than in one global run.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm import tokens
from gatelens.llm.common import stored

SHARD_PIECES = 1 << 14


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence; documents and attention default to what the tokens allow anyway.

    Attention may be below the square of the tokens: a piece then is at most as long as its own attention allows.
    """

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"

    def limits(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        attention = self.tokens**2 if self.attention is None else self.attention
        if self.tokens < 1 or documents < 1 or attention < 1:
            raise ValueError("a sequence must have room for a piece of one token")
        return np.array([self.tokens, documents, attention], np.float64)

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that a sequence can hold."""
        return self.tokens if self.attention is None else min(self.tokens, isqrt(self.attention))


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece; lengths must fall and be at least 1."""
    limits = capacity.limits()
    weights = np.array(capacity.weights)
    places, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, names = np.zeros((64, 3)), np.zeros(64, np.int64)
    used = made = 0
    smallest = int(lengths[-1]) if len(lengths) else 0
    need = np.stack([lengths, np.ones_like(lengths), lengths.astype(np.float64) ** 2], 1) / limits
    floor = np.array([smallest, 1, smallest**2]) / limits - 1e-12
    for i, want in enumerate(need):
        left = room[:used] - want
        fits = np.flatnonzero((left >= -1e-12).all(axis=1))
        if len(fits):
            if capacity.score == "norm":
                at = fits[np.argmin((left[fits] ** 2) @ weights)]
            else:
                at = fits[np.argmax((room[fits] * want) @ weights)]
        else:
            if used == len(room):
                room, names = np.concatenate([room, np.zeros_like(room)]), np.concatenate([names, np.zeros_like(names)])
            at, used = used, used + 1
            room[at], names[at] = 1.0, made
            made += 1
        places[i] = names[at]
        offsets[i] = round((1.0 - room[at, 0]) * limits[0])
        room[at] -= want
        if (room[at] < floor).any():
            used -= 1
            room[at], names[at] = room[used], names[used]
    return places, offsets


def _cut(path: str, most: int, last_id: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            ids, ends = tokens.encoded(batch.column("_text"), path)
            rows, piece, start, length, crc, body = [], [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(last_id)).astype("<u4")
                for n, low in enumerate(range(0, len(own), most)):
                    raw = own[low : low + most].tobytes()
                    rows.append(i)
                    piece.append(n)
                    start.append(low)
                    length.append(len(raw) // 4)
                    crc.append(zlib.crc32(raw))
                    body.append(raw)
            columns = [
                batch.column("_id").take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(body, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _placed(capacity: Capacity):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        places, offsets = best_fit(table.column("length").to_numpy(), capacity)
        base = table.column("shard")[0].as_py() << 32
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(places + base)).append_column(
            "offset", pa.array(offsets)
        )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: Capacity = Capacity(),
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """A row per piece: ``id, piece, start, length, ids_crc32, ids, sequence_id, offset``.

    A document is its ids by the tokenizer file (no special tokens added), then ``end_id``. Longer ones than a sequence
    can hold (``capacity.longest``) are cut into pieces of that length, the last of which may be shorter. ``start`` counts the ids of the document before
    the piece, ``offset`` the ids of the sequence before it; a sequence has no gaps. ``ids``: unsigned 32-bit,
    little-endian; left out unless ``with_ids``.

    Null text: empty, so the end id alone. Null ids and repeated rows: each row is a document of its own. Empty input: no
    rows. Other columns play no part.
    """
    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    columns = "_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = stored(rows.mapInArrow(_cut(tokenizer, capacity.longest, end_id, with_ids), columns), "pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    shard = F.pmod(F.xxhash64("_id", "piece", "length", "ids_crc32"), F.lit(shards)).cast("int").alias("shard")
    placed = (
        pieces.select("*", shard)
        .groupBy("shard")
        .applyInArrow(_placed(capacity), columns + ", sequence_id long, offset long")
    )
    return placed.select(F.col("_id").alias(id_col), *[c for c in placed.columns if c != "_id"])


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_pieces, length, ids``: the sequences themselves, from ``pack`` with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.count("*").alias("n_pieces"),
        F.sum("length").alias("length"),
        F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"])).alias("ids"),
    )
