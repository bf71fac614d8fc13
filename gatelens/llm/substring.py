"""Substring dedup: words covered by a window that also starts in a document with a smaller id are removed.

Three jobs over the documents, none of which moves a text between executors before the last:

1. Every partition counts the hashes of its windows in a count-min sketch (two rows, counters that stop at two) and
   emits it sparsely by slot; the slots are merged. A merged counter is never below the true count.
2. Only windows whose counters all reached two are emitted, as 128-bit hashes, and grouped exactly.
3. The same windows meet the groups; a document gets the windows that a smaller id has, and its words are cut.

The merged sketch is broadcast; its size is a sixteenth of the text's bytes, and at most ``2 * 2**max_width_bits / 8`` bytes
whatever the input. A sketch that is small for its input lets more unrepeated windows through to the exact step, and
changes nothing else.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm import hashing
from gatelens.llm.common import LAST_ID, blocks, buffers, keyed, partitions, plain_id, stored

ROWS = 2
#: Counters of a slot, which one task merges at a time; a sketch has as many slots as that makes.
SLOT_BITS = 18
#: Bytes of documents hashed at a time; a longer document is hashed alone. A worker's memory beside the sketch follows this
#: and the windows that it gathers before it emits them.
_GROUP = 1 << 19
_FLUSH = 1 << 19
_SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counter of every hash in a row of ``width`` counters."""
    high = hashing.mix(hashes ^ np.uint64(_SALTS[row])) >> np.uint64(32)
    return (high * np.uint64(width) >> np.uint64(32)).astype(np.uint32)


def document_windows(texts, width: int, lanes: tuple[int, ...]):
    """Per group of documents: (first row, owner of every window, its hashes)."""
    data, offsets = buffers(texts)
    for low, high in blocks(np.diff(offsets), _GROUP):
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        owner, codes = hashing.words(part, own, lanes)
        if len(owner) < width:
            continue
        inside = owner[: len(owner) - width + 1] == owner[width - 1 :]
        found = [hashing.rolling(c, width, hashing.lane_of(k)["step"])[inside] for k, c in zip(lanes, codes)]
        yield low, low + owner[: len(owner) - width + 1][inside], [hashing.mix(f) for f in found]


def _packed(cells: np.ndarray) -> bytes:
    """Ascending cells as gaps, split into byte planes."""
    gaps = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _slots(volume: int, max_width_bits: int) -> tuple[int, int]:
    """Bits of a cell within its slot, and the number of slots of a row: a cell for four bytes of text, over one a window."""
    slot_bits = min(max_width_bits, SLOT_BITS)
    return slot_bits, max(1, min(1 << (max_width_bits - slot_bits), -(-volume >> (slot_bits + 2))))


def _sketched(width: int, slot_bits: int, n_slots: int):

    def emit(kept: list[list[np.ndarray]]):
        slots, once, twice = [], [], []
        for row, parts in enumerate(kept):
            cells = np.concatenate(parts)
            parts.clear()
            cells.sort()
            first = np.ones(len(cells), bool)
            first[1:] = cells[1:] != cells[:-1]
            start = np.flatnonzero(first)
            many = np.diff(np.append(start, len(cells))) > 1
            cells = cells[start]
            borders = np.searchsorted(cells, np.arange(1, n_slots, dtype=np.uint64) << np.uint64(slot_bits))
            for slot, (own, flag) in enumerate(zip(np.split(cells, borders), np.split(many, borders))):
                if len(own):
                    own = own & np.uint32((1 << slot_bits) - 1)
                    slots.append(row * n_slots + slot)
                    once.append(_packed(own[~flag]))
                    twice.append(_packed(own[flag]))
        return pa.RecordBatch.from_arrays(
            [pa.array(slots, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
            names=["slot", "once", "twice"],
        )

    def run(batches):
        kept, held = [[] for _ in range(ROWS)], 0
        for batch in batches:
            for _, owner, (hashes,) in document_windows(batch.column(0), width, (0,)):
                hashes = hashes[hashing.without_repeats(hashes, owner)]
                for row in range(ROWS):
                    kept[row].append(_cells(hashes, row, n_slots << slot_bits))
                held += len(hashes)
                if held >= _FLUSH:
                    yield emit(kept)
                    kept, held = [[] for _ in range(ROWS)], 0
        if held:
            yield emit(kept)

    return run


def _merged(slot_bits: int):
    """Slots arrive sorted; one slot's counters are in memory at a time."""

    def run(batches):
        current, counters = None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([np.packbits(counters > 1).tobytes()], pa.binary())],
                names=["slot", "bits"],
            )

        for batch in batches:
            for slot, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if slot != current:
                    if current is not None:
                        yield done()
                    current, counters = slot, np.zeros(1 << slot_bits, np.uint8)
                at = _unpacked(once)
                counters[at] = np.minimum(counters[at] + 1, 2)
                counters[_unpacked(twice)] = 2
        if current is not None:
            yield done()

    return run


def sketch(docs: DataFrame, width: int, slot_bits: int, n_slots: int) -> np.ndarray:
    """Bits of the counters that reached two, one row of the sketch after the other."""
    spark = docs.sparkSession
    parts = docs.select("_text").mapInArrow(_sketched(width, slot_bits, n_slots), "slot int, once binary, twice binary")
    merged = stored(
        parts.repartition(min(ROWS * n_slots, 4 * partitions(spark)), "slot")
        .sortWithinPartitions("slot")
        .mapInArrow(_merged(slot_bits), "slot int, bits binary"),
        "sketch",
    )
    out = np.zeros((ROWS * n_slots, (1 << slot_bits) // 8), np.uint8)
    for row in merged.toLocalIterator():
        out[row["slot"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(ROWS, -1)


def _candidates(width: int, cells_of_row: int, shared):
    """Windows that every row of the sketch estimates as repeated, once per document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for _, owner, (first, second) in document_windows(batch.column(0), width, (0, 1)):
                keep = np.arange(len(first))
                for row in range(ROWS):
                    cells = _cells(first[keep], row, cells_of_row)
                    keep = keep[(shared.value[row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1]
                keep = keep[hashing.without_repeats(first[keep], owner[keep])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first[keep].view(np.int64)),
                        pa.array(second[keep].view(np.int64)),
                        pa.array(ids[owner[keep]]),
                        pa.array(keys[owner[keep]]),
                    ],
                    names=["h1", "h2", "_id", "_key"],
                )

    return run


def _cut(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            removed = batch.column("windows")
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(texts):
                words = [w.decode() for w in text.encode().split()]
                covered = np.zeros(len(words), bool)
                gone = removed[i].values
                if gone is not None:
                    gone = np.sort(gone.to_numpy(zero_copy_only=False).view(np.uint64))
                    one = batch.column("_text").slice(i, 1)
                    for _, _, (hashes,) in document_windows(one, width, (0,)):
                        edge = np.zeros(len(words) + 1, np.int64)
                        at = np.flatnonzero(hashing.members(hashes, gone))
                        edge[at] += 1
                        edge[at + width] -= 1
                        covered = np.cumsum(edge[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(covered.sum()))
                kept.append(" ".join(w for w, c in zip(words, covered.tolist()) if not c))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, max_width_bits: int = 29
) -> DataFrame:
    """``id, n_words, n_removed, kept_text`` for every row of ``docs``.

    A word is a run of anything but the six ASCII white-space characters. A word goes if any window of ``width``
    consecutive words over it has the same words as a window in a document with a smaller id; windows are those of the
    input. Kept words are joined by one space.

    Null text: no words. Null id: counts as larger than any other id (and as equal to the largest long), so such
    documents lose what others have and take nothing from each other. Rows with the same id take nothing from each
    other either. Texts shorter than a window stay whole. Empty input: no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    volume = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    slot_bits, n_slots = _slots(int(volume), max_width_bits)
    shared = spark.sparkContext.broadcast(sketch(rows, width, slot_bits, n_slots))

    found = rows.select("_text", "_id", "_key").mapInArrow(
        _candidates(width, n_slots << slot_bits, shared), "h1 long, h2 long, _id long, _key long"
    )
    groups = stored(
        found.groupBy("h1", "h2")
        .agg(F.min("_id").alias("least"), F.max("_id").alias("most"))
        .filter("least < most")
        .select("h1", "h2", "least"),
        "windows",
    )
    removed = stored(
        found.join(groups, ["h1", "h2"])
        .filter(F.col("_id") > F.col("least"))
        .groupBy("_id", "_key")
        .agg(F.collect_set("h1").alias("windows")),
        "removed",
    )
    shared.destroy()
    return (
        rows.join(removed, ["_id", "_key"], "left")
        .select("_text", "_id", "windows")
        .mapInArrow(_cut(width), "_id long, n_words long, n_removed long, kept_text string")
        .select(plain_id(id_col), "n_words", "n_removed", "kept_text")
    )


assert LAST_ID == np.iinfo(np.int64).max
