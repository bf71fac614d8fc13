"""Suffix-array dedup: every byte covered by a string of a minimum length that occurs at two places is removed.

A suffix array of the whole corpus fits no machine, so the suffixes are dealt out such that equal strings meet:

1. Every window of ``least`` bytes is named by its smallest 32-byte hash (its anchor). Consecutive windows with the
   same anchor form a stretch; equal windows of any two documents always lie in stretches with equal anchors. Only a row
   per stretch leaves the task: document, place, anchor and a 128-bit hash of its bytes.
2. Stretches are counted by content. One that occurs twice is covered as a whole. An anchor with a single stretch has
   no repeat. What is left are anchors with several different stretches, which may overlap in part.
3. Of these, one text per distinct stretch goes to a shard by anchor. There a stretch that shares with no other the
   bytes that all its windows with about the same place of the anchor have in common is left out: none of its windows
   can be repeated. Of the others each shard sorts the suffixes, forms the Burrows-Wheeler transform, and expands
   intervals breadth-first, by increasing common prefix, up to ``least``; what is not separated by then is repeated
   (see ``bwt``).
4. Covered ranges go back to their documents.

An anchor whose different stretches exceed a shard's size (a passage shorter than ``least`` in a third of all
documents, say) takes another exact way: its windows are counted by 128-bit hash over all executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm import bwt, hashing
from gatelens.llm.common import blocks, buffers, keyed, partitions, plain_id, stored

GRAM = 32
PART = 256
SHARD_BYTES = 1 << 20
CORES = 4
_SEGMENT = 1 << 17  # bytes hashed at a time: the arrays of a step stay in a core's cache
_PLACE = (1 << 20) - 1
STRETCH = ["anchor", "h1", "h2"]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, values
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def stretches(data: np.ndarray, valid: np.ndarray, least: int):
    """Start, number of windows, anchor and two content hashes of every stretch of valid windows."""
    codes = [hashing.lane_of(k)["table"][data] for k in (0, 1)]
    grams = hashing.mix(hashing.rolling(codes[0], GRAM, hashing.lane_of(0)["step"]))
    places = np.arange(len(grams), dtype=np.uint64)
    lowest = _sliding_min((grams & ~np.uint64(_PLACE)) | places, least - GRAM + 1)
    at = (lowest & np.uint64(_PLACE)).astype(np.int64)
    edge = np.ones(len(at) + 1, bool)
    edge[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(edge[:-1] & valid)
    runs = np.flatnonzero(edge[1:] & valid) - starts + 1
    sizes = runs + least - 1
    # a stretch has 2 * least - GRAM bytes at most; parts at every PART bytes and at its end leave none out
    steps = max(3, -(-(2 * least - GRAM) // PART))
    places = [starts + np.minimum(k * PART, sizes - PART) for k in range(1, steps)]
    hashes = []
    for lane, own in enumerate(codes):
        part = hashing.rolling(own, PART, hashing.lane_of(lane)["step"])
        whole = hashing.mix(part[starts] + sizes.astype(np.uint64))
        for place in places:
            whole = hashing.mix(whole * np.uint64(0x9E3779B97F4A7C15) + part[place])
        hashes.append(whole)
    return starts, runs, grams[at[starts]], hashes


def _pieces(data: np.ndarray, offsets: np.ndarray, least: int):
    """(bytes, valid windows, place of the first byte): groups of documents, or overlapping segments of a long one."""
    sizes = np.diff(offsets)
    for low, high in blocks(sizes, _SEGMENT):
        a, b = int(offsets[low]), int(offsets[high])
        if b - a <= _SEGMENT:
            if b - a >= least:
                edge = np.zeros(b - a + 1, np.int64)
                own = np.arange(low, high)[sizes[low:high] >= least]
                edge[offsets[own] - a] += 1
                edge[offsets[own] - a + sizes[own] - least + 1] -= 1
                yield data[a:b], np.cumsum(edge)[: b - a - least + 1] > 0, a
        else:
            for c in range(a, b - least + 1, _SEGMENT - least + 1):
                part = data[c : min(b, c + _SEGMENT)]
                yield part, np.ones(len(part) - least + 1, bool), c


def _found(least: int):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for part, valid, base in _pieces(data, offsets, least):
                starts, runs, anchors, (h1, h2) = stretches(part, valid, least)
                if not len(starts):
                    continue
                owner = np.searchsorted(offsets, starts + base, "right") - 1
                order = np.lexsort((starts, h2, h1, owner))
                first = np.ones(len(order), bool)
                for values in (owner, h1, h2):
                    ordered = values[order]
                    if values is owner:
                        first[1:] = ordered[1:] != ordered[:-1]
                    else:
                        first[1:] |= ordered[1:] != ordered[:-1]
                lead = order[first]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(np.flatnonzero(first), len(order)).astype(np.int32)),
                    pa.array((starts + base - offsets[owner])[order].astype(np.int32)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[owner[lead]]),
                        pa.array(keys[owner[lead]]),
                        pa.array(anchors[lead].view(np.int64)),
                        pa.array(h1[lead].view(np.int64)),
                        pa.array(h2[lead].view(np.int64)),
                        pa.array(runs[lead].astype(np.int32)),
                        lists,
                    ],
                    names=["_id", "_key", "anchor", "h1", "h2", "run", "starts"],
                )

    return run


def related(data: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, least: int) -> np.ndarray:
    """Mask of the stretches that may have a window in common with another one.

    Equal windows have the anchor at the same place. Windows with it at ``low`` to ``low + width`` all hold the
    ``least - width`` bytes (a core) from ``low`` before the anchor on, so a stretch of which no core occurs twice has no
    window that does. Unequal cores of one hash leave more stretches in, never fewer.
    """
    own = hashing.lane_of(0)
    width = -(-(least - GRAM) // CORES)
    owners, cores = [], []
    for a, b in blocks(np.diff(offsets), _SEGMENT):
        begins, ends = offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a]
        codes = own["table"][data[offsets[a] : offsets[b]]]
        grams = hashing.mix(hashing.rolling(codes, GRAM, own["step"]))
        parts = hashing.rolling(codes, least - width, own["step"])
        hits = np.flatnonzero(grams == np.repeat(anchors[a:b], ends - begins)[: len(grams)])
        # the anchor is the first such gram: the windows of a stretch have one anchor, the leftmost of equal ones
        at = hits[np.searchsorted(hits, begins)]
        for k in range(CORES):
            low = k * width
            here = np.flatnonzero((at - begins >= low) & (at - (ends - least) <= low + width))
            owners.append(here + a)
            cores.append(hashing.mix(parts[at[here] - low] + np.uint64(k)))
    owner, core = np.concatenate(owners), np.concatenate(cores)
    mask = np.zeros(len(anchors), bool)
    mask[owner[hashing.repeated(core)]] = True
    return mask


def _shard(least: int):
    """Repeated windows of the stretches of a shard, as places within their stretch."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data, offsets = buffers(table.column("body").combine_chunks())
        anchors = table.column("anchor").to_numpy().view(np.uint64)
        found = [np.zeros(0, np.int64)] * len(anchors)
        left = np.flatnonzero(related(data, offsets, anchors, least))
        if len(left):
            texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in left]
            for i, places in zip(left, bwt.repeated_starts(texts, least)):
                found[i] = places
        return pa.table(
            {c: table.column(c) for c in STRETCH}
            | {"copies": table.column("copies"), "within": pa.array(found, pa.list_(pa.int32()))}
        )

    return run


def _windows(least: int):
    """A row per window of a stretch."""

    def run(batches):
        for batch in batches:
            names = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*STRETCH, "copies")]
            for i, body in enumerate(batch.column("body").to_pylist()):
                data = np.frombuffer(body, np.uint8)
                hashes = []
                for lane in (0, 1):
                    own = hashing.lane_of(lane)
                    hashes.append(hashing.mix(hashing.rolling(own["table"][data], least, own["step"])).view(np.int64))
                count = len(hashes[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.full(count, n[i])) for n in names),
                        *map(pa.array, hashes),
                        pa.array(np.arange(count, dtype=np.int32)),
                    ],
                    names=[*STRETCH, "copies", "w1", "w2", "place"],
                )

    return run


def _covered(batches):
    for batch in batches:
        bodies = batch.column("_text")
        data, offsets = buffers(bodies)
        lists = batch.column("spans")
        lists = lists.cast(pa.large_list(lists.type.value_type))
        edges = lists.offsets.to_numpy()
        at, size = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        n_removed, n_spans, spans, kept = [], [], [], []
        for i in range(len(bodies)):
            own = data[offsets[i] : offsets[i + 1]]
            a, b = edges[i], edges[i + 1]
            if a == b:
                n_removed.append(0), n_spans.append(0), spans.append([]), kept.append(own.tobytes())
                continue
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, at[a:b], 1)
            np.add.at(edge, at[a:b] + size[a:b], -1)
            gone = np.cumsum(edge[:-1]) > 0
            change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            n_removed.append(int(gone.sum()))
            n_spans.append(len(change) // 2)
            spans.append([{"start": int(s), "end": int(e)} for s, e in change.reshape(-1, 2)])
            kept.append(own[~gone].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                pa.array(np.diff(offsets)),
                pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()),
                pa.array(spans, kind),
                pa.array(kept, pa.binary()),
            ],
            names=["_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
        )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, spans, kept`` for every row of ``docs``.

    Texts are UTF-8 bytes. A byte goes if any string of ``least`` bytes over it (``least`` is 256 or more) starts at
    another place too, in the same document or another, overlapping or not; matches never cross documents and are those
    of the input. ``spans`` are the maximal removed ranges, ``kept`` the remaining bytes.

    Null text: empty. Null ids and repeated ids: every row is a document of its own, so a repeated row is removed
    where it is long enough. Texts shorter than ``least`` stay whole. Empty input: no rows. Other columns play no part.
    """
    if not PART <= least <= 2 * PART + GRAM - 1:
        raise ValueError(f"least must lie between {PART} and {2 * PART + GRAM - 1}")
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col, by_text=True)
    runs = stored(
        rows.select("_text", "_id", "_key").mapInArrow(
            _found(least), "_id long, _key long, anchor long, h1 long, h2 long, run int, starts array<int>"
        ),
        "stretches",
    )
    kinds = stored(
        runs.groupBy(*STRETCH).agg(
            F.sum(F.size("starts")).alias("copies"),
            F.max("run").alias("run"),
            F.first("_id").alias("_id"),
            F.first("_key").alias("_key"),
            F.first(F.col("starts")[0]).alias("at"),
        ),
        "kinds",
    )
    anchors = kinds.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.sum("copies").alias("total"), F.sum(F.col("run") + (least - 1)).alias("volume")
    )
    known = stored(kinds.join(anchors.filter("total > 1"), "anchor"), "anchors")

    partly = known.filter("kinds > 1")
    volume = partly.filter(F.col("volume") <= SHARD_BYTES).agg(F.sum(F.col("run") + (least - 1))).first()[0] or 0
    shards = max(2 * partitions(spark), -(-volume // SHARD_BYTES))
    wanted = partly.groupBy("_id", "_key").agg(
        F.collect_list(F.struct(*STRETCH, "copies", "run", "at", "volume")).alias("wanted")
    )
    body = F.encode("_text", "UTF-8")
    texts = stored(
        rows.join(wanted, ["_id", "_key"])
        .select(
            F.explode(
                F.transform(
                    "wanted",
                    lambda w: F.struct(
                        *(w[c].alias(c) for c in (*STRETCH, "copies", "volume")),
                        F.substring(body, w["at"] + 1, w["run"] + (least - 1)).alias("body"),
                    ),
                )
            ).alias("w")
        )
        .select("w.*"),
        "texts",
    )
    by_shard = (
        texts.filter(F.col("volume") <= SHARD_BYTES)
        .select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), *STRETCH, "copies", "body")
        .groupBy("shard")
        .applyInArrow(_shard(least), "anchor long, h1 long, h2 long, copies long, within array<int>")
        .filter((F.col("copies") == 1) & (F.size("within") > 0))
        .select(*STRETCH, "within")
    )
    windows = (
        texts.filter(F.col("volume") > SHARD_BYTES)
        .select(*STRETCH, "copies", "body")
        .mapInArrow(
            _windows(least), "anchor long, h1 long, h2 long, copies long, w1 long, w2 long, place int"
        )
    )
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    by_window = (
        windows.filter("copies = 1").join(again, ["w1", "w2"]).groupBy(*STRETCH).agg(F.collect_list("place").alias("within"))
    )
    marks = known.filter("copies > 1").select(*STRETCH, F.lit(None).cast("array<int>").alias("within"))
    marks = stored(marks.unionByName(by_shard).unionByName(by_window), "marks")

    def spans(start):
        whole = F.array(F.struct(start.alias("at"), (F.col("run") + (least - 1)).alias("size")))
        parts = F.transform(
            "within", lambda w: F.struct((start + w).alias("at"), F.lit(least).alias("size"))
        )
        return F.when(F.col("within").isNull(), whole).otherwise(parts)

    covered = stored(
        runs.join(marks, STRETCH)
        .select("_id", "_key", F.flatten(F.transform("starts", spans)).alias("spans"))
        .groupBy("_id", "_key")
        .agg(F.flatten(F.collect_list("spans")).alias("spans")),
        "covered",
    )
    nothing = F.array().cast("array<struct<at:int,size:int>>")
    return (
        rows.join(covered, ["_id", "_key"], "left")
        .select("_id", "_text", F.coalesce("spans", nothing).alias("spans"))
        .mapInArrow(
            _covered,
            "_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary",
        )
        .select(plain_id(id_col), "n_bytes", "n_removed", "n_spans", "spans", "kept")
    )
