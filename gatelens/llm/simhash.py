"""SimHash near-dedup: fingerprints linked at a few differing bits, found by vantage-point trees.

Distinct fingerprints are split by their distance to a vantage point: those within its radius go inside, all others
outside. By the triangle bound, partners on either side of a radius ``m`` lie at distances in ``(m - r, m]`` and
``(m, m + r]``; the outer ones of these are copied inside, so every pair within ``r`` meets on one side. A tree made from
a bounded sample deals the fingerprints to shards; each shard goes on with vantage points of its own until the rest is
small enough to compare. Only links that join something new leave a shard: a star per component found there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import buffers, packed, partitions, plain_id, stored, unpacked
from gatelens.llm.components import components

SAMPLE = 1 << 16
SHARD = 1 << 13
MOST_SHARDS = 1 << 14
LEAF = 512
SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """Bits set in more than half of the hashes of all word shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for low in range(0, len(starts), _BLOCK):
        pairs = zip(starts[low : low + _BLOCK].tolist(), ends[low : low + _BLOCK].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(texts: pa.Array) -> pa.Array:
        data, offsets = buffers(texts)
        values = [fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())

    return run


def distances(prints: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ point)


def _split(prints: np.ndarray, radius: int):
    """Vantage point, its radius, and who is inside, outside, and outside but near; None if nothing is gained.

    Of a few evenly spaced vantage points the one that leaves the smaller larger side is taken.
    """
    best = None
    for point in prints[:: max(1, len(prints) // 5)][:5]:
        far = distances(prints, point)
        middle = int(np.median(far))
        for m in (middle - 1, middle):
            inside = int((far <= m + radius).sum())
            outside = int((far > m).sum())
            if outside and inside and (best is None or max(inside, outside) < best[0]):
                best = (max(inside, outside), point, m)
    if best is None or best[0] > 0.9 * len(prints):
        return None
    return best[1], best[2]


def tree(sample: np.ndarray, depth: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (point, radius, inside, outside); a child below zero is shard ``-1 - child``."""
    nodes: list = []
    shards = 0

    def grow(prints: np.ndarray, left: int) -> int:
        nonlocal shards
        cut = _split(prints, radius) if left and len(prints) > 8 else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        point, m = cut
        far = distances(prints, point)
        inside, outside = grow(prints[far <= m + radius], left - 1), grow(prints[far > m], left - 1)
        nodes[at] = (int(point), m, inside, outside)
        return at

    grow(sample, depth)
    return nodes


def _dealt(nodes: list, radius: int):
    """Every fingerprint with every shard it belongs to."""

    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            waiting = [(0 if nodes else -1, prints)]
            while waiting:
                at, own = waiting.pop()
                if at < 0:
                    shard = np.full(len(own), -1 - at, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(own.view(np.int64))], names=["shard", "print"])
                elif len(own):
                    point, m, inside, outside = nodes[at]
                    far = distances(own, np.uint64(point))
                    waiting += [(inside, own[far <= m + radius]), (outside, own[far > m])]

    return run


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the sets of i and j; every label is the smallest member of its set."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def linked(prints: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints the index of the first one of their component within ``radius``."""
    labels = np.arange(len(prints))
    waiting = [labels.copy()]
    while waiting:
        own = waiting.pop()
        cut = _split(prints[own], radius) if len(own) > LEAF else None
        if cut:
            point, m = cut
            far = distances(prints[own], point)
            waiting += [own[far <= m + radius], own[far > m]]
            continue
        for low in range(0, len(own), LEAF):
            for right in range(low, len(own), 1 << 14):
                a, b = own[low : low + LEAF], own[right : right + (1 << 14)]
                i, j = np.nonzero(np.bitwise_count(prints[a][:, None] ^ prints[b][None, :]) <= radius)
                _join(labels, a[i], b[j])
    return labels


def _stars(radius: int):
    def run(table: pa.Table) -> pa.Table:
        prints = np.unique(table.column("print").to_numpy())
        labels = linked(prints.view(np.uint64), radius)
        other = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"a": prints[other], "b": prints[labels[other]]})

    return run


def near_links(prints: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``print``) that connect what is within ``radius`` bits."""
    total = prints.count()
    shards = min(MOST_SHARDS, max(partitions(prints.sparkSession), -(-total // SHARD)))
    share = min(1.0, SAMPLE / max(1, total))
    sample = prints.sample(share, seed=7) if share < 1 else prints
    points = np.array([r[0] for r in sample.limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    nodes = tree(np.sort(points), max(0, (shards - 1).bit_length()), radius)
    return (
        prints.mapInArrow(_dealt(nodes, radius), "shard int, print long")
        .groupBy("shard")
        .applyInArrow(_stars(radius), "a long, b long")
    )


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (``_id``, ``_print``) to ``_print, _component``: the smallest id of everything reachable."""
    prints = stored(rows.groupBy("_print").agg(F.min("_id").alias("_least")), "prints")
    links = near_links(prints.select(F.col("_print").alias("print")), radius)
    found = stored(components(links), "components")
    led = prints.join(found, prints["_print"] == found["node"], "left").select(
        "_print", "_least", F.coalesce("component", "_print").alias("_root")
    )
    led = stored(led, "roots")
    least = led.groupBy("_root").agg(F.min("_least").alias("_component"))
    return led.join(least, "_root").select("_print", "_component")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """``id, print, component_id`` for every row of ``docs``.

    ASCII capitals are lowered, words are runs of anything but the six ASCII white-space characters, shingles are
    ``shingle`` words joined by a space (a shorter text is one shingle), hashed by XXH64 with seed 42. A bit of
    ``print`` is 1 if set in more than half of the hashes. Documents whose prints differ in at most ``radius`` bits are
    linked; ``component_id`` is the smallest id reachable.

    Null text or no word: print 0, linked like any other. Null id: counts as larger than all others, and the component
    of nothing but null ids is null. Repeated rows: equal prints, one component. Empty input: no rows. Other columns
    play no part.
    """
    from gatelens.llm.common import LAST_ID

    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)).alias("_id"),
        F.arrow_udf(_fingerprints(shingle), "long")(text).alias("_print"),
    )
    rows = stored(rows, "fingerprints")
    return rows.join(_labelled(rows, radius), "_print").select(
        plain_id(id_col),
        F.col("_print").alias("print"),
        F.when(F.col("_component") < LAST_ID, F.col("_component")).alias("component_id"),
    )


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """One row of ``docs`` per component, with its columns: that of the smallest id.

    Rows with the same smallest id: the smallest hash of the text stays; fully repeated rows are one document.
    """
    from gatelens.llm.common import LAST_ID

    text = F.coalesce(docs[text_col], F.lit(""))
    id_, hashed = F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)), F.xxhash64(text)
    rows = docs.select(
        id_.alias("_id"), hashed.alias("_text"), F.arrow_udf(_fingerprints(shingle), "long")(text).alias("_print")
    )
    rows = stored(rows, "fingerprints")
    best = (
        rows.join(_labelled(rows, radius), "_print")
        .groupBy("_component")
        .agg(F.min(F.struct("_id", "_text")).alias("_best"))
        .select("_best.*")
    )
    return unpacked(
        packed(docs, _id=id_, _text=hashed).join(best, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]),
        docs.columns,
    )
