"""Shared steps: stored intermediate tables, row identity, columns that cannot clash, text buffers inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.session import scratch_path

LAST_ID = (1 << 63) - 1
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table that later jobs read to the shared scratch folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation beyond it; the shuffle files of the job that made
    the table are released when it ends. Texts reach Python in small batches, which bounds a worker's memory.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with settings(spark, {_CLEANUP: "true", _BATCH: str(BATCH_BYTES)}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str, by_text: bool = False) -> DataFrame:
    """``_id, _key, _text``: the id (null becomes the largest long), a key beside it, the text (null becomes empty).

    The key tells rows without an id apart by their text; with ``by_text`` also rows that share an id. Rows that agree
    in all three have the same result everywhere.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    given = docs[id_col].cast("long")
    return docs.select(
        F.coalesce(given, F.lit(LAST_ID)).alias("_id"),
        (F.xxhash64(text) if by_text else F.coalesce(given, F.xxhash64(text))).alias("_key"),
        text.alias("_text"),
    )


def plain_id(name: str) -> Column:
    """The id as it was given."""
    return F.when(F.col("_id") < LAST_ID, F.col("_id")).alias(name)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``_row`` beside new columns: no name of the input can clash with them."""
    return docs.select(
        F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("_row"),
        *[value.alias(name) for name, value in columns.items()],
    )


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The input's columns, then the new ones; an input column of a new one's name gives way to it."""
    names = {n.lower() for n in new}
    return df.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in columns if c.lower() not in names],
        *[value.alias(name) for name, value in new.items()],
    )


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column without nulls."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` units together; a larger row stands alone."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + most, "right")))
        yield low, high
        low = high


def worker_state(name: str, make):
    """An object kept by the Python worker from task to task."""
    import sys
    import types

    home = sys.modules.setdefault("_gatelens_worker", types.ModuleType("_gatelens_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
