"""Exact dedup by progressive refinement: length, then a hash of a prefix, then a hash of everything.

Lengths and prefix hashes are a narrow table made in one scan. Only documents whose length and prefix hash occur twice
are read whole. Which these are reaches the second scan as a bitmap of fixed size (``FILTER_BITS`` bits, in chunks that
an equi-join brings to the rows), so no text of another document is hashed or moved. A false positive of the bitmap
only costs the hash of one more text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import packed, stored, unpacked

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
PREFIX = 64
CHUNK_BITS = 32768
FILTER_BITS = 1 << 27


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _bit(length: Column, prefix: Column) -> Column:
    return F.pmod(F.xxhash64(length, prefix), F.lit(FILTER_BITS))


def _refined(rows: DataFrame) -> DataFrame:
    """Bitmap chunks of the (length, prefix hash) pairs that occur twice or more."""
    narrow = stored(rows.select("_length", "_prefix"), "prefixes")
    lengths = narrow.groupBy("_length").agg(F.count("*").alias("n")).filter("n > 1").select("_length")
    pairs = (
        narrow.groupBy("_length", "_prefix")
        .agg(F.count("*").alias("n"))
        .join(lengths, "_length", "left_semi")
        .filter("n > 1")
        .select(_bit(F.col("_length"), F.col("_prefix")).alias("bit"))
    )
    return stored(
        pairs.groupBy(F.floor(F.col("bit") / CHUNK_BITS).alias("_chunk")).agg(
            F.bitmap_construct_agg(F.col("bit") % CHUNK_BITS).alias("_bits")
        ),
        "bitmap",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``keep_id, group_size, kept, full_hash``.

    Texts are equal when they are identical without ASCII white space. Of equal texts the one with the most code points
    stays, then the smallest id, then the smallest hash of the text as written. ``full_hash`` (SHA-256 of the
    normalised text) is null where length and prefix already told a text from all others.

    Null text: empty, so all null, empty and blank texts are one group. Null id: after all others. Rows that agree in
    id and text are one document written twice: each has ``kept`` true (``exact_dedup`` returns one) and counts in
    ``group_size``. Empty input: no rows. Other columns pass through; those named like the new ones are replaced.
    """
    text, given = docs[text_col], docs[id_col].cast("long")
    clean = normalised(text)
    rows = packed(
        docs,
        _id=given,
        _size=F.char_length(F.coalesce(text, F.lit(""))),
        _written=F.xxhash64(F.coalesce(text, F.lit(""))),
        _length=F.octet_length(clean),
        _prefix=F.xxhash64(F.substring(clean, 1, PREFIX)),
        _clean=clean,
    )
    bit = _bit(F.col("_length"), F.col("_prefix"))
    place = bit % CHUNK_BITS
    flags = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    flagged = (
        rows.withColumn("_chunk", F.floor(bit / CHUNK_BITS))
        .join(F.broadcast(_refined(rows)), "_chunk", "left")
        .withColumn("_again", F.coalesce(F.call_function("getbit", flags, (place % 8).cast("int")) == 1, F.lit(False)))
        .drop("_bits", "_chunk")
    )
    alone = flagged.filter(~F.col("_again"))
    several = flagged.filter("_again").withColumn("_hash", F.sha2("_clean", 256)).drop("_clean")
    order = F.struct((-F.col("_size")).alias("shorter"), F.col("_id").isNull().alias("unnamed"), "_id", "_written")
    best = several.groupBy("_hash").agg(F.count("*").alias("_n"), F.min(order).alias("_best"))
    judged = several.join(best, "_hash")
    new = ["keep_id", "group_size", "kept", "full_hash"]
    columns = docs.columns
    first = unpacked(
        alone, columns, keep_id=F.col("_id"), group_size=F.lit(1).cast("long"), kept=F.lit(True), full_hash=F.lit(None).cast("string")
    )
    rest = unpacked(
        judged,
        columns,
        keep_id=F.col("_best")["_id"],
        group_size=F.col("_n"),
        kept=order.eqNullSafe(F.col("_best")),
        full_hash=F.col("_hash"),
    )
    assert first.columns == rest.columns and set(new) <= set(first.columns)
    return first.union(rest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; a row written twice stays once."""
    judged = exact_groups(packed(docs, id=docs[id_col], text=docs[text_col]), "id", "text")
    single = judged.filter("kept AND full_hash IS NULL")
    several = judged.filter("kept AND full_hash IS NOT NULL").dropDuplicates(["id", "full_hash"])
    return unpacked(single.union(several), docs.columns)
