"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch holds every shingle hash below a fixed fraction of the hash range. So the sketch of a union is the union of the
sketches, sketches of very unequal documents compare without bias, and its size follows the document's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.llm.common import LAST_ID, plain_id, stored

SPACE = r"[\x20\x09-\x0D]+"
SHINGLE = 5
FRACTION = 8

#: Bits by which ids are grouped, level by level; together 64.
LEVELS = (12, 12, 12, 14, 14)

_LEAST = -(1 << 63)


def _word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), ""), lambda w: F.xxhash64(w))


def sketch(text: Column, words: int = SHINGLE, fraction: int = FRACTION) -> Column:
    """``struct(whole, hashes)``: a hash of the whole sequence of words, and all distinct shingle hashes in the lowest
    1/``fraction`` of the (signed) range, sorted.

    Shingles are ``words`` words long; a shorter text is one shingle. No words (null text too): no hashes, ``whole`` 0.
    ``whole`` makes equal sequences known as equal where no hash falls below the threshold, as in a text of a few words.
    """
    limit = _LEAST + (1 << 64) // fraction
    # hashes pass through nested lambdas: made once, then windows of them are hashed again
    of_words = F.transform(F.array(_word_hashes(text)), lambda own: F.struct(
        F.when(F.size(own) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(own)).alias("whole"),
        F.when(
            F.size(own) > 0,
            F.array_sort(F.array_distinct(F.filter(
                F.transform(
                    F.slice(own, 1, F.greatest(F.size(own) - (words - 1), F.lit(1))),
                    lambda h, i: F.xxhash64(h, *[F.get(own, i + k) for k in range(1, words)]),
                ),
                lambda h: h < limit,
            ))),
        ).otherwise(F.array().cast("array<long>")).alias("hashes"),
    ))
    return of_words[0]


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a["hashes"], b["hashes"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both: 1 for equal word sequences, else from the hashes; 0 where
    neither has any."""
    both = shared(a, b)
    union = F.size(a["hashes"]) + F.size(b["hashes"]) - both
    return F.when(a["whole"] == b["whole"], 1.0).when(union > 0, both / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; 1 for equal word sequences, 0 where ``a`` has no hash."""
    own = F.size(a["hashes"])
    return F.when(a["whole"] == b["whole"], 1.0).when(own > 0, shared(a, b) / own).otherwise(0.0)


def printed(s: Column) -> Column:
    """A sketch as text: 16 hex digits of ``whole``, then of each hash."""

    def digits(h: Column) -> Column:
        return F.lower(F.lpad(F.hex(h), 16, "0"))

    return F.concat(digits(s["whole"]), F.array_join(F.transform(s["hashes"], digits), ""))


def merged(sketches: DataFrame, key: str, column: str = "sketch") -> DataFrame:
    """``key, hash``: the sketch of all documents of a key together, a row per hash, for keys of any size."""
    return sketches.select(key, F.explode(f"{column}.hashes").alias("hash")).distinct()


def merged_containment(sketches: DataFrame, key: str, id_col: str, column: str = "sketch") -> DataFrame:
    """``id, key, share``: how much of a document's sketch each key's merged sketch holds (keys that share a hash).

    A document's hash meets as many rows as there are keys that hold it, at most one per key.
    """
    own = sketches.select(id_col, F.size(f"{column}.hashes").alias("_n"), F.explode(f"{column}.hashes").alias("hash"))
    met = own.join(merged(sketches, key, column), "hash")
    return met.groupBy(id_col, "_n", key).count().select(id_col, key, (F.col("count") / F.col("_n")).alias("share"))


def successors(ids: DataFrame) -> DataFrame:
    """``_id, _next``: every distinct long id and the next larger one; after the largest comes the smallest.

    Ids are grouped by their upper bits, these groups by their upper bits again, and so on through ``LEVELS``: a group has
    at most 4096 members (16 384 at the two uppermost levels), whatever the ids are, so that no window spans the table.
    """
    level = ids.select(F.col("_id").alias("_first"), F.col("_id").alias("_last"), F.shiftright("_id", LEVELS[0]).alias("_up")).distinct()
    found = []
    for step in range(len(LEVELS)):
        side = Window.partitionBy("_up").orderBy("_first")
        ahead = level.withColumn("_next", F.lead("_first").over(side))
        if step == len(LEVELS) - 1:
            ahead = ahead.withColumn("_next", F.coalesce("_next", F.min("_first").over(Window.partitionBy("_up"))))
        found.append(ahead.filter("_next IS NOT NULL").select(F.col("_last").alias("_id"), "_next"))
        up = F.shiftright("_up", LEVELS[step + 1]) if step < len(LEVELS) - 2 else F.lit(0).cast("long")
        level = level.groupBy("_up").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")).select("_first", "_last", up.alias("_up"))
    return reduce(DataFrame.union, found)


def edited_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """``id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next`` for every row: how a fingerprint holds
    when a text's last 1/``part`` gives way to the beginning of the next document.

    The next document is that with the next larger id; of rows sharing that id, the one whose text has the least hash. After
    the largest id comes the smallest; a null id counts as the largest long; a sole document is its own next one. Null
    text: empty. Repeated rows each have a row. Empty input: no rows. Other columns play no part.

    Texts are shuffled once, by id, and of the next document only as many characters as are needed.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    own_id = F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID))
    rows = docs.select(own_id.alias("_id"), text.alias("_text"))
    size = F.char_length("_text")
    ids = stored(
        rows.groupBy("_id").agg(F.min(F.xxhash64("_text")).alias("_rep"), F.max(F.floor(size / part)).cast("int").alias("_need")), "ids"
    )
    before = successors(ids.select("_id")).select(F.col("_id").alias("_before"), F.col("_next").alias("_id"))
    need = ids.select(F.col("_id").alias("_before"), "_need")
    links = ids.select("_id", "_rep").join(before.join(need, "_before"), "_id")
    linked = rows.join(links, "_id")
    # written so that it is no key of the join: both uses of the texts then share one shuffle
    chosen = F.xxhash64("_text").bitwiseXOR(F.col("_rep")) == 0
    first = linked.filter(chosen).select(
        F.col("_before").alias("_of"), F.left("_text", F.col("_need")).alias("_begin"), F.col("_id").alias("_next")
    )
    first = first.groupBy("_of").agg(F.any_value("_begin").alias("_begin"), F.any_value("_next").alias("_next"))
    both = linked.join(first, F.col("_id") == F.col("_of"))
    cut = F.floor(size / part).cast("int")
    edited = F.concat(F.left("_text", size - cut), F.left("_begin", cut))
    done = stored(
        both.select(
            "_id", "_next", size.cast("long").alias("n_chars"), chosen.alias("_is_rep"),
            sketch(F.col("_text")).alias("sketch"), edited.alias("_edited"),
        ).select(
            "_id", "_next", "n_chars", "_is_rep", F.sha2("_edited", 256).alias("edited_sha256"), "sketch",
            sketch(F.col("_edited")).alias("edited_sketch"),
        ),
        "sketches",
    )
    following = done.filter("_is_rep").select(F.col("_id").alias("_next"), F.col("sketch").alias("_after")).dropDuplicates(["_next"])
    return done.join(following, "_next").select(
        plain_id(id_col), "n_chars", "edited_sha256", "sketch", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("_after")).alias("near_next"),
    )
