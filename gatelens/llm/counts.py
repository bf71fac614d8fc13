"""Token counts kept as rollups by source, language and tokenizer version, maintained by signed deltas.

A store is a folder with three Parquet tables, all by batch: ``ledger`` (what is known of each document after a batch),
``deltas`` (additive totals of a batch: inserts count up, deletes down, a revision takes back the old and adds the new)
and ``commits``. A batch is written under its own name and counts only once its commit is written, last. Writing a batch
again before that replaces it; afterwards it does nothing. Totals are the sums of the deltas of committed batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm import tokens
from gatelens.session import path_exists

KEYS = ["source", "lang", "tokenizer"]
_LEDGER = "doc_id long, tokenizer string, source string, lang string, tokens long, alive boolean, number long, batch string"
_DELTAS = "source string, lang string, tokenizer string, documents long, tokens long, batch string"
_COMMITS = "number long, batch string"


def bpe_count(text: Column, path: str) -> Column:
    """Number of ids of a text by a tokenizer file; null counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        _, ends = tokens.encoded(texts, path)
        return pa.array(np.diff(ends), pa.int64())

    return F.arrow_udf(run, "long")(F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _read(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    if not path_exists(spark, f"{store}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/{table}")


def committed(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, store, "commits", _COMMITS)


def current(spark: SparkSession, store: str) -> DataFrame:
    """The living entries of the ledger: the newest of each document and tokenizer."""
    known = _read(spark, store, "ledger", _LEDGER).join(committed(spark, store).select("batch"), "batch", "left_semi")
    newest = known.groupBy("doc_id", "tokenizer").agg(
        F.max(F.struct("number", "alive", "source", "lang", "tokens")).alias("e")
    )
    return newest.select("doc_id", "tokenizer", "e.*").filter("alive").select("doc_id", *KEYS, "tokens")


def commit(spark: SparkSession, store: str, batch: str, changes: DataFrame) -> bool:
    """Applies a batch of changes (``kind, doc_id, source, lang, tokenizer, tokens``); False if it was there already.

    ``insert`` and ``revise`` (and a null or any other kind) set what is known of a document under a tokenizer; ``delete`` ends it (only its
    ``doc_id`` and ``tokenizer`` count, a null tokenizer means all). An insert of a known document therefore revises
    it, and a delete of an unknown one changes nothing. Rows for the same document and tokenizer in one batch: a
    delete wins, then the largest count, so that repeated rows count once. Null ids cannot be told apart and are one
    document. Null source, language or tokenizer is a group of its own, null tokens count 0. An empty batch commits nothing but
    its name.
    """
    done = committed(spark, store)
    if done.filter(F.col("batch") == batch).limit(1).count():
        return False
    number = (done.agg(F.max("number")).first()[0] or 0) + 1
    before = current(spark, store).select("doc_id", *(F.col(c).alias(f"old_{c}") for c in KEYS), F.col("tokens").alias("old"))
    gone = changes.filter("kind = 'delete'")
    every = gone.filter("tokenizer IS NULL").select("doc_id").distinct()
    known = before.select("doc_id", F.col("old_tokenizer").alias("tokenizer"))
    named = gone.filter("tokenizer IS NOT NULL").select("doc_id", "tokenizer").union(
        known.join(every, known["doc_id"].eqNullSafe(every["doc_id"]), "left_semi")
    )
    empty = F.lit(None).cast("string")
    wanted = (
        changes.filter("coalesce(kind, 'insert') <> 'delete'")
        .select("doc_id", "tokenizer", "source", "lang", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.lit(False).alias("ends"))
        .union(named.select("doc_id", "tokenizer", empty, empty, F.lit(0).cast("long"), F.lit(True)))
        .groupBy("doc_id", "tokenizer")
        .agg(F.max(F.struct("ends", "tokens", "source", "lang")).alias("e"))
        .select("doc_id", "tokenizer", "e.*")
    )
    entries = wanted.select(
        "doc_id", "tokenizer", "source", "lang", "tokens", (~F.col("ends")).alias("alive"),
        F.lit(number).cast("long").alias("number"), F.lit(batch).alias("batch"),
    )
    entries.write.mode("overwrite").parquet(f"{store}/ledger/name={batch}")
    written = spark.read.schema(_LEDGER).parquet(f"{store}/ledger/name={batch}")
    same = written["doc_id"].eqNullSafe(before["doc_id"]) & written["tokenizer"].eqNullSafe(before["old_tokenizer"])
    both = written.join(before, same, "left")
    signed = both.select(
        F.explode(
            F.array(
                F.struct(
                    written["source"].alias("source"), written["lang"].alias("lang"), written["tokenizer"].alias("tokenizer"),
                    F.when(F.col("alive"), 1).otherwise(0).alias("d"), F.when(F.col("alive"), F.col("tokens")).otherwise(0).alias("t"),
                ),
                F.struct(
                    F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_tokenizer").alias("tokenizer"),
                    F.when(F.col("old").isNotNull(), -1).otherwise(0).alias("d"), (-F.coalesce("old", F.lit(0))).alias("t"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    deltas = (
        signed.filter("d <> 0")
        .groupBy(*KEYS)
        .agg(F.sum("d").alias("documents"), F.sum("t").alias("tokens"))
        .withColumn("batch", F.lit(batch))
    )
    deltas.write.mode("overwrite").parquet(f"{store}/deltas/name={batch}")
    mark = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(batch).alias("batch"))
    mark.write.mode("overwrite").parquet(f"{store}/commits/name={batch}")
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """``source, lang, tokenizer, documents, tokens`` over all committed batches; groups that came to nothing are left out."""
    deltas = _read(spark, store, "deltas", _DELTAS).join(committed(spark, store).select("batch"), "batch", "left_semi")
    sums = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return sums.filter("documents <> 0")
