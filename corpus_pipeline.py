"""A training corpus in five stages; each works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatelens.llm import counts, exact, mixing, packing, rules, simhash
from gatelens.llm.common import packed, stored, unpacked
from gatelens.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps; the ledger is stored, so that another policy measures no text again."""
    entries = rules.stored_ledger(packed(docs, text=docs["text"]))
    return unpacked(rules.judged(entries).filter("kept"), docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.simhash_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    sized = packed(docs, doc_id=docs["doc_id"], source=docs["source"], words=counts.word_count(docs["text"]))
    sized = stored(sized, "sized")
    return unpacked(mixing.mixed(sized, "words"), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences."""
    return packing.pack(docs, vocabulary(), with_ids=False)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mix", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: XXH64 shingles and components have no counterpart in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
