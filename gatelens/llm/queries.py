"""The queries of the operators over the test tables, and their SQL counterparts where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm import align, chat, counts, exact, licenses, mixing, packing, repair, rules, simhash, sketches, substring, suffix
from gatelens.llm.common import documents, stored
from gatelens.session import scratch_path

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.substring_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.suffix_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_chat_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", counts.word_count(F.col("text")).alias("n_words"))
    mixed = mixing.mix(stored(docs, "sizes"), "n_words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(documents(spark, sf_dir))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger under the current policy; op6_policy_ablations has every policy."""
    judged = rules.judged(rules.ledger(documents(spark, sf_dir)))
    base = F.col("failures").bitwiseAND(F.lit(rules.mask("base"))) != 0
    failures = F.col("failures").bitwiseAND(F.lit(rules.mask(rules.CURRENT))).alias("failures")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", failures,
    )


def op6_policy_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that every rule of every policy rejects, and those it alone rejects, from one stored ledger."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return rules.policy_report(rules.stored_ledger(docs))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(), with_ids=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir)).drop("spans")


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: a load, counts revised after markup is stripped, deletes of documents under 50
    words, and the second batch once more, which must change nothing."""
    store = scratch_path(spark, "rollup")
    docs = documents(spark, sf_dir)
    plain = F.regexp_replace("text", r"[#*$%&|<>]", "")

    def counted(rows: DataFrame, text, kind: str) -> DataFrame:
        both = rows.select(
            "doc_id", "source", "lang", counts.word_count(text).alias("words"), counts.bpe_count(text, vocabulary()).alias("bpe")
        )
        versions = F.array(
            F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens")),
            F.struct(F.lit("word_bpe_49k").alias("tokenizer"), F.col("bpe").alias("tokens")),
        )
        rows = both.select("doc_id", "source", "lang", F.explode(versions).alias("v"))
        return rows.select(F.lit(kind).alias("kind"), "doc_id", "source", "lang", "v.tokenizer", "v.tokens")

    counts.commit(spark, store, "load", counted(docs, F.col("text"), "insert"))
    revised = counted(docs.filter(F.col("text") != plain), plain, "revise")
    counts.commit(spark, store, "revised", revised)
    short = counts.current(spark, store).filter("tokenizer = 'words-1' AND tokens < 50")
    none = F.lit(None).cast("string")
    gone = short.select(F.lit("delete").alias("kind"), "doc_id", "source", "lang", none.alias("tokenizer"), F.lit(0).alias("tokens"))
    counts.commit(spark, store, "short", gone)
    counts.commit(spark, store, "revised", revised)
    return counts.totals(spark, store)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(documents(spark, sf_dir))
    whole = F.coalesce("full_hash", F.sha2(exact.normalised(F.col("text")), 256))
    return groups.select("doc_id", "keep_id", "group_size", "kept", whole.alias("text_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.repair_report(repair.damaged(turns)).withColumnRenamed("_conv", "conv_id")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    return align.align(documents(spark, sf_dir), a, b).drop("groups")


def op13_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = sketches.edited_sketches(documents(spark, sf_dir))
    return near.select(
        "doc_id", "n_chars", "edited_sha256", sketches.printed(F.col("sketch")).alias("fingerprint"),
        sketches.printed(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_suffix_dedup,
        op3_chat_rotations,
        op4_source_mix,
        op5_simhash_groups,
        op6_quality_ledger,
        op6_policy_ablations,
        op7_best_fit_packing,
        op8_license_scan,
        op9_token_rollup,
        op10_exact_dedup,
        op11_conversation_repair,
        op12_tokenizer_alignment,
        op13_scaled_sketches,
    )
}
