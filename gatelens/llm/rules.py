"""Quality rules as a ledger: every rule is evaluated once and leaves a failure bit and its measurements.

Policies are versions of a mask over the bits, so a changed policy or an ablation reads the ledger and never a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.llm import hashing
from gatelens.llm.common import blocks, buffers, packed, stored, unpacked

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLOCK = 1 << 20


def rules() -> dict[str, Column]:
    """What makes a document fail, by name; the place in this list is the bit."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_phrases": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": c("n_symbols") > c("n_words"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 40 * c("n_words"),
        "repeated_lines": (c("n_dup_lines") >= 3) & (2 * c("n_dup_lines") > c("n_lines")),
        "symbols_tenth": 10 * c("n_symbols") > c("n_words"),
        "words_under_3": c("word_chars") < 3 * c("n_words"),
        "words_over_10": c("word_chars") > 10 * c("n_words"),
    }


#: Rules that count, by version of the policy. ``base`` has the two that every version shares; ``v3`` has the published
#: bounds (a tenth of a symbol per word, three to ten characters per word), within which those of ``v2`` lie.
POLICIES = {
    "base": ["few_words", "repeated_phrases"],
    "v1": ["few_words", "repeated_phrases", "symbols"],
    "v2": ["few_words", "repeated_phrases", "symbols", "short_words", "long_words", "repeated_lines"],
    "v3": ["few_words", "repeated_phrases", "symbols_tenth", "words_under_3", "words_over_10", "repeated_lines"],
}
CURRENT = "v3"


def mask(policy: str) -> int:
    names = list(rules())
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [line for line in text.split("\n") if line.strip("\x20\x09\x0b\x0c\x0d")]
    return len(lines), len(lines) - len(set(lines))


def _repeat_words(owner: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Words in windows of three that stand twice or more in their document, by document."""
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    inside = owner[:-2] == owner[2:]
    windows = hashing.mix(hashing.rolling(codes, 3, hashing.lane_of(0)["step"]))
    windows = hashing.mix(windows + owner[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = np.zeros(len(inside), bool)
    again[inside] = hashing.repeated(windows[inside])
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return np.bincount(owner[covered], minlength=n)


def _measure(texts: pa.Array) -> pa.Array:
    """Measurements of a batch, a megabyte of documents at a time."""
    data, offsets = buffers(texts)
    values = np.zeros((len(MEASURES), len(texts)), np.int64)
    for low, high in blocks(np.diff(offsets), _BLOCK):
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        owner, (codes,) = hashing.words(part, own)
        lines = [_lines(t) for t in texts.slice(low, high - low).to_pylist()]
        values[:, low:high] = (
            np.bincount(owner, minlength=high - low),
            _totals(((part & 0xC0) != 0x80) & ~hashing.SEPARATOR[part], own),
            _totals(_SYMBOL[part], own),
            [found for found, _ in lines],
            [again for _, again in lines],
            _repeat_words(owner, codes, high - low),
        )
    return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], names=MEASURES)


def _totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the measurements and ``failures``, a long with a bit per rule of ``rules()``.

    Words are runs of anything but the six ASCII white-space characters. ``word_chars``: code points in words;
    ``n_symbols``: characters of ``#*$%&|<>``; ``n_lines``: lines (cut at ``\\n``) with a word; ``n_dup_lines``: those
    equal to an earlier one; ``n_repeat_words``: words in windows of three words that occur twice or more.

    Null text: empty, all measurements zero. Repeated rows stay, each with its own entry. Empty input: no rows. Other
    columns pass through (ids may be null); those named like the new ones are replaced.
    """
    measure = F.arrow_udf(_measure, ", ".join(f"{m} long" for m in MEASURES))
    rows = packed(docs, _found=measure(F.coalesce(docs[text_col], F.lit(""))))
    measured = rows.select("_row", "_found.*")
    bits = sum((F.when(rule, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules().values())), F.lit(0))
    return unpacked(measured, docs.columns, **{m: F.col(m) for m in MEASURES}, failures=bits.cast("long"))


def judged(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a version of the policy."""
    return entries.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``rule, n_failed, n_only``: documents that fail each rule of a policy, and those it alone rejects."""
    names = list(rules())
    seen = F.col("failures").bitwiseAND(F.lit(mask(policy)))
    counts = entries.agg(
        *(F.count(F.when(seen.bitwiseAND(F.lit(1 << names.index(r))) != 0, 1)).alias(f"f_{r}") for r in POLICIES[policy]),
        *(F.count(F.when(seen == (1 << names.index(r)), 1)).alias(f"o_{r}") for r in POLICIES[policy]),
    )
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in POLICIES[policy]))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def policy_report(entries: DataFrame) -> DataFrame:
    """``policy, rule, n_failed, n_only``: the ablations of every policy. ``entries`` is read once per policy, so it
    should be a stored ledger."""
    found = None
    for policy in POLICIES:
        rows = ablations(entries, policy).select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only")
        found = rows if found is None else found.unionByName(rows)
    return found


def stored_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The ledger without the texts, written once; policies and ablations read it and no text is measured again."""
    return stored(ledger(docs, text_col).drop(text_col), "ledger")
