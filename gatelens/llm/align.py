"""Alignment of two tokenizers' ids over the same bytes.

Both tokenisations of a whole text are laid over its bytes. Where a token of each ends and the next token of each opens
with a space, both start a new word: these anchors, verified in the bytes, cut the document into windows of token ids.
A window's alignment depends on its ids alone, so it is worked out once per distinct pair of id tuples and looked up
again (per batch by Arrow's dictionary encoding, across batches in a worker's memo of bounded size).

Corpus-wide counts: a task counts each id pair per block of documents (a block is one batch of a few megabytes), Spark
sums the counts, and every block gets back the counts of its own pairs only. No table of all pairs is broadcast.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import blocks, buffers, keyed, plain_id, stored, worker_state
from gatelens.llm.tokens import ragged

BLOCK = 1 << 21
KNOWN = 1 << 18
_BREAK = 0xFFFF


class Vocabulary(NamedTuple):
    """``encode`` texts to id lists; the bytes of all entries one after the other, where each ends, how long each is, and
    the ids as text."""

    encode: Callable
    data: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray
    lengths: list[int]
    names: list[str]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.data, self.ends, ids)[0]


def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[str]]:
    lengths = [len(e) for e in entries]
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), ends, np.diff(ends), lengths, [str(n) for n in range(len(entries))]


def _byte_of() -> dict[str, int]:
    """The published alphabet of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(others)}


def _byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file. If its merges come in the order of their ids, they are ranks, which tiktoken runs faster."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
    added = {t["id"] for t in content["added_tokens"]}
    byte_of = _byte_of()
    entries = [b""] * (1 + max([*vocabulary.values(), *added]))
    for entry, number in vocabulary.items():
        if number not in added:
            entries[number] = bytes(byte_of[c] for c in entry)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    made = [vocabulary["".join(pair)] for pair in pairs]
    ranks = {entry: number for number, entry in enumerate(entries) if entry}
    cutter = content["pre_tokenizer"]
    usual = cutter["type"] == "ByteLevel" and not cutter["add_prefix_space"] and cutter.get("use_regex", True)
    ordered = usual and made == sorted(made) and len(ranks) == 256 + len(made) and content.get("normalizer") is None
    fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def encode(texts: list[str]) -> list[list[int]]:
        if fast is None:
            return [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
        return [fast.encode_ordinary(t) for t in texts]

    return Vocabulary(encode, *_table(entries))


def _pieces(path: str) -> Vocabulary:
    """A piece model with byte fallback; control entries have no bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            entries.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(number) or model.is_unknown(number):
            entries.append(b"")
        else:
            entries.append(piece.replace("▁", " ").encode())
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), *_table(entries))


def vocabulary(path: str) -> Vocabulary:
    return worker_state(f"vocabulary {path}", lambda: _pieces(path) if path.endswith(".model") else _byte_level(path))


class Alignment(NamedTuple):
    groups: str
    links: list[int]
    n_groups: int


def aligned(a_ids: list[int], b_ids: list[int], a: Vocabulary, b: Vocabulary) -> Alignment:
    """Groups of a window as text, and its links as ``a << 16 | b``: one for every stretch between neighbouring ends."""
    a_lengths, b_lengths, a_names, b_names = a.lengths, b.lengths, a.names, b.names
    if len(a_ids) == 1 == len(b_ids):
        return Alignment(f"{a_names[a_ids[0]]}|{b_names[b_ids[0]]}", [a_ids[0] << 16 | b_ids[0]], 1)
    links, groups = [], []
    i = j = a_from = b_from = 0
    a_left, b_left = a_lengths[a_ids[0]], b_lengths[b_ids[0]]
    while True:
        links.append(a_ids[i] << 16 | b_ids[j])
        ahead = a_left - b_left  # bytes of the A token behind the end of the B token
        if ahead < 0:
            i += 1
            a_left, b_left = a_lengths[a_ids[i]], -ahead
        elif ahead > 0:
            j += 1
            a_left, b_left = ahead, b_lengths[b_ids[j]]
        else:
            i += 1
            j += 1
            groups.append(",".join([a_names[k] for k in a_ids[a_from:i]]) + "|" + ",".join([b_names[k] for k in b_ids[b_from:j]]))
            if i == len(a_ids):
                return Alignment(";".join(groups), links, len(groups))
            a_from, b_from = i, j
            a_left, b_left = a_lengths[a_ids[i]], b_lengths[b_ids[j]]


class _Side(NamedTuple):
    """Tokens of all documents of a block: ids, the byte where each ends in the block, offsets of the documents."""

    ids: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def _side(lists: list[list[int]], v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[_Side, np.ndarray]:
    """The tokens, and which documents they spell byte for byte."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in lists]])
    sizes = v.sizes[ids]
    total = np.concatenate([[0], np.cumsum(sizes)])
    same = np.diff(total[starts]) == np.diff(offsets)
    if same.all():
        wrong = np.flatnonzero(v.joined(ids) != data)
        same[np.searchsorted(offsets, wrong, "right") - 1] = False
    else:
        for i in np.flatnonzero(same):
            same[i] = np.array_equal(v.joined(ids[starts[i] : starts[i + 1]]), data[offsets[i] : offsets[i + 1]])
    return _Side(ids, total[1:], starts), same


def _windows(side: _Side, cuts: np.ndarray) -> np.ndarray:
    """Offsets of the windows in a side's tokens; ``cuts`` are the bytes where windows end."""
    return np.concatenate([[0], np.searchsorted(side.ends, cuts, "left") + 1])


def _distinct(a: _Side, b: _Side, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Code of every window and the distinct windows, as 16-bit ids with a break between the two sides."""
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    ends = np.concatenate([[0], np.cumsum(n_a + n_b + 1)])
    flat = np.empty(ends[-1], np.uint16)
    flat[ends[1:] - 1 - n_b] = _BREAK
    flat[np.arange(len(a.ids)) + np.repeat(ends[:-1] - a_at[:-1], n_a)] = a.ids
    flat[np.arange(len(b.ids)) + np.repeat(ends[:-1] + n_a + 1 - b_at[:-1], n_b)] = b.ids
    coded = pa.Array.from_buffers(
        pa.large_binary(), len(n_a), [None, pa.py_buffer((2 * ends).astype(np.int64)), pa.py_buffer(flat)]
    ).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def _looked_up(distinct: pa.Array, a: Vocabulary, b: Vocabulary, memo: dict) -> list[Alignment]:
    found = []
    for key in distinct.to_pylist():
        known = memo.get(key)
        if known is None:
            ids = np.frombuffer(key, np.uint16).tolist()
            cut = ids.index(_BREAK)
            known = aligned(ids[:cut], ids[cut + 1 :], a, b)
            if len(key) <= 64:
                if len(memo) >= KNOWN:
                    memo.clear()
                memo[key] = known
        found.append(known)
    return found


def align_block(texts: list[str], a_path: str, b_path: str) -> dict:
    """Alignment of a block of texts (none empty): counts and groups per text, and its links per distinct pair.

    ``n_a, n_b, n_groups, n_links, groups``: lists by text; ``pairs``: the block's distinct pairs, with the number of texts
    that hold each; ``owner, place, times``: for each text (ascending) its pairs and how often each is linked.
    """
    a, b = vocabulary(a_path), vocabulary(b_path)
    spaced = [" " + t for t in texts]
    raw = [t.encode() for t in spaced]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    a_lists, b_lists = a.encode(spaced), b.encode(texts)
    a_side, a_same = _side(a_lists, a, data, offsets)
    b_side, b_same = _side(b_lists, b, data, offsets)
    whole = a_same & b_same
    if not whole.all():  # the others have no tokens
        rows = np.flatnonzero(whole)
        left = align_block([texts[i] for i in rows], a_path, b_path) if len(rows) else None
        return _spread(left, rows, len(texts))
    a_end, b_end = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    a_end[a_side.ends], b_end[b_side.ends] = True, True
    anchor = a_end & b_end
    # the next token of either side starts here, and it starts with a space; a document's end is an anchor too
    anchor[:-1] &= data == 0x20
    anchor[offsets[1:]] = True
    cuts = np.flatnonzero(anchor)
    cuts = cuts[cuts > 0]
    a_at, b_at = _windows(a_side, cuts), _windows(b_side, cuts)
    codes, distinct = _distinct(a_side, b_side, a_at, b_at)
    found = _looked_up(distinct, a, b, worker_state(f"windows {a_path} {b_path}", dict))
    of_doc = np.concatenate([[0], np.searchsorted(cuts, offsets[1:], "left") + 1])
    n_groups = np.array([f.n_groups for f in found], np.int64)[codes]
    groups = [f.groups for f in found]
    link_ends = np.concatenate([[0], np.cumsum([len(f.links) for f in found])]).astype(np.int64)
    flat = np.fromiter(chain.from_iterable(f.links for f in found), np.uint32, int(link_ends[-1]))
    links, ends = ragged(flat, link_ends, codes)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(ends[of_doc]))
    keys, times = np.unique(owner << np.uint64(32) | links, return_counts=True)
    pairs, place, docs = np.unique(keys & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)
    code_list = codes.tolist()
    return {
        "n_a": np.diff(a_side.offsets),
        "n_b": np.diff(b_side.offsets),
        "n_groups": np.add.reduceat(n_groups, of_doc[:-1]),
        "n_links": np.diff(ends[of_doc]),
        "groups": [";".join([groups[c] for c in code_list[i:j]]) for i, j in zip(of_doc[:-1], of_doc[1:], strict=True)],
        "pairs": pairs,
        "docs": docs,
        "owner": (keys >> np.uint64(32)).astype(np.int64),
        "place": place,
        "times": times,
    }


def _spread(part: dict | None, rows: np.ndarray, n: int) -> dict:
    none = np.zeros(0, np.int64)
    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": [""] * n}
    if part is None:
        return out | dict.fromkeys(("pairs", "docs", "owner", "place", "times"), none)
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        out[c][rows] = part[c]
    for i, groups in zip(rows, part["groups"], strict=True):
        out["groups"][i] = groups
    return out | {c: part[c] for c in ("pairs", "docs", "place", "times")} | {"owner": rows[part["owner"]]}


_ALIGNED = (
    "_block string, _id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "_places binary, _times binary, _place int, a int, b int, docs long"
)


def _aligner(a_path: str, b_path: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        gc.disable()  # the memo holds many small objects and no cycles
        try:
            for batch in batches:
                ids, texts = batch.column("_id"), batch.column("_text")
                sizes = np.diff(buffers(texts)[1])
                for low, high in blocks(sizes, BLOCK):
                    own = texts.slice(low, high - low).to_pylist()
                    rows = np.flatnonzero(sizes[low:high])
                    left = align_block([own[i] for i in rows], a_path, b_path) if len(rows) else None
                    yield from _rows(_spread(left, rows, high - low), ids.slice(low, high - low), f"{part}-{number}", with_groups)
                    number += 1
        finally:
            gc.enable()

    return run


def _rows(found: dict, ids: pa.Array, block: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    n, m = len(ids), len(found["pairs"])
    cut = np.searchsorted(found["owner"], np.arange(n + 1))
    places = [found["place"][i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
    times = [found["times"][i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
    hashed = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]]
    names = [f.split(" ")[0] for f in _ALIGNED.split(", ")]
    docs = [pa.array([block] * n, pa.string()), ids, *[pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]]
    docs += [pa.array(hashed, pa.string()), pa.array(found["groups"] if with_groups else [None] * n, pa.string())]
    docs += [pa.array(places, pa.binary()), pa.array(times, pa.binary())]
    docs += [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]
    yield pa.record_batch(docs, names)
    pairs = found["pairs"].astype(np.int64)
    counts = [pa.array([block] * m, pa.string()), *[pa.nulls(m, pa.int64()) for _ in range(5)], pa.nulls(m, pa.string()), pa.nulls(m, pa.string())]
    counts += [pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(np.arange(m, dtype=np.int32))]
    counts += [pa.array((pairs >> 16).astype(np.int32)), pa.array((pairs & 0xFFFF).astype(np.int32)), pa.array(found["docs"], pa.int64())]
    yield pa.record_batch(counts, names)


_SCORED = "_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of a block's documents, from the counts of the block's pairs."""
    order = np.argsort(pairs.column("_place").to_numpy())
    count = pairs.column("count").to_numpy()[order]
    best = pairs.column("best").to_numpy()[order]
    n_best, count_sum = [], []
    for places, times in zip(docs.column("_places").to_pylist(), docs.column("_times").to_pylist(), strict=True):
        at, n = np.frombuffer(places, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
        n_best.append(int(n @ best[at]) if len(at) else 0)
        count_sum.append(int(n @ count[at]) if len(at) else 0)
    out = docs.select(["_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return out.append_column("groups_sha256", docs.column("groups_sha256")).append_column("groups", docs.column("groups"))


def align_stored(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """The alignment of all documents, written once: rows of documents, and rows of a block's id pairs."""
    rows = keyed(docs, id_col, text_col).select("_id", "_text")
    return stored(rows.mapInArrow(_aligner(a_path, b_path, with_groups), _ALIGNED), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, count, best``: in how many documents an id pair is linked, and 1 if no pair of that ``a`` is in more."""
    pairs = stored(found.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("count")), "pairs")
    most = pairs.groupBy("a").agg(F.max("count").alias("most"))
    return pairs.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False
) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups`` for every row of ``docs``.

    ``a_path`` is a byte-level BPE file, given a space before the text; ``b_path`` a piece model that puts one there itself.
    Strings of special tokens are plain text. Groups lie between bytes where tokens of both end; links are overlapping
    tokens; ``count_sum`` adds up in how many documents each link's id pair is linked, ``n_best`` counts links whose pair is
    the most frequent of its first id. ``groups`` is null unless asked for.

    Null and empty texts, and texts that one of the two does not spell byte for byte: no tokens, zeros, empty hash. A text
    of any length is one block. Repeated rows and ids: each row by its own text, counted each. Empty input: no rows. Other
    columns play no part.
    """
    found = align_stored(docs, a_path, b_path, id_col, text_col, with_groups)
    counted = found.filter("a IS NOT NULL").select("_block", "_place", "a", "b").join(pair_counts(found), ["a", "b"])
    counted = counted.select(F.col("_block").alias("_of"), "_place", "count", "best")
    rows = found.filter("a IS NULL").select("_block", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "_places", "_times")
    scored = rows.groupBy("_block").cogroup(counted.groupBy("_of")).applyInArrow(_scored, _SCORED)
    return scored.select(
        plain_id(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"
    )
