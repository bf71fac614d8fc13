"""Token ids of whole batches of texts with a public tokenizer file of the ``tokenizers`` library.

For a vocabulary that drops white space, a text's ids are the ids of its pieces one after the other, as long as the cuts
are at white space or between an ASCII letter and ASCII punctuation (without the apostrophe). So each distinct piece of a
batch is encoded once. Texts that hold one of the vocabulary's special tokens are encoded as a whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from gatelens.llm import hashing
from gatelens.llm.common import blocks, buffers, worker_state

_KNOWN = 1 << 19
_BLOCK = 1 << 21
_LETTER, _MARK = 1, 2
_KIND = np.full(256, 3, np.uint8)
_KIND[hashing.SEPARATOR] = 0
_KIND[np.r_[0x41:0x5B, 0x61:0x7B]] = _LETTER
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class _Level:
    """Pieces in the order of their first hash, with a second hash and their ids."""

    def __init__(self, first=None, second=None, ids=None, ends=None):
        self.first = np.zeros(0, np.uint64) if first is None else first
        self.second = np.zeros(0, np.uint64) if second is None else second
        self.ids = np.zeros(0, np.uint32) if ids is None else ids
        self.ends = np.zeros(1, np.int64) if ends is None else ends

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Entry of each pair, or -1."""
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)

    def plus(self, other: _Level) -> _Level:
        first, second = np.concatenate([self.first, other.first]), np.concatenate([self.second, other.second])
        order = np.argsort(first, kind="stable")
        ends = np.concatenate([self.ends, other.ends[1:] + self.ends[-1]])
        ids, ends = ragged(np.concatenate([self.ids, other.ids]), ends, order)
        return _Level(first[order], second[order], ids, ends)


class _Known:
    """Pieces encoded before; new ones gather in a small level that joins the large one now and then. Bounded."""

    def __init__(self):
        self.large, self.small = _Level(), _Level()

    def add(self, new: _Level) -> None:
        if len(self.large.first) + len(self.small.first) + len(new.first) > _KNOWN:
            self.large, self.small = _Level(), _Level()
        self.small = self.small.plus(new)
        if len(self.small.first) > max(1 << 16, len(self.large.first) // 4):
            self.large, self.small = self.large.plus(self.small), _Level()


def ragged(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``rows`` one after the other, and their new offsets."""
    sizes = (ends[1:] - ends[:-1])[rows]
    out = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(out[-1]) + np.repeat(ends[:-1][rows] - out[:-1], sizes)
    return values[place], out


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = (kind[1:] != kind[:-1]) & ((kind[1:] == 0) | (kind[:-1] == 0) | (kind[1:] + kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0))
    edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    words = kind[starts] != 0
    return starts[words], ends[words]


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other (unsigned 32 bits), and the offsets of the texts."""
    tokenizer = worker_state(f"tokenizer {path}", lambda: _tokenizer(path))
    special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    data, offsets = buffers(texts)
    all_ids, all_ends = [], [np.zeros(1, np.int64)]
    total = 0
    for low, high in blocks(np.diff(offsets), _BLOCK):
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        raw = part.tobytes()
        ids, ends = _by_piece(part, own, tokenizer, path)
        if any(s in raw for s in special):
            lists = np.split(ids, ends[1:-1])
            for i in range(high - low):
                text = raw[own[i] : own[i + 1]]
                if any(s in text for s in special):
                    lists[i] = np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(lists)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        all_ids.append(ids)
        all_ends.append(ends[1:] + total)
        total += len(ids)
    return np.concatenate([np.zeros(0, np.uint32), *all_ids]), np.concatenate(all_ends)


def _by_piece(data: np.ndarray, offsets: np.ndarray, tokenizer, path: str) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = _pieces(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    lengths = ends - starts
    body = np.ones(len(data), bool)
    gaps = np.flatnonzero(_KIND[data] == 0)
    body[gaps] = False
    flat = _LOWER[data[body]]
    edges = np.concatenate([[0], np.cumsum(lengths)])
    pieces = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat)]
    ).dictionary_encode()
    codes = pieces.indices.to_numpy()
    distinct = pieces.dictionary
    d_data, d_offsets = buffers(distinct)
    known = worker_state(f"pieces {path}", _Known)
    first, second = (hashing.word_hashes(d_data, d_offsets[:-1], d_offsets[1:], k) for k in (0, 1))
    large, small = known.large, known.small
    in_large = large.find(first, second)
    in_small = np.where(in_large < 0, small.find(first, second), -1)
    missing = np.flatnonzero((in_large < 0) & (in_small < 0))
    found = [
        np.array(e.ids, np.uint32)
        for low in range(0, len(missing), 4096)
        for e in tokenizer.encode_batch_fast(
            [b.decode() for b in distinct.take(pa.array(missing[low : low + 4096])).to_pylist()],
            add_special_tokens=False,
        )
    ]
    new = _Level(
        first[missing],
        second[missing],
        np.concatenate([np.zeros(0, np.uint32), *found]),
        np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64),
    )
    # The ids of this batch's distinct pieces, level by level, then in the order of the dictionary.
    here, source = [], np.empty(len(distinct), np.int64)
    begun = 0
    for level, rows in ((large, in_large[in_large >= 0]), (small, in_small[in_small >= 0]), (new, np.arange(len(missing)))):
        here.append(ragged(level.ids, level.ends, rows))
    for at in (np.flatnonzero(in_large >= 0), np.flatnonzero(in_small >= 0), missing):
        source[at] = begun + np.arange(len(at))
        begun += len(at)
    ids = np.concatenate([i for i, _ in here])
    sizes = np.concatenate([np.diff(e) for _, e in here])
    out, out_ends = ragged(ids, np.concatenate([[0], np.cumsum(sizes)]), source[codes])
    if len(missing):
        known.add(new)
    last = np.searchsorted(starts, offsets[1:], "left")
    return out, np.concatenate([[0], out_ends[last]])
