"""Vectorised hashes of words and of windows over words or bytes, as used inside tasks.

Two independent 64-bit lanes; where equality counts, both are compared.
"""

from __future__ import annotations

import numpy as np

from gatelens.llm.common import worker_state

_LOW = 1 << 16
_SEGMENT = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _lane(seed: int) -> dict:
    draw = np.random.Generator(np.random.PCG64(seed))
    table = draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = (int(draw.integers(1 << 40, 1 << 62)) * 8 + 5) % (1 << 64)
    powers = np.full(_LOW, base, np.uint64)
    powers[0] = 1
    return {"table": table, "powers": np.cumprod(powers), "high": pow(base, _LOW, 1 << 64), "step": base}


def lane_of(number: int) -> dict:
    """The tables of a lane, made once per worker."""
    return worker_state(f"lane{number}", lambda: _lane(11 + 12 * number))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(codes: np.ndarray, width: int, step: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` codes, put together from runs of doubling length."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    whole, have = None, 0
    run, size = codes, 1
    while True:
        if width & size:
            if whole is None:
                whole = run.copy() if size == 1 else run
            else:
                tail = run[have:]
                whole = whole[: len(tail)] * np.uint64(pow(step, size, 1 << 64)) + tail
            have += size
        if 2 * size > width:
            return whole[: len(codes) - width + 1]
        run = run[:-size] * np.uint64(pow(step, size, 1 << 64)) + run[size:]
        size *= 2


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word reaches over the border of two documents."""
    word = ~separator[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    first[borders] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    last[borders - 1] = True
    return np.flatnonzero(word & first), np.flatnonzero(word & last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Hash of each span of bytes; spans follow each other and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    own = lane_of(lane)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    place -= np.repeat(before, lengths)
    values = own["table"][data[place + np.repeat(starts, lengths)]]
    longest = int(lengths.max())
    if longest > _LOW:
        high = [1]
        for _ in range(longest // _LOW):
            high.append(high[-1] * own["high"] % (1 << 64))
        values *= np.array(high, np.uint64)[place >> 16]
        place &= _LOW - 1
    values *= own["powers"][place]
    return mix(np.add.reduceat(values, before) + lengths.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lanes: tuple[int, ...] = (0,)) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every word its document and a hash per lane. Long inputs are worked off in segments cut between words."""
    documents, hashes = [], [[] for _ in lanes]
    low = 0
    while low < len(data):
        high = min(len(data), low + _SEGMENT)
        while high < len(data):
            cut = np.flatnonzero(SEPARATOR[data[high : high + _SEGMENT]])
            following = offsets[np.searchsorted(offsets, high) :][:1]
            if len(cut) or len(following) and following[0] <= high + _SEGMENT:
                high = min([*(high + cut[:1]), *following])
                break
            high = min(len(data), high + _SEGMENT)
        part = data[low:high]
        starts, ends = spans(part, offsets - low)
        documents.append(np.searchsorted(offsets, starts + low, "right") - 1)
        for i, lane in enumerate(lanes):
            hashes[i].append(word_hashes(part, starts, ends, lane))
        low = int(high)
    if not documents:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in lanes]
    return np.concatenate(documents), [np.concatenate(h) for h in hashes]


def without_repeats(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Mask that leaves each value once per owner."""
    keep = np.ones(len(values), bool)
    twice = repeated(values)
    at = np.flatnonzero(twice)
    if len(at):
        order = at[np.lexsort((owner[at], values[at]))]
        same = (values[order][1:] == values[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        keep[order[1:][same]] = False
    return keep


def repeated(values: np.ndarray) -> np.ndarray:
    """Mask of values that stand at two places or more."""
    ordered = np.sort(values)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return members(values, again)


def members(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Mask of values in a sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values
