"""Repeated substrings of a minimum length from a Burrows-Wheeler transform, by breadth-first interval expansion."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rotations in the order of their first ``depth`` symbols (or more); ties stay in any order.

    Prefix doubling, with as many ranks side by side in a key of 63 bits as fit (three up to two million symbols); after
    a round only rotations that still share their rank are sorted again.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    fit, have, key = min(depth, 63 // bits), 1, symbols.astype(np.int64)
    while have < fit:
        more = min(have, fit - have)
        # the last ``more`` symbols of the run that starts ``more`` places on follow those of this one
        tail = key & ((1 << (bits * more)) - 1) if more < have else key
        key = (key << (bits * more)) | np.roll(tail, -more)
        have += more
    order = np.argsort(key).astype(np.int32)
    rank = np.empty(n, np.int32)

    def ranked(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Gives rotations at these slots the slot of the first equal one as rank; returns the slots still tied."""
        first = np.ones(len(slots) + 1, bool)
        np.not_equal(keys[1:], keys[:-1], out=first[1:-1])
        heads = np.flatnonzero(first)
        rank[order[slots]] = np.repeat(slots[heads[:-1]], np.diff(heads))
        return slots[~(first[:-1] & first[1:])]

    tied = ranked(np.arange(n, dtype=np.int32), key[order])
    width = n.bit_length()
    while have < depth and len(tied):
        at = order[tied]
        keys, used, step = rank[at].astype(np.int64), width, have
        while used + width <= 63 and have < depth:
            at = at + np.int32(step % n)
            at[at >= n] -= n
            keys = (keys << width) | rank[at]
            used += width
            have += step
        by = np.argsort(keys)
        order[tied] = order[tied[by]]
        tied = ranked(tied, keys[by])
    return order


class Wavelet:
    """Counts of every symbol before a place of the transform, a bit plane at a time."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes, current = [], symbols
        names = np.arange(1 << bits)
        start = np.zeros(1 << bits, np.int32)
        for b in range(bits - 1, -1, -1):
            ones = (current >> b) & 1 == 1
            zeros = np.zeros(len(current) + 1, np.int32)
            np.cumsum(~ones, dtype=np.int32, out=zeros[1:])
            self.planes.append(zeros)
            above = (names >> b) & 1 == 1
            start = np.where(above, zeros[-1] + start - zeros[start], zeros[start])
            current = np.concatenate([current[~ones], current[ones]])
        self.start = start

    def extended(self, low: np.ndarray, high: np.ndarray):
        """For every interval and each symbol in it: the symbol, its count before the interval and before its end."""
        symbol = np.zeros(len(low), np.int32)
        for zeros in self.planes:
            left, right = zeros[low], zeros[high]
            ones = zeros[-1]
            a, b = right > left, (high - low) > (right - left)
            low, high, symbol = (
                np.concatenate([left[a], ones + (low - left)[b]]),
                np.concatenate([right[a], ones + (high - right)[b]]),
                np.concatenate([symbol[a] * 2, symbol[b] * 2 + 1]),
            )
        return symbol, low - self.start[symbol], high - self.start[symbol]


def long_prefix_groups(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations in order, and a mark where the common prefix with the one before is shorter than ``least``.

    The interval of the empty word holds everything. Extending an interval of a word to the left by each symbol found
    in it gives intervals of words one longer; the end of such an interval, if not yet marked, is a place whose common
    prefix is the length of the shorter word. Marks therefore appear by increasing value, every place is queued once,
    and the search stops at ``least``.

    Most intervals, above all those of one rotation, hold one symbol of the transform only: they move as a whole to
    where the step back to the symbol before takes their first place. The wavelet is asked for the others.
    """
    n = len(symbols)
    order = suffix_order(symbols, least)
    bits = max(1, int(symbols.max()).bit_length())
    last = symbols[order - 1].astype(np.uint16)
    back = np.empty(n, np.int32)
    back[np.argsort(last, kind="stable")] = np.arange(n, dtype=np.int32)
    run = np.zeros(n, np.int32)
    np.cumsum(last[1:] != last[:-1], dtype=np.int32, out=run[1:])
    wavelet = Wavelet(last, bits)
    counts = np.bincount(symbols, minlength=1 << bits)
    below = (np.cumsum(counts) - counts).astype(np.int32)
    marked = np.zeros(n + 1, bool)
    marked[[0, n]] = True
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(least):
        alike = run[low] == run[high - 1]
        first = back[low[alike]]
        end = first + (high - low)[alike]
        if not alike.all():
            symbol, inner, outer = wavelet.extended(low[~alike], high[~alike])
            first = np.concatenate([first, below[symbol] + inner])
            end = np.concatenate([end, below[symbol] + outer])
        new = ~marked[end]
        low, high = first[new], end[new]
        if not len(low):
            break
        marked[high] = True
    return order, marked[:n]


def repeated_starts(texts: list[bytes], least: int) -> list[np.ndarray]:
    """For each text the places where a string of ``least`` bytes starts that starts at another place too."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    used = np.zeros(256, bool)
    used[raw] = True
    dense = np.cumsum(used)
    begins = np.cumsum(lengths + 1) - lengths
    symbols = np.zeros(len(raw) + len(texts), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[begins - 1] = False
    symbols[inside] = dense[raw]
    order, marked = long_prefix_groups(symbols, least)
    group = np.cumsum(marked) - 1
    many = np.bincount(group)[group] > 1
    hit = np.zeros(len(symbols) + 1, bool)
    hit[order[many]] = True
    return [np.flatnonzero(hit[b : b + max(0, size - least + 1)]) for b, size in zip(begins, lengths)]
