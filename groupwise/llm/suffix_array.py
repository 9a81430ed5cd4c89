"""Suffix arrays by induced sorting, on NumPy arrays, and permuted common prefixes.

The classic steps: classify suffixes as larger or smaller than their right neighbour, sort the
leftmost-smaller substrings by a round of inducing, name them, recurse on the names unless they are
unique, and induce the whole array from the sorted ones.

Inducing scans the array once in each direction, and is linear. A scan takes as one step all
entries up to the next bucket that still has empty slots: what these entries place falls behind
them, and their targets are found with one stable sort by symbol. The slots that are empty when a
scan reaches their bucket belong to suffixes whose right neighbour lies in the same bucket, that is
to runs of one symbol; the order of the runs' ends gives all of them at once. So neither runs nor
periods are walked symbol by symbol.
"""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last (the sentinel) counts as smaller."""
    less = t[:-1] < t[1:]
    differ = np.flatnonzero(less | (t[:-1] > t[1:]))  # the last step always is one
    return np.append(np.repeat(less[differ], np.diff(np.append(-1, differ))), True)


def _place(sa: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray, free: np.ndarray, step: int) -> None:
    """Put suffixes, in order, into the next free slots of their symbols, counting by step."""
    order = symbols.argsort(kind="stable")
    s = symbols[order]
    first = np.empty(len(s), bool)
    first[0] = True
    np.not_equal(s[1:], s[:-1], out=first[1:])
    begin = first.nonzero()[0]
    size = np.diff(np.append(begin, len(s)))
    at = free[s[begin]]
    sa[np.repeat(at - begin * step, size) + np.arange(len(s)) * step] = suffixes[order]
    free[s[begin]] = at + size * step


def _chains(ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The suffixes of runs, nearest to the runs' ends first: ends - 1 of those with one before, ends - 2 ..."""
    before = before[ends]
    far = int(before.max(initial=0))
    if far <= 1:
        return ends[before > 0] - 1
    total = before.cumsum()
    distance = np.arange(total[-1]) - np.repeat(total - before, before)
    order = distance.astype(np.uint16 if far < 1 << 16 else np.int64).argsort(kind="stable")
    return (np.repeat(ends, before) - distance - 1)[order]


class _Text:
    """What inducing needs to know of a text; computed once for both rounds."""

    def __init__(self, t: np.ndarray):
        n = len(t)
        self.t, self.n = t, n
        self.smaller = _smaller(t)
        counts = np.bincount(t)
        larger = np.bincount(t[~self.smaller], minlength=len(counts))
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.middles = self.starts + larger  # larger suffixes of a symbol come before its smaller ones
        self.slot_larger = np.repeat(np.tile([True, False], len(counts)), np.stack([larger, counts - larger], 1).ravel())
        # does a larger (or smaller) symbol lie to the left? Entries n and n + 1 stand for empty slots
        self.after_larger, self.after_smaller = np.zeros(n + 2, bool), np.zeros(n + 2, bool)
        np.greater(t[:-1], t[1:], out=self.after_larger[1:n])
        np.less(t[:-1], t[1:], out=self.after_smaller[1:n])
        begin = np.zeros(n, np.int32)
        at = np.flatnonzero(t[1:] != t[:-1]) + 1
        begin[at] = at
        self.before = np.arange(n, dtype=np.int32) - np.maximum.accumulate(begin)  # equal symbols on the left


def _gap(sa: np.ndarray, at: int, step: int) -> int:
    """The next empty slot from at on, in the direction of step; -1 or len(sa) if there is none."""
    span = 256
    while 0 <= at < len(sa):
        some = sa[at : at + span] if step > 0 else sa[max(0, at - span + 1) : at + 1][::-1]
        empty = some == -1
        k = int(empty.argmax())
        if empty[k]:
            return at + k * step
        at += len(some) * step
        span = min(2 * span, 1 << 16)
    return len(sa) if step > 0 else -1


def _induce(x: _Text, seeds: np.ndarray) -> np.ndarray:
    """The array that the seeds (leftmost-smaller suffixes, in order within a symbol) induce."""
    t, n = x.t, x.n
    # -1: still to be filled; -2: empty in this scan
    sa = np.where(x.slot_larger, -1, -2).astype(np.int32)
    _place(sa, seeds[::-1], t[seeds[::-1]], x.ends - 1, -1)

    free, a, seen = x.starts.copy(), 0, 0
    while a < n:
        b = _gap(sa, max(a, seen), 1)
        if b < n:
            c = int(np.searchsorted(x.starts, b, side="right")) - 1
            if a == x.starts[c]:  # all that comes before the bucket is scanned
                sa[b : x.middles[c]] = _chains(sa[a:b], x.before)
                seen = int(x.middles[c])
                continue
            seen, b = b, int(x.starts[c])
        j = sa[a:b]
        j = j[x.after_larger[j]] - 1
        if len(j):
            _place(sa, j, t[j], free, 1)
        a = b

    sa[~x.slot_larger] = -1
    sa[0] = n - 1
    free, b, seen = x.ends - 1, n, n
    while b > 0:
        a = _gap(sa, min(b, seen) - 1, -1) + 1
        if a > 0:
            c = int(np.searchsorted(x.starts, a - 1, side="right")) - 1
            if b == x.ends[c]:
                sa[x.middles[c] : a] = _chains(sa[a:b][::-1], x.before)[::-1]
                seen = int(x.middles[c])
                continue
            seen, a = a, int(x.ends[c])
        j = sa[a:b][::-1]
        j = j[x.after_smaller[j]] - 1
        if len(j):
            _place(sa, j, t[j], free, -1)
        b = a
    return sa


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each leftmost-smaller substring, in text order, and how many there are.

    ordered: their starts, sorted; equal ones share a rank and lie side by side.
    """
    place = np.searchsorted(lms, ordered)
    length = (np.append(np.diff(lms), 0) + 1)[place]
    per = 8 // t.dtype.itemsize
    padded = np.concatenate([t, np.zeros(per, t.dtype)])
    words = np.lib.stride_tricks.as_strided(padded, (len(t), per), (t.itemsize, t.itemsize))
    differ = np.append(True, length[1:] != length[:-1])
    pair, at = np.flatnonzero(~differ), 0
    while len(pair):
        left, right = (np.ascontiguousarray(words[ordered[p] + at]).view(np.uint64).ravel() for p in (pair - 1, pair))
        over = (at + per - length[pair]).clip(0) * 8 * t.itemsize  # bits beyond the substring
        unequal = ((left ^ right) << over.astype(np.uint64)) != 0
        differ[pair[unequal]] = True
        at += per
        pair = pair[~unequal & (length[pair] > at)]
    rank = np.empty(len(lms), np.int32)
    rank[place] = differ.cumsum() - 1
    return rank, int(differ.sum())


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array (32-bit) of non-negative integers whose last one is 0 and occurs nowhere else."""
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int32)
    used = np.bincount(t) > 0
    distinct = int(used.sum())
    if distinct < 1 << 16:  # NumPy sorts short integers by radix
        t = (used.cumsum() - 1).astype(np.uint8 if distinct <= 1 << 8 else np.uint16)[t]
    else:
        t = t.astype(np.int32)
    x = _Text(t)
    lms = np.flatnonzero(x.smaller & np.append(False, ~x.smaller[:-1])).astype(np.int32)
    if len(lms) == 1:
        return _induce(x, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = _induce(x, lms)
    ordered = ordered[is_lms[ordered]]
    names, distinct = _names(t, lms, ordered)
    if distinct < len(lms):
        ordered = lms[suffix_array(names)]
    return _induce(x, ordered)


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, the length (at most `most`) it shares with the one before it in the array.

    data: bytes; eight are compared at a time, for all suffixes at once.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.zeros(n + most + 8, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.int64)
    active = np.flatnonzero(before >= 0)
    at = 0
    while len(active) and at < most:
        differ = words[active + at] ^ words[before[active] + at]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(float)).astype(np.int64) // 8)
        out[active] += equal
        active = active[equal == 8]
        at += 8
    return np.minimum(np.minimum(out, most), n - np.maximum(np.arange(n), before))
