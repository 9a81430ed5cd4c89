"""Distinct word shingles of whole texts as 64-bit hashes, computed on bytes with array operations.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Many texts are
hashed in one go; a text's length is not limited. Two different shingles or sets are taken as
equal only if 64-bit hashes collide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
BYTES_AT_ONCE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SYMBOL = mix(np.arange(1, 257, dtype=U64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            steps = np.full(n, b, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a byte array."""
    inside = ~_GAP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(raw) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(_SYMBOL[raw] * power[: len(raw)], dtype=U64)])
    return start, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))


def _sets(raw: bytes, ends: np.ndarray, words: int) -> Iterator[np.ndarray]:
    start, word = _word_hashes(np.frombuffer(raw, np.uint8))
    cut = np.searchsorted(start, ends)
    with np.errstate(over="ignore"):
        runs = word[: max(0, len(word) - words + 1)].copy()
        for k in range(1, words):
            runs = mix(runs * U64(0xD6E8FEB86659FD93) + word[k : k + len(runs)])
    first = 0
    for last in cut.tolist():
        n = last - first
        if n >= words:
            s = np.sort(runs[first : last - words + 1])
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s
        elif n:
            h = U64(n)
            with np.errstate(over="ignore"):
                for w in word[first:last]:
                    h = mix(h * U64(0xA0761D6478BD642F) + w)
            yield np.array([h], U64)
        else:
            yield np.empty(0, U64)
        first = last


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than `words` are one shingle."""
    held, ends, at = [], [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "replace").lower() + b" "
        held.append(b)
        at += len(b)
        ends.append(at)
        if at >= BYTES_AT_ONCE:
            yield from _sets(b"".join(held), np.array(ends), words)
            held, ends, at = [], [], 0
    if held:
        yield from _sets(b"".join(held), np.array(ends), words)


def set_hash(s: np.ndarray) -> int:
    """A signed 64-bit name of a non-empty set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)[None] + U64(len(s))).view(np.int64)[0])
