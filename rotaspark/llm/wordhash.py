"""Vectorised word and k-gram hashes of one text, as numpy arrays.

The helpers know nothing of Spark; the operators call them inside Arrow batches. All arithmetic is
modulo 2**64, so equal inputs give equal hashes on every machine.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95
_LONGEST = 1 << 12
_RUN = 1 << 20


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (two xor-shift-multiply rounds)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA24BAED4963EE407)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_LONGEST)


def code_points(text: str | None) -> np.ndarray:
    """The code points of a text; lone surrogates count as code points of their own."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lower_ascii(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


def alnum_mask(points: np.ndarray) -> np.ndarray:
    """True inside words of letters, digits and everything beyond ASCII."""
    return (points >= 128) | ((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 122)) | (
        (points >= 65) & (points <= 90)
    )


def word_bounds(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True."""
    if not mask.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    edge = np.concatenate(([0] if mask[0] else [], edge, [mask.size] if mask[-1] else [])).astype(np.int64)
    return edge[::2], edge[1::2]


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word: a polynomial over mixed code points, finalised with the length.

    Words are worked on in runs of about _RUN code points, so the arrays do not grow with the text.
    """
    if not starts.size:
        return np.empty(0, np.uint64)
    done = np.cumsum(ends - starts)
    cuts = np.unique(np.append(np.searchsorted(done, np.arange(_RUN, done[-1], _RUN)) + 1, starts.size))
    return np.concatenate([_hashed(points, starts[a:b], ends[a:b]) for a, b in zip([0, *cuts[:-1]], cuts)])


def _hashed(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    longest = int(lengths.max())
    powers = _POWERS if longest <= _LONGEST else _powers(longest)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    inside = np.arange(first.size, dtype=np.int64)
    at = inside + first
    place = at - np.repeat(starts, lengths)
    value = (points[at].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    value ^= value >> np.uint64(31)
    value *= powers[place]
    total = np.add.reduceat(value, np.cumsum(lengths) - lengths)
    return mix(total + lengths.astype(np.uint64) * _MULTIPLIER)


def kgram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k values in order; empty where fewer than k values are given."""
    n = values.size - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total *= np.uint64(_STEP)
        total += values[i : i + n]
    return mix(total)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the word k-grams of a lower-cased text.

    A text with one to k-1 words has one shingle, all its words; a text without words has none.
    """
    points = lower_ascii(code_points(text))
    words = word_hashes(points, *word_bounds(alnum_mask(points)))
    if not words.size:
        return words
    return np.unique(kgram_hashes(words, min(k, words.size)))
