"""Word shingles as 64-bit hashes, and bottom-k sketches of one hash function."""

from __future__ import annotations

import numpy as np

from .common import lower_words

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1 << 16, np.uint64)
_INVERSE = np.ones(1 << 16, np.uint64)


def _grow(n: int) -> None:
    global _POWERS, _INVERSE
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if len(_POWERS) >= size and _POWERS[1] != 1:
        return
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
        _INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than that: the whole sequence; no words: empty.

    A shingle's hash covers the bytes of its words joined by one space: a difference of prefix hashes to an odd base
    modulo 2**64, brought to a common exponent, with the shingle's length mixed in.
    """
    tokens = lower_words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(tokens), np.uint8)
    _grow(len(joined) + 2)
    ends = np.append(np.flatnonzero(joined == 32), len(joined))
    starts = np.concatenate([[0], ends[:-1] + 1])
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(joined)], out=prefix[1:])
        n = max(0, len(tokens) - words)
        first, last = starts[: n + 1], ends[min(words, len(tokens)) - 1 :]
        value = (prefix[last] - prefix[first]) * _INVERSE[first]
        return np.unique(mix(value ^ mix((last - first).astype(np.uint64))))


def signature(own: np.ndarray) -> bytes:
    """16 bytes that stand for the whole set."""
    import hashlib

    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on whole sets; two empty sets aren't alike."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
