"""Words and their hashes over whole runs of texts, in numpy.

Texts are laid end to end as UTF-8 bytes with one separator byte between them. A word's hash is
a polynomial in its bytes; prefix sums of the terms give the hash of any word or word prefix
with one subtraction and one product, because the base is odd and so has an inverse mod 2^64.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        step = np.full(size, BASE, np.uint64)
        back = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        powers, inverse = np.cumprod(step), np.cumprod(back)
        if size > 1 << 23:  # one giant text: use the tables once, keep the small ones
            return powers, inverse
        _powers, _inverse = powers, inverse
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the public splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lay_out(texts: list[str], ascii_lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a line feed after each, and where each text starts."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    joined = b"\n".join(raw) + b"\n"
    return np.frombuffer(joined.lower() if ascii_lower else joined, np.uint8), starts


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last index of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def is_blank(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


class Hasher:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        powers, self.inverse = _tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        return mix((self.sums[past] - self.sums[first]) * self.inverse[first])


def words(texts: list[str], ascii_lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` of all texts and the index of each text's first word."""
    buf, starts = lay_out(texts, ascii_lower)
    first, past = spans(~is_blank(buf))
    return Hasher(buf)(first, past), np.searchsorted(first, starts)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of each run of ``k`` word hashes, by rolling from shorter runs."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for j in range(1, k):
        h = h * np.uint64(BASE) + hashes[j : j + n]
    return mix(h)
