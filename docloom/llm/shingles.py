"""Word and shingle hashes of a text in numpy: no loop over words.

Words are runs of bytes other than the six ASCII white-space bytes, A-Z as lower case. A word's hash is a polynomial over
random 64-bit byte values modulo 2**64, from prefix sums (of a long word, its BLAKE2 hash); a shingle's hash mixes those of its words.

Cases: a null or empty text, or one of white space alone, has no words and no shingles; a lone surrogate counts as its three bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20_240_229))
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PLACE = _RNG.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a word beyond which it is hashed by BLAKE2 instead.
LONG_WORD = 64
#: Bytes that are hashed at a time.
CHUNK = 1 << 20
_powers = np.zeros(0, np.uint64)
_inverse = np.zeros(0, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        n = max(n + 1, 1 << 14, 2 * len(_powers))
        _powers = np.full(n, _P, np.uint64)
        _inverse = np.full(n, pow(_P, -1, 1 << 64), np.uint64)
        _powers[0] = _inverse[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverse, out=_inverse)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    edge = np.diff(_SPACE[a].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    _grow(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * _powers[: len(a)], out=sums[1:])
    out = (sums[end] - sums[start]) * _inverse[start]
    # the low bits of a long polynomial can be made equal; words that long are rare
    for k in np.flatnonzero(end - start > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


def words(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass").lower()
    if len(data) <= CHUNK:
        return _chunk(data)
    some, at = [], 0
    while at < len(data):
        to = at + CHUNK
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        some.append(_chunk(data[at:to]))
        at = to
    return np.concatenate(some)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The text's distinct shingles, sorted; with fewer words the whole sequence is one; none without words."""
    w = words(text)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(w))):
        total += w[k : k + n] * _PLACE[k]
    return np.unique(mix(total + np.uint64(min(size, len(w)))))


class Sketcher:
    """Tensored banding: two collections of m half-keys, each of r minhashes. A table's key is a half-key of
    the first with one of the second, so 2*m*r minhashes serve m*m tables of 2*r rows each."""

    def __init__(self, halves: int = 12, rows: int = 4):
        self.halves, self.rows = halves, rows
        rng = np.random.Generator(np.random.PCG64(71))
        self.a = rng.integers(1, 1 << 63, 2 * halves * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, 2 * halves * rows, np.uint64)

    def half_keys(self, items: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(items), 4_096):
            np.minimum(low, (items[at : at + 4_096, None] * self.a + self.b).min(axis=0), out=low)
        grid = low.reshape(2 * self.halves, self.rows)
        return mix((grid * _PLACE[: self.rows]).sum(axis=1, dtype=np.uint64)).view(np.int64)
