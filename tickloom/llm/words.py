"""Words of many texts as arrays: A-Z lower-cased, split at ASCII white space, each word a 64-bit hash.

All work is on the UTF-8 bytes of a batch at once, so that no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that make up words.
SOLID = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers of the mixing function.
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = U(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(4096, _BASE, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """The values under hash function number `seed`."""
    return mix(x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))


@dataclass
class Words:
    """hashes, and byte spans in data, of all words; those of text i are at ptr[i]:ptr[i + 1]."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    def texts(self) -> int:
        return len(self.ptr) - 1

    def owner(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(self.texts()), np.diff(self.ptr))


def words_of(texts: list[str], inside: np.ndarray = SOLID) -> Words:
    """The maximal runs of bytes that are `inside`, a table by byte value; byte 10 is never one of them."""
    global _powers
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    solid = inside[raw]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes)))
    if len(starts):
        if (longest := int(sizes.max())) > len(_powers):
            _powers = np.cumprod(np.full(longest, _BASE, np.uint64), dtype=np.uint64)
        place = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
        hashes = np.add.reduceat(_BYTE[_LOWER[raw[solid]]] * _powers[place], at[:-1])
        hashes = mix(hashes + sizes.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    limits = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)
    return Words(data, hashes, starts, ends, np.searchsorted(starts, limits))


def shingles_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs of each text in order, and their limits by text; a text of fewer words, but some, gives one: all of them."""
    h, counts = words.hashes, np.diff(words.ptr)
    if n == 1:
        return h, words.ptr
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    ptr = np.concatenate(([0], np.cumsum(runs)))
    out = np.zeros(ptr[-1], np.uint64)
    first = np.repeat(words.ptr[:-1] - ptr[:-1], runs) + np.arange(ptr[-1])
    length = np.minimum(np.repeat(counts, runs), n)
    for k in range(n):
        use = length > k
        if use.all():
            out = mix(out * _M2 + h[first + k])
        else:
            out[use] = mix(out[use] * _M2 + h[first[use] + k])
    return out, ptr
