"""Word shingles of texts as hashes, and circulant MinHash signatures of shingle sets, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words, A to Z lower-cased. ``bytes.split`` splits at the six ASCII blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingle_row(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64) + np.uint64(size)
    for j in range(size):
        out = mix64(out * _ODD + hashes[j : n - size + 1 + j])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_row(word_hashes(text), size))


def _scramble(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(members: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate ``k`` is the least ``pi(sigma(x) + k)`` over the set.

    Two permutations of the 32-bit numbers serve for all coordinates: ``sigma``
    breaks up the order of the data once, ``pi`` is shifted circularly by one
    more step for each coordinate.
    """
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    sigma = _scramble((members >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    for at in range(0, len(sigma), 2048):
        block = sigma[at : at + 2048]
        step = max(1, 16384 // len(block))
        for k in range(0, coordinates, step):
            shift = np.arange(k, min(k + step, coordinates), dtype=np.uint32)
            values = _scramble(block[None, :] + shift[:, None]).min(axis=1)
            np.minimum(least[k : k + step], values, out=least[k : k + step])
    return least


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band of ``rows`` coordinates; equal bands of different numbers differ."""
    bands = signature.reshape(-1, rows).astype(np.uint64)
    out = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
    for j in range(rows):
        out = mix64(out * _ODD + bands[:, j])
    return out
