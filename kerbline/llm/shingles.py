"""Word shingles as sets of 64-bit hashes, and MinHash signatures of them, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of a set that are signed at a time.
CHUNK = 8192


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers so that every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case: runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; with fewer words, the one of the whole sequence."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    of_words = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    width = min(width, len(found))
    rows = len(found) - width + 1
    out = np.full(rows, np.uint64(width))
    for i in range(width):
        out = mixed(out * _STEP + of_words[i : i + rows])
    return np.unique(out)


def set_name(shingles: np.ndarray) -> str:
    """128 bits that name a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def hash_family(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, size, dtype=np.uint64), rng.integers(0, 1 << 63, size, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of the set under each function of the family, as 32 bits."""
    add, times = family
    least = np.full(len(add), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        hashed = (shingles[None, at : at + CHUNK] ^ add[:, None]) * times[:, None]
        hashed ^= hashed >> np.uint64(32)
        hashed *= times[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)
