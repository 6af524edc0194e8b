"""Word shingles of texts and their hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5

_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after A-Z became a-z: ``bytes.lower`` and ``bytes.split`` know ASCII alone."""
    return text.encode("utf-8").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def shingle_hashes(found: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; of all words, if they are fewer; none without words."""
    if not found:
        return np.empty(0, dtype=np.uint64)
    each = word_hashes(found)
    n = min(size, len(found))
    runs = len(found) - n + 1
    total = np.full(runs, n, dtype=np.uint64)
    for k in range(n):
        total += mixed(each[k : k + runs] + _ODD[k % len(_ODD)]) * _ODD[(k + 3) % len(_ODD)]
        total = mixed(total)
    return np.unique(total)


def shingle_set(found: list[bytes], size: int = WORDS) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    n = min(size, len(found))
    return set(zip(*(found[k : len(found) - n + 1 + k] for k in range(n)), strict=True)) if n else set()
