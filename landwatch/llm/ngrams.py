"""Character codes of texts as arrays, and hashing of n-grams over them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters handled at once: bounds the memory of a very long text.
BLOCK = 1 << 20


@cache
def _letters() -> np.ndarray:
    """For each code point below U+30000: whether it is a letter, a digit or a mark inside words."""
    return np.array([chr(i).isalnum() for i in range(0x30000)])


def codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text; every run of other characters than letters and digits is one 0.

    The result starts and ends with 0 and is empty for a text without a word.
    """
    if not text:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    word = _letters()[np.minimum(raw, 0x2FFFF)]
    if not word.any():
        return np.zeros(0, np.uint32)
    raw = np.where(word, raw, 0)
    keep = word.copy()
    keep[1:] |= word[:-1]  # one blank after each word
    out = np.concatenate((np.zeros(1, np.uint32), raw[keep]))
    return out if out[-1] == 0 else np.append(out, np.uint32(0))


def blocks(c: np.ndarray, overlap: int) -> Iterator[np.ndarray]:
    """Pieces of at most ``BLOCK`` positions; each n-gram of up to ``overlap`` codes lies in at least one.

    Pieces overlap by ``overlap`` - 1 codes, so n-grams shorter than that are counted twice where
    two pieces of a text of more than a million characters meet.
    """
    for lo in range(0, len(c), BLOCK):
        yield c[lo : lo + BLOCK + overlap - 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that their low bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))
