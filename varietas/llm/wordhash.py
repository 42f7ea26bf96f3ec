"""Words of a batch of texts as 64-bit hashes, found and hashed in one pass over the bytes.

A word is a longest run of ASCII letters and digits and of characters outside ASCII, with A-Z
lowered: in UTF-8, of the bytes that ``_WORD`` marks. The hash of a word is a polynomial of its bytes
modulo 2**64, taken from prefix sums, then mixed; equal words have equal hashes in every batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Multiplier of the polynomial (odd, so it has an inverse) and the constants of the final mixing.
BASE = 0x9E3779B97F4A7C15
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least, kept between batches."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX[0])
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """hashes of all words in order; words of text i are first[i]:first[i + 1]; data[start:end] is a word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words_of(texts: list[str]) -> Words:
    """The words of ``texts``, which may be empty; no word spans two texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)]
    is_word = np.zeros(len(data) + 1, dtype=np.int8)
    is_word[1:] = _WORD[data]
    edges = np.diff(is_word)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * up[start])
    lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(lengths)
    first = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    return Words(data, start, end, hashes, first)
