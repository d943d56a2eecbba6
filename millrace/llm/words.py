"""Words of a text and their hashes, without a Python object per word.

A word is a run of bytes other than ASCII white space in the text's UTF-8 form.
Its 64-bit hash is a polynomial in its bytes, taken from running sums over the
whole text, and scrambled.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes whose running sums are taken at once; blocks end between words unless a word is longer.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(20260103).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> U(31)
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ x >> U(29)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least; those of a longer word than a block are not kept."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n + 1, 1 << 16)
    made = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 2**64))]
    if n <= BLOCK:
        _powers[:] = made
    return made[0], made[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; spans ascend and don't overlap."""
    hashes = np.zeros(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, at + BLOCK, side="right")))
        part = data[at : ends[last - 1]]
        up, down = _power(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[part] * up[: len(part)], out=sums[1:])
        a, b = starts[first:last] - at, ends[first:last] - at
        hashes[first:last] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        first = last
    return scramble(hashes)


def words_in(raw: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of UTF-8 bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    edge = np.zeros(len(data) + 2, dtype=np.int8)
    edge[1:-1] = ~SPACE[data]
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return starts, ends, span_hashes(data, starts, ends)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
