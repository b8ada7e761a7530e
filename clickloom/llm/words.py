"""Words and word shingles of whole texts as 64-bit hashes, computed over Arrow batches.

A word is a run of bytes other than the six ASCII white-space bytes (20, 09-0D), with A-Z in
lower case. UTF-8 never uses those byte values inside a longer character, so bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5  # words per shingle
SLICE_BYTES = 1 << 17  # text worked on at a time; one longer text is a slice of its own


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` well-spread 64-bit numbers, the same for a seed on every machine."""
    steps = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)
    return mix(steps * np.uint64(0x9E3779B97F4A7C15))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_EXACT_BYTE = stream(1, 256)
_BYTE = _EXACT_BYTE[_LOWER]  # a number for each byte, blind to the case of A-Z
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = stream(2, WIDTH) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n - 1, 1).bit_length()
    kept = _powers.get(size)
    if kept is None:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        kept = np.cumprod(up), np.cumprod(down)
        if size <= 2 * SLICE_BYTES:
            _powers[size] = kept
    return kept


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in a byte array."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray = _BYTE
) -> np.ndarray:
    """A 64-bit hash of each span, from one running polynomial over the bytes' numbers."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(numbers[data] * up[: len(data)], out=running[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((running[ends] - running[starts]) * down[starts] + lengths * np.uint64(_BASE))


def hash_spans_exact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As ``hash_spans``, but telling A-Z from a-z."""
    return hash_spans(data, starts, ends, _EXACT_BYTE)


def slices(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a list of texts (None: empty) into runs of about ``SLICE_BYTES``.

    Yields first index, last index + 1, the bytes with one space after each text, and the offset
    at which each text starts (with the end as last entry).
    """
    first = 0
    while first < len(texts):
        parts, total, last = [], 0, first
        while last < len(texts) and (total < SLICE_BYTES or last == first):
            parts.append((texts[last] or "").encode("utf-8", "surrogatepass"))
            total += len(parts[-1]) + 1
            last += 1
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
        yield first, last, np.frombuffer(b" ".join(parts) + b" ", np.uint8), offsets
        first = last


def hashed_words(texts: list) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    for _, _, data, offsets in slices(texts):
        starts, ends = word_spans(data)
        hashes = hash_spans(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield hashes[lo:hi]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``WIDTH`` words in order; a shorter text is one run, an empty none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(n, WIDTH)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * _PLACE[k]
    return mix(total)
