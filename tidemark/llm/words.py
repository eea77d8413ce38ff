"""Words and word hashes of whole Arrow text columns with numpy; no Python object is made for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def byte_class(separators: bytes | None = None, word_bytes: bytes | None = None) -> np.ndarray:
    """Which bytes belong to words: all but ``separators``, or ``word_bytes`` and all bytes of non-ASCII characters."""
    table = np.ones(256, bool)
    if separators is not None:
        table[list(separators)] = False
    else:
        table[:128] = False
        table[list(word_bytes)] = True
    return table


#: Words between white space: space and U+0009 to U+000D.
SPACED = byte_class(separators=b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of ASCII letters, digits and anything beyond ASCII.
LETTERED = byte_class(word_bytes=bytes([*range(48, 58), *range(65, 91), *range(97, 123)]))

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _letter_values() -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


def slices(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``size`` bytes each, at least one document in a range."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data[offsets[0]:offsets[-1]]`` and the first word of each document (n + 1).

    Positions count from ``offsets[0]``. A word ends where its document does.
    """
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = member[data[base : base + size]]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    borders = offsets[1:-1] - base
    borders = borders[(borders > 0) & (borders < size)]
    starts[borders] = inside[borders + 1]
    ends[borders - 1] = inside[borders]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets - base)


def word_hashes(data: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same for either case of A to Z."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = int(ends[-1])
    powers = np.full(size + 1, _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_letter_values()[data[base : base + size]] * powers[:-1], out=sums[1:])
    powers[:] = _INVERSE
    powers[0] = 1
    np.cumprod(powers, out=powers)
    return mixed((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its runs of ``width`` words; fewer words are one run."""
    found = []
    n = len(words)
    if n >= width:
        runs = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            runs = runs * _STEP + words[k : n - width + 1 + k]
        runs = mixed(runs + np.uint64(width))
    for first, last in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        count = last - first
        if count >= width:
            own = np.sort(runs[first : last - width + 1])
            fresh = np.ones(len(own), bool)
            fresh[1:] = own[1:] != own[:-1]
            found.append(own[fresh])
        elif count:
            whole = 0
            for value in words[first:last].tolist():
                whole = (whole * int(_STEP) + value) & 0xFFFFFFFFFFFFFFFF
            found.append(mixed(np.array([(whole + count) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            found.append(np.empty(0, np.uint64))
    return found
