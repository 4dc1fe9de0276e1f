"""Words, lines and n-grams of Arrow string columns as numpy arrays, without a Python loop over words.

A 64-bit word hash is a polynomial over a fixed random value for each byte; differences of prefix sums give
the hash of any span in constant time.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240131)
_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes [\x20\x09-\x0D] end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Gives freed memory back to the system, at the end of a task: workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU C library has it
    if trim is not None:
        trim(0)


def powers(n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "p" not in cache or len(cache["p"]) < n:
        n = -(-n >> 16) << 16
        for key, base in (("p", _BASE), ("q", _INVERSE)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            cache[key] = np.cumprod(a)
    return cache["p"], cache["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that nearby sums differ in all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one large-string array in which a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def pieces(column: pa.Array, most: int = 1 << 19, rows: int = 4096):
    """(first row, bytes, starts) for runs of at most so many rows and about so many bytes together; a row is never cut.

    starts has one more entry than the run has rows; row i is bytes[starts[i]:starts[i + 1]].
    """
    column = strings(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, min(row + rows, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(keep: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes that do not cross rows: (row, start, end) of each."""
    n = len(keep)
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    inner = starts[1:-1][starts[1:-1] < n]
    first[inner] = keep[inner]
    last = keep.copy()
    last[:-1] &= ~keep[1:]
    before = inner[inner > 0] - 1
    last[before] = keep[before]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(starts, a, "right") - 1, a, b


def span_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray, cache: dict) -> np.ndarray:
    """64-bit hashes of data[a:b], equal for equal bytes."""
    p, q = powers(len(data) + 1, cache)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * p[: len(data)], out=sums[1:])
    return mix((sums[b] - sums[a]) * q[a] + (b - a).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, cache: dict, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word and its hash. One row of more bytes than most is read in parts, cut at spaces."""
    if len(data) <= most or len(starts) > 2:
        rows, a, b = spans(~SPACE[data], starts)
        return rows, span_hashes(data, a, b, cache)
    found, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and not SPACE[data[end]]:
            space = np.flatnonzero(SPACE[data[end : end + most]])
            end += int(space[0]) if len(space) else min(most, len(data) - end)
        part = data[at:end]
        _, a, b = spans(~SPACE[part], np.array([0, len(part)]))
        found.append(span_hashes(part, a, b, cache))
        at = end
    words = np.concatenate(found)
    return np.zeros(len(words), np.int64), words


def sequences(words: np.ndarray, rows: np.ndarray, n: int, cache: dict) -> np.ndarray:
    """A signed 64-bit hash of each of n rows' words in order; rows are ascending."""
    at = bounds(rows, n)
    p, _ = powers(len(words) + 1, cache)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[np.arange(len(words)) - at[rows]], out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and the index of each one's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = words[:m] + np.uint64(n)
    for k in range(1, n):
        h = mix(h) + words[k : k + m]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(h[at]), at


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted row index; one entry more at the end."""
    return np.searchsorted(rows, np.arange(n + 1))
