"""Vectorised word splitting and hashing over Arrow string columns (NumPy on raw UTF-8, no loop over words).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, so that word hashes have no structure of the byte values.
BYTE_VALUE = _random.integers(0, 2**64, 256, dtype=U)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
#: The base of a second, independent window hash.
SECOND_BASE = 0xD6E8FEB86659FD93
#: Bytes hashed at a time: bounds the 8-byte-per-byte arrays, also for a single huge document.
PIECE = 1 << 18
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as batches ask again and again."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base & (2**64 - 1), U)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = offsets[0], offsets[-1]
    if data is None or first == last:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[first:last], offsets - first


def spans_of_documents(offsets: np.ndarray, limit: int = 2 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 word offsets of the documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before &= ~edge[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after &= ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, taken from prefix sums, mixed with its length."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(high - low + 1, U)
        np.cumsum(BYTE_VALUE[data[low:high]] * powers(BASE, high - low), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * powers(BASE_INVERSE, high - low)[s] + (e - s).astype(U))
        i = j
    return out


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, with their n+1 offsets; a shorter document that has words gives its whole run."""
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(sizes, out=at[1:])
    start = np.repeat(first[:-1] - at[:-1], sizes) + np.arange(at[-1])
    length = np.repeat(np.minimum(counts, k), sizes)
    out = np.full(len(start), 0x51ED270B, U)
    for j in range(k):
        if (have := length > j).all():
            out = mix(out * U(BASE) + words[start + j])
        else:
            out[have] = mix(out[have] * U(BASE) + words[start[have] + j])
    return out, at


def rolling(words: np.ndarray, first: np.ndarray, size: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window of ``size`` words inside one document, their first words, n+1 offsets."""
    back = BASE_INVERSE if base == BASE else pow(base, -1, 2**64)
    counts = np.maximum(np.diff(first) - size + 1, 0)
    at = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=at[1:])
    start = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    return mix((sums[start + size] - sums[start]) * powers(back, len(words) + 1)[start]), start, at
