"""Byte-level text kernels shared by the operators of this subpackage.

Everything here works on one Arrow batch of whole texts at a time: the UTF-8 data
buffer of the batch is viewed as one numpy array, and words, lines, shingles and their
64-bit hashes come from array operations over it.  Word separators are ASCII (space and
bytes 9 to 13), so byte positions are safe in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: A batch is cut into pieces of about this many bytes, so that work arrays stay small.
PIECE_BYTES = 1 << 19

_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves all else."""
    return _LOWER


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    key = str(int(base))
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16) * 5 // 4
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[key] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def running(data: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hashes` takes its hashes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _power(_BASE, len(data)), out=total[1:])
    return total


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair; equal bytes give equal hashes.  total: `running` of data, if there is one."""
    n = len(data)
    total = running(data) if total is None else total
    shift = _power(_BASE_INVERSE, n + 1)[start]
    return mix((total[end] - total[start]) * shift + (end - start).astype(np.uint64))


def pieces(array: pa.Array | pa.ChunkedArray, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of pieces of a string column; null rows are empty.

    offsets has one more entry than the piece has rows and starts at 0.  A row longer
    than piece_bytes is a piece of its own; no row is cut.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if isinstance(array, pa.ChunkedArray):  # combine_chunks of no chunks
        return
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, values = array.buffers()
    offsets = np.frombuffer(offsets, kind, n + 1, array.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + piece_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words; first[i] is the first word of row i (one more entry)."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~_IS_SEPARATOR[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a word cannot run over from one row into the next
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    if len(inner):
        cut = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]
        if len(cut):
            start = np.sort(np.concatenate([start, cut]))
            end = np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, offsets)


def shingle_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words (len(word_hash) - size + 1 of them, or none)."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= _WORD_BASE
        out += word_hash[k : k + n]
    return mix(out)
