"""Sorted 64-bit values as compressed byte planes of their differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd")


def pack(values: np.ndarray) -> bytes:
    """Sorted uint64 values; planes of zeros cost next to nothing."""
    planes = np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(blob[8:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_plain(values: np.ndarray) -> bytes:
    """Byte planes of any array of one type, compressed."""
    return _ZSTD.compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), asbytes=True)


def unpack_plain(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(blob, n * size, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal entries."""
    fresh = np.ones(len(sorted_keys), bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(fresh)
