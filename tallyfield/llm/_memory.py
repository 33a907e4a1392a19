"""Workers give large arrays back to the system as soon as they are freed.

Python workers live on from task to task.  By default the C allocator raises its threshold
for separate mappings whenever a large block is freed, and Arrow's pool keeps freed pages,
so a worker holds the most that any of its tasks has used.  Blocks of MAPPED_BYTES and more
(whole batches, merged arrays) are mapped and unmapped instead; the work arrays of one
piece of text stay below and are used again.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

MAPPED_BYTES = 8 << 20
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3


def settle() -> None:
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_M_MMAP_THRESHOLD, MAPPED_BYTES)
        libc.mallopt(_M_TRIM_THRESHOLD, 2 * MAPPED_BYTES)
    except (OSError, AttributeError):  # another C library: nothing to set
        pass


def trim() -> None:
    """Give freed pages back now: between pieces of work that leave much behind."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


settle()
