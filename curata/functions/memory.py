"""Memory of Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Gives memory that a task has freed back to the machine: Spark keeps a Python worker for later tasks
    and stages, and the allocators would keep what the largest of them needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
