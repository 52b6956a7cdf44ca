"""Memory of Python workers, which live on from stage to stage."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Hand what a finished task has freed back to the system; else the idle worker keeps it from stages that need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
