"""What a Python worker keeps between tasks.

Spark uses a worker again for the tasks of later stages. So that its memory stays bounded whatever ran
before, one model with its cache is kept at a time, and operators without one let it go.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_HELD: dict = {}


def keep(name: tuple, make: Callable):
    """The model called ``name``; another one that was kept goes first."""
    if name not in _HELD:
        release()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Let go of what is kept, and give free memory back to the system."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
