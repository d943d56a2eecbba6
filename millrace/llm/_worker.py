"""What a Python worker keeps from task to task, for one operator at a time.

Workers are reused by tasks of later operators. What an operator has kept (a
table of token ids, an automaton, random vectors) goes when a task of another
one begins, and the freed memory goes back to the system.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa

_now: str | None = None
_held: dict[Hashable, object] = {}


def begin(operator: str) -> None:
    """To be called when a task begins."""
    global _now
    if _now != operator:
        _held.clear()
        if _now is not None:
            trim()
        _now = operator


def held(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once while the worker serves one operator. Another key takes its place."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def trim() -> None:
    """Gives freed memory back to the system, where the C library can do so."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
