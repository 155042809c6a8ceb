"""What a Python worker keeps between tasks: the tables of one operator, and no memory that it has freed."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Seconds between two times that a busy worker gives memory back.
EVERY = 0.25
_KEPT: dict[object, object] = {}

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not every C library has it
    _trim = None


def kept(name, make: Callable[[], object]):
    """What ``make`` gives, made once a worker while its tasks ask for this name; another name drops it.

    Functions that Spark sends to tasks are copied with the globals they name, so they reach
    what a worker keeps only through a function of a module, such as this one.
    """
    if name not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    """Return freed memory to the system; idle workers stay around between stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, which gives freed memory back now and then, and when a task's batches end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = time.monotonic()
        try:
            for batch in run(batches):
                yield batch
                del batch
                if time.monotonic() - at > EVERY:
                    give_back()
                    at = time.monotonic()
        finally:
            give_back()

    return task
