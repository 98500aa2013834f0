"""What a worker process keeps between tasks: the models and caches of one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

_HELD: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """The object of a key, made if it is not there; objects of other keys go, so that stages that share a worker do not add up."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            release()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Drops what other operators have left in this worker."""
    if _HELD:
        _HELD.clear()
        release()


def release() -> None:
    """Gives free memory back to the system, which the allocators would keep."""
    gc.collect()
    trim()


def then_trim(run: Callable, *args: Any) -> Any:
    """What run returns. The memory that it leaves free goes back to the system: a worker that waits would keep it, beside those at work."""
    out = run(*args)
    trim()
    return out


def trim() -> None:
    """The same without a search for cycles."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
