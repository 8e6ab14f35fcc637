"""Plan caches."""

from __future__ import annotations

import hashlib
import itertools
import threading
import weakref
from collections import OrderedDict
from collections.abc import Iterable
from typing import Any, Protocol

from siftlake.sources import scan


class PlanCache(Protocol):
    def get(self, key: str) -> Any | None: ...

    def set(self, key: str, value: Any) -> None: ...


class LruPlanCache:
    """Least recently used entries go when more than ``capacity`` are held."""

    def __init__(self, capacity: int = 256):
        if capacity <= 0:
            raise ValueError("capacity must be positive")
        self.capacity = capacity
        self._held: OrderedDict[str, Any] = OrderedDict()
        self._lock = threading.Lock()

    def get(self, key: str) -> Any | None:
        with self._lock:
            if key not in self._held:
                return None
            self._held.move_to_end(key)
            return self._held[key]

    def set(self, key: str, value: Any) -> None:
        with self._lock:
            self._held[key] = value
            self._held.move_to_end(key)
            while len(self._held) > self.capacity:
                self._held.popitem(last=False)

    def __len__(self) -> int:
        return len(self._held)


class NoCache:
    def get(self, key: str) -> None:
        return None

    def set(self, key: str, value: Any) -> None:
        pass


#: Shared by all queries that name no other.
DEFAULT = LruPlanCache()


def file_stamp(path: str) -> tuple[str, int, int]:
    """Path, size and modification time: a rewritten file has another stamp."""
    try:
        return path, *scan.status(path)
    except OSError:
        return path, -1, -1


_NUMBERS = itertools.count(1)
_WEAK: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_STRONG: dict[int, tuple[Any, int]] = {}


def identity(thing: Any) -> str:
    """A name for an object that no other object ever gets, except one equal to it; methods of an object are told apart by name."""
    if hasattr(thing, "__self__") and hasattr(thing, "__func__"):
        return f"{identity(thing.__self__)}.{thing.__func__.__qualname__}"
    try:
        if thing not in _WEAK:
            _WEAK[thing] = next(_NUMBERS)
        return str(_WEAK[thing])
    except TypeError:  # without hash or weak references: kept alive, so that its id isn't used again
        held = _STRONG.setdefault(id(thing), (thing, 0))
        if not held[1]:
            held = _STRONG[id(thing)] = (thing, next(_NUMBERS))
        return f"kept-{held[1]}"


def key(parts: Iterable[Any]) -> str:
    return hashlib.sha256(repr(tuple(parts)).encode()).hexdigest()
