"""Worker-side memory of what was computed for a word, bounded in entries and key length."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable

import pyarrow as pa

IDLE_SECONDS = 3.0  # after a task, until a worker that gets no other gives its memory back

_held: dict[str, Callable[[], None]] = {}
_idle: list[threading.Timer] = []

LONGEST_KEY = 64


def held_by(owner: str, clear: Callable[[], None]) -> None:
    """Name what drops the memory that an operator keeps in a worker over its tasks."""
    _held[owner] = clear


def claim(owner: str) -> None:
    """Begin a task: drop what other operators keep in this worker, as workers outlive the jobs that filled them."""
    while _idle:
        _idle.pop().cancel()
    for other, clear in list(_held.items()):
        if other != owner:
            clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: allocators keep what arrays of earlier tasks took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the C library that has it
        pass


def _release() -> None:
    for clear in list(_held.values()):
        clear()
    give_back()


def rest() -> None:
    """End a task: what is kept goes too, unless the next task begins soon. A late call only costs time."""
    timer = threading.Timer(IDLE_SECONDS, _release)
    timer.daemon = True
    _idle.append(timer)
    timer.start()


class WordMemo(dict):
    """``memo[word]``, computed where missing.

    Two generations bound the memory: when the young one is full it becomes
    the old one, and words asked for again move over. Words of more than
    ``LONGEST_KEY`` characters are computed each time. ``fixed`` entries stay.
    """

    def __init__(self, compute: Callable, limit: int, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.compute, self.fixed = compute, fixed or {}
        self.limit = limit + len(self.fixed)
        self.old: dict = {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
            if len(word) > LONGEST_KEY:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        self[word] = value
        return value
