"""What runs in the background of a driver: overlapping work, or one exclusive job."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager


class Busy(RuntimeError):
    """Other work is running that this one must not overlap."""


class Work:
    """Counts running work. Imports may overlap each other; a rebuild of everything runs alone and is refused, not queued,
    while anything else runs."""

    def __init__(self) -> None:
        self._lock, self._running, self._alone = threading.Lock(), 0, False

    @property
    def running(self) -> int:
        with self._lock:
            return self._running

    @contextmanager
    def of(self, exclusive: bool = False) -> Iterator[None]:
        """Holds a place for the body; raises Busy if it cannot have one."""
        with self._lock:
            if self._alone or exclusive and self._running:
                raise Busy("other work is running")
            self._running, self._alone = self._running + 1, exclusive
        try:
            yield
        finally:
            with self._lock:
                self._running -= 1
                self._alone = False
