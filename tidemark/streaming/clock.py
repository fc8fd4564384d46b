"""Timers on the wall clock: periodic and one-off tasks, by namespace. ``tester.VirtualClock`` is the same for tests."""

from __future__ import annotations

import heapq
import logging
import threading
import time
from collections.abc import Callable

log = logging.getLogger(__name__)


def unix_time() -> float:
    return time.time()


class Timers:
    """Runs due tasks in order on one thread; a task that fails is logged and stays. Use as a context or ``stop`` it."""

    def __init__(self):
        self.tasks: list[tuple] = []
        self.number, self.stopped = 0, False
        self.changed = threading.Condition()
        self.thread = threading.Thread(target=self._run, daemon=True, name="tidemark-timers")
        self.thread.start()

    def once(self, fn: Callable[[], object], seconds: float, namespace: str = "") -> None:
        self._add(fn, seconds, None, namespace)

    def periodic(self, fn: Callable[[], object], seconds: float, namespace: str = "") -> None:
        if seconds <= 0:
            raise ValueError("a period must be positive")
        self._add(fn, seconds, seconds, namespace)

    def _add(self, fn, delay, every, namespace) -> None:
        with self.changed:
            self.number += 1
            heapq.heappush(self.tasks, (time.monotonic() + delay, self.number, fn, every, namespace))
            self.changed.notify()

    def remove(self, namespace: str) -> None:
        """Drop a namespace's tasks, as when its rules are unloaded."""
        with self.changed:
            self.tasks = [t for t in self.tasks if t[4] != namespace]
            heapq.heapify(self.tasks)
            self.changed.notify()

    def _run(self) -> None:
        while True:
            with self.changed:
                while not self.stopped and (not self.tasks or self.tasks[0][0] > time.monotonic()):
                    self.changed.wait(self.tasks[0][0] - time.monotonic() if self.tasks else None)
                if self.stopped:
                    return
                due, number, fn, every, namespace = heapq.heappop(self.tasks)
                if every:
                    heapq.heappush(self.tasks, (due + every, number, fn, every, namespace))
            try:
                fn()
            except Exception:
                log.exception("timer task failed")

    def stop(self) -> None:
        with self.changed:
            self.stopped = True
            self.changed.notify()
        if threading.current_thread() is not self.thread:
            self.thread.join(10)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stop()
