"""Services of the driver: a queue for operations that change tables, and namespaced loggers."""

from __future__ import annotations

import heapq
import itertools
import logging
import os
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any


def logger(namespace: str) -> logging.Logger:
    """A logger below `docloom`; its level comes from DOCLOOM_LOG ("debug", or "namespace=debug,other=error")."""
    log = logging.getLogger(f"docloom.{namespace}")
    for part in filter(None, os.environ.get("DOCLOOM_LOG", "").split(",")):
        name, _, level = part.rpartition("=")
        if not name or namespace == name or namespace.startswith(f"{name}."):
            log.setLevel(level.upper())
    return log


class QueueTimeoutError(TimeoutError):
    pass


class OperationQueue:
    """Runs work in threads, `concurrency` at a time: higher priorities first, equal ones in the order they came.

    timeout (seconds) bounds how long the caller's future waits once the work has begun; the work itself can't be stopped.
    """

    def __init__(self, concurrency: int = 1, timeout: float | None = 5.0):
        self.concurrency, self.timeout = concurrency, timeout
        self._waiting: list[tuple[int, int, Callable[[], Any], Future, float | None, int]] = []
        self._order, self._lock, self._idle = itertools.count(), threading.Lock(), threading.Condition()
        self._running = 0
        self._counts = {"done": 0, "failed": 0, "timed_out": 0, "cleared": 0}

    def add(self, work: Callable[[], Any], priority: int = 0, timeout: float | None = None, retries: int = 0) -> Future:
        future: Future = Future()
        with self._lock:
            heapq.heappush(self._waiting, (-priority, next(self._order), work, future, self.timeout if timeout is None else timeout, retries))
        self._next()
        return future

    def _next(self) -> None:
        with self._lock:
            if self._running >= self.concurrency or not self._waiting:
                return
            _, _, work, future, timeout, retries = heapq.heappop(self._waiting)
            self._running += 1
        threading.Thread(target=self._run, args=(work, future, timeout, retries), daemon=True).start()

    def _run(self, work: Callable[[], Any], future: Future, timeout: float | None, retries: int) -> None:
        settled = threading.Lock()

        def settle(kind: str, result: Any = None, error: BaseException | None = None) -> None:
            with settled:
                if future.done():
                    return
                with self._lock:
                    self._counts[kind] += 1
                if error is None:
                    future.set_result(result)
                else:
                    future.set_exception(error)

        clock = threading.Timer(timeout, lambda: settle("timed_out", error=QueueTimeoutError(f"more than {timeout} s"))) if timeout else None
        if clock:
            clock.daemon = True
            clock.start()
        try:
            for attempt in range(retries + 1):
                try:
                    result = work()
                except Exception as e:
                    if attempt == retries:
                        settle("failed", error=e)
                else:
                    settle("done", result)
                    break
        finally:
            if clock:
                clock.cancel()
            with self._lock:
                self._running -= 1
            self._next()
            with self._idle:
                self._idle.notify_all()

    def stats(self) -> dict[str, int]:
        with self._lock:
            return {"waiting": len(self._waiting), "running": self._running, **self._counts}

    def clear(self) -> int:
        """Drop what has not begun; its futures are cancelled."""
        with self._lock:
            dropped, self._waiting = self._waiting, []
            self._counts["cleared"] += len(dropped)
        for entry in dropped:
            entry[3].cancel()
        return len(dropped)

    def drain(self, timeout: float | None = None) -> bool:
        """Wait until nothing waits or runs; False if that took longer than timeout."""
        until = None if timeout is None else time.monotonic() + timeout
        with self._idle:
            while (s := self.stats())["waiting"] or s["running"]:
                left = None if until is None else until - time.monotonic()
                if left is not None and left <= 0:
                    return False
                self._idle.wait(0.1 if left is None else min(0.1, left))
        return True
