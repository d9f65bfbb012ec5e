"""Calls repeated with growing pauses."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

R = TypeVar("R")


def pauses(attempts: int = 1, first: float = 0.1, longest: float = 5.0, jitter: float = 0.0) -> Iterator[float]:
    """Seconds to wait between `attempts` attempts: each wait doubles the one before, up to
    `longest`, and gets up to `jitter` on top.  Waits of 0 or less stand for the defaults."""
    wait = first if first > 0 else 0.1
    longest = longest if longest > 0 else 5.0
    for _ in range(attempts - 1):
        yield min(wait, longest) + random.uniform(0, max(jitter, 0.0))
        wait *= 2


def call(f: Callable[[], R], waits: Iterator[float], again: Callable[[Exception], bool] = lambda error: True, on_retry: Callable[[int, float, Exception], None] = lambda *_: None, sleep: Callable[[float], None] = time.sleep) -> R:
    """`f()`, tried once more after each wait while `again` finds its error worth it; the last error
    is the caller's.  `on_retry` is told (attempt, wait, error)."""
    attempt = 0
    while True:
        attempt += 1
        try:
            return f()
        except Exception as error:
            wait = next(waits, None) if again(error) else None
            if wait is None:
                raise
            on_retry(attempt, wait, error)
        sleep(wait)
