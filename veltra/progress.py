"""Progress of a run of known steps, told to whoever listens."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

T = TypeVar("T")


class Progress:
    """Counts steps and tells (done, total, seconds, seconds left) after each; without a listener it only counts."""

    def __init__(self, total: int, listener: Callable[[int, int, float, float], None] | None = None, clock: Callable[[], float] = time.monotonic):
        self.total, self.done, self.listener, self.clock = total, 0, listener, clock
        self.began = clock()

    def step(self, n: int = 1) -> None:
        self.done += n
        seconds = self.clock() - self.began
        left = seconds / self.done * max(0, self.total - self.done) if self.done else 0.0
        if self.listener:
            self.listener(self.done, self.total, seconds, left)

    def over(self, steps: Iterable[T]) -> Iterator[T]:
        for x in steps:
            yield x
            self.step()
