"""Clocks of observers, and timers of stages."""

from __future__ import annotations

import time
from dataclasses import dataclass, field


class SystemClock:
    """Microseconds since it was made; sleeping blocks."""

    def __init__(self):
        self._began = time.monotonic_ns()

    def now(self) -> int:
        return (time.monotonic_ns() - self._began) // 1000

    def sleep_until(self, deadline: int) -> None:
        if (rest := deadline - self.now()) > 0:
            time.sleep(rest / 1e6)


@dataclass
class ManualClock:
    """Time that only advances when told to; sleeping advances it, and is recorded."""

    at: int = 0
    deadlines: list[int] = field(default_factory=list)
    slept: int = 0

    def now(self) -> int:
        return self.at

    def advance(self, by: int) -> None:
        self.at += by

    def sleep_until(self, deadline: int) -> None:
        self.deadlines.append(deadline)
        if deadline > self.at:
            self.slept += deadline - self.at
            self.at = deadline


class Stopwatch:
    """The time since it was made, until it is first stopped."""

    def __init__(self, clock=None):
        self._clock = clock or SystemClock()
        self._began, self._elapsed = self._clock.now(), None

    @property
    def elapsed(self) -> int:
        return self._clock.now() - self._began if self._elapsed is None else self._elapsed

    def stop(self) -> int:
        self._elapsed = self.elapsed
        return self._elapsed


@dataclass
class StageTimer:
    """Microseconds of each named stage, by ``with timer.stage(name)``, and in all."""

    clock: object = field(default_factory=SystemClock)
    stages: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self._whole = Stopwatch(self.clock)

    def stage(self, name: str):
        return _Stage(self, name)

    def finish(self) -> dict[str, int]:
        return {**self.stages, "total": self._whole.stop()}


class _Stage:
    def __init__(self, timer: StageTimer, name: str):
        self.timer, self.name = timer, name

    def __enter__(self) -> Stopwatch:
        self.watch = Stopwatch(self.timer.clock)
        return self.watch

    def __exit__(self, *_) -> None:
        self.timer.stages[self.name] = self.timer.stages.get(self.name, 0) + self.watch.stop()
