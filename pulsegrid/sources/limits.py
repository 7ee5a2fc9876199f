"""Driver-side bounds on calls to outside services, and settings from .env files."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import UTC, date, datetime
from pathlib import Path


class TokenBucket:
    """Allows ``capacity`` calls at once and ``rate`` a second over time."""

    def __init__(self, rate: float, capacity: float, clock: Callable[[], float] = time.monotonic):
        self.rate, self.capacity, self._clock, self._lock = float(rate), float(capacity), clock, threading.Lock()
        self.reset()

    def reset(self) -> None:
        self.tokens, self._at = self.capacity, self._clock()

    def _missing(self, wanted: float, take: bool) -> float:
        """What the bucket lacks for a call, after what has come in since the last look; without a lack it is taken."""
        with self._lock:
            now = self._clock()
            self.tokens, self._at = min(self.capacity, self.tokens + (now - self._at) * self.rate), now
            lack = max(0.0, wanted - self.tokens)
            self.tokens -= wanted if take and not lack else 0.0
            return lack

    def acquire(self, tokens: float = 1.0) -> bool:
        return not self._missing(tokens, take=True)

    def wait_time(self, tokens: float = 1.0) -> float:
        lack = self._missing(tokens, take=False)
        return lack / self.rate if lack and self.rate > 0 else float("inf") if lack else 0.0


class DailyQuota:
    """Units a day (UTC); a refusal by the service uses up the rest."""

    COSTS = {"list": 1, "search": 100}

    def __init__(self, limit: int = 10_000, today: Callable[[], date] = lambda: datetime.now(UTC).date()):
        self.limit, self._today, self.used, self._day = limit, today, 0, today()

    def _roll(self) -> None:
        if self._today() != self._day:
            self._day, self.used = self._today(), 0

    def spend(self, kind: str) -> bool:
        self._roll()
        if self.used + self.COSTS[kind] > self.limit:
            return False
        self.used += self.COSTS[kind]
        return True

    def refused(self) -> None:
        self._roll()
        self.used = self.limit

    @property
    def left(self) -> int:
        self._roll()
        return self.limit - self.used


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines; export, quotes (one that is not closed reaches to the end), comments, and a bare value that ends
    at its first #."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = line.removeprefix("export ").split("=", 1)
        value = value.strip()
        bare = value[:1] not in ("'", '"')
        value = value.split("#", 1)[0].strip() if bare else value[1:].split(value[0], 1)[0]
        if key.strip():
            out[key.strip()] = value
    return out


def find_env(start: Path, name: str = ".env") -> Path | None:
    """The nearest file of that name in a folder or those above it."""
    return next((p / name for p in (start, *start.parents) if (p / name).is_file()), None)
