"""Connectors: a platform's feed with a state, counts of what it did, and what a query is aimed at.

``poll`` gives posts of the platform's one form. Where a fetch of raw payloads is given, it is used, within the rate
limit; where none is, or it fails, made payloads stand in, the same for the same query.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .feeds import MadeFeed
from .limits import TokenBucket
from .platforms import NORMALISERS

STATES = ("disconnected", "connecting", "connected", "rate_limited", "error")
#: From a query, payloads.
Fetch = Callable[[str, int], Sequence[str]]


@dataclass(frozen=True)
class Stats:
    requests: int = 0
    messages: int = 0
    errors: int = 0
    last_error: str | None = None
    last_active: float | None = None


@dataclass
class Connector:
    """One platform's. info() is a consistent picture, whatever other threads do."""

    platform: str
    fetch: Fetch | None = None
    enabled: bool = True
    per_minute: float = 60.0
    clock: Callable[[], float] = time.time
    state: str = "disconnected"
    stats: Stats = field(default_factory=Stats)
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __post_init__(self) -> None:
        if self.platform not in NORMALISERS:
            raise ValueError(f"no such platform: {self.platform!r}")
        self._bucket = TokenBucket(max(0.01, self.per_minute / 60.0), self.per_minute)

    def _note(self, state: str | None = None, **changes) -> None:
        with self._lock:
            self.state = state or self.state
            self.stats = replace(self.stats, **changes)

    def connect(self) -> bool:
        """False if the connector is not enabled."""
        if not self.enabled:
            self._note("disconnected")
            return False
        self._note("connecting")
        self._note("connected", last_active=self.clock())
        return True

    def disconnect(self) -> bool:
        self._note("disconnected")
        return True

    def info(self) -> dict:
        with self._lock:
            return {"platform": self.platform, "state": self.state, "enabled": self.enabled, "per_minute": self.per_minute, "stats": self.stats}

    def poll(self, spark: SparkSession, query: str = "", limit: int = 50) -> DataFrame:
        """At most limit posts for a query; an empty table if the connector is off or has no right to ask now."""
        normalise = NORMALISERS[self.platform]
        if not self.enabled:
            return normalise(spark.createDataFrame([], "payload string"))
        if not self._bucket.acquire():
            self._note("rate_limited", errors=self.stats.errors + 1)
            return normalise(spark.createDataFrame([], "payload string"))
        payloads = None
        if self.fetch is not None:
            self._note(requests=self.stats.requests + 1)
            try:
                found = list(self.fetch(query, limit))[:limit]
                payloads = spark.createDataFrame([(p,) for p in found], "payload string")
            except Exception as e:  # noqa: BLE001
                self._note("error", errors=self.stats.errors + 1, last_error=str(e)[:500])
        if payloads is None:
            spark.dataSource.register(MadeFeed)
            payloads = spark.read.format("made_feed").option("query", query or "trend").option("rows", limit).option("platform", self.platform).load()
            found = range(limit)
        if self.state != "error":
            self._note("connected", messages=self.stats.messages + len(found), last_active=self.clock())
        return normalise(payloads)


# --- what a query is aimed at --------------------------------------------------------------------------------------

# Where a query goes that names nothing.
FALLBACK_CHANNEL, FALLBACK_GROUP = "UC_x5XG1OV2P6uZZ5FSM9Ttw", "@telegram"


def group_targets(query: str, defaults: Sequence[str] = ()) -> tuple[list[str], str | None]:
    """Groups to read and words to look for in them: a named group, else the default ones, else a group of one word's
    name, else the fallback."""
    asked = (query or "").strip()
    link = re.match(r"(?:https://)?t\.me/(.*)", asked)
    if link or asked.startswith("@"):
        return ["@" + link[1] if link else asked], None
    if defaults:
        return list(defaults), asked or None
    if len(asked) > 2 and " " not in asked:
        return ["@" + asked], None
    return [FALLBACK_GROUP], asked or None


def video_target(query: str, video: str | None = None, channel: str | None = None, search: Callable[[str], str | None] | None = None) -> dict[str, str]:
    """Parameters for comments: of a video or channel that the query names, else of the default ones, else of what a
    search finds, else of the fallback channel; words that name nothing are looked for. Only a video's comments can be
    ordered by relevance."""
    asked = (query or "").strip()
    words = {"searchTerms": asked} if asked else {}
    if asked.startswith("video:"):
        out = {"videoId": asked.removeprefix("video:").strip()}
    elif re.fullmatch(r"[a-zA-Z0-9_-]{11}", asked):
        out = {"videoId": asked}
    elif asked.startswith("channel:"):
        out = {"allThreadsRelatedToChannelId": asked.removeprefix("channel:").strip()}
    elif asked.startswith("UC") and len(asked) == 24:
        out = {"allThreadsRelatedToChannelId": asked}
    elif video or (not channel and search and (video := search(asked))):
        out = {"videoId": video, **words}
    else:
        out = {"allThreadsRelatedToChannelId": channel or FALLBACK_CHANNEL, **words}
    return out | {"order": "relevance" if "videoId" in out else "time"}
