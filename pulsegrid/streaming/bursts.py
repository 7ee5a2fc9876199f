"""Burst metrics of a stream, a closed window at a time, without a look at stored posts.

Counts by window and term are a watermarked aggregation, which gives each window once when no more of its posts can
come. ``stateful`` keeps the last windows of each term as state: a window that closes is put beside the baselines
before it, windows that have passed out of reach are dropped, and a term whose windows are all empty keeps no state.
Timers of event time give the rows of windows in which a term doesn't occur while its baselines do. ``sliding`` gives
the same rows by sliding windows alone, on a stream or on a table: no Python, but baselines + 1 times the state.

Windows are half open and start at whole multiples of their width since 1970. Posts without a time are left out; posts
later than ``late`` behind the newest one are dropped by a stream, never by a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import trends

#: What holds state that timers and several variables can reach.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """``stateful`` needs this before its query starts; a cluster sets it in its defaults."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def window_counts(posts: DataFrame, minutes: int, target: str = "all", late: str = "1 hour") -> DataFrame:
    """(window, term, kind, n); a stream gives a window when it is closed."""
    rows = trends.post_terms(posts.filter("ts is not null").withWatermark("ts", late), target, carry=("ts",))
    return rows.groupBy(F.window("ts", f"{minutes} minutes"), "term", "kind").agg(F.count(F.lit(1)).alias("n"))


class _Ring(StatefulProcessor):
    """The counts of a term's last windows; emits (window number, counts) of each closed window that they reach."""

    def __init__(self, width_ms: int, baselines: int):
        self.width, self.baselines = width_ms, baselines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ring", "due bigint, windows array<bigint>, counts array<bigint>")

    def _held(self) -> tuple[int | None, dict[int, int]]:
        if not self.state.exists():
            return None, {}
        due, windows, counts = self.state.get()
        return due, dict(zip(windows, counts, strict=True))

    def _closed(self, key: Any, due: int | None, ring: dict[int, int], watermark: int) -> Iterator[Row]:
        """Rows of the windows from ``due`` to the last one that the watermark has passed; what is left goes back to state."""
        last = watermark // self.width - 1
        while ring and due is not None and due <= last:
            span = range(due - self.baselines, due + 1)
            if any(w in ring for w in span):
                yield Row(term=key[0], kind=key[1], window=due, counts=[ring.get(w, 0) for w in span])
            due += 1
            ring = {w: n for w, n in ring.items() if w >= due - self.baselines}
            if ring and min(ring) > due:
                due = min(ring)  # a pause longer than the baselines
        if ring:
            self.state.update((due, list(ring), list(ring.values())))
            self.handle.registerTimer((due + 1) * self.width)
        else:
            self.state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        due, ring = self._held()
        for r in rows:
            w = int(r["start_ms"]) // self.width
            ring[w] = ring.get(w, 0) + int(r["n"])
            due = w if due is None else min(due, w)
        yield from self._closed(key, due, ring, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due, ring = self._held()
        yield from self._closed(key, due, ring, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        return


def _metrics(counted: DataFrame, minutes: int, z_threshold: float, min_count: int) -> DataFrame:
    return trends.burst_metrics(counted, minutes, z_threshold, min_count, carry=("window_start",))


def ringed(posts: DataFrame, minutes: int = 60, baselines: int = 5, target: str = "all", late: str = "1 hour") -> DataFrame:
    """On a stream of posts (ts, text, hashtags): (window_start, term, kind, counts), the closed window's count last, for each term
    that occurs in the window or in the ``baselines`` before it."""
    counted = window_counts(posts, minutes, target, late)
    rows = counted.select("term", "kind", "n", F.unix_millis("window.start").alias("start_ms"), F.window_time("window").alias("at"))
    rings = rows.groupBy("term", "kind").transformWithState(_Ring(minutes * 60_000, baselines), "term string, kind string, window bigint, counts array<bigint>", "Append", "EventTime")
    return rings.select(F.timestamp_millis(F.col("window") * (minutes * 60_000)).alias("window_start"), "term", "kind", "counts")


def stateful(posts: DataFrame, minutes: int = 60, baselines: int = 5, z_threshold: float = 2.5, min_count: int = 3, target: str = "all", late: str = "1 hour") -> DataFrame:
    """window_start and the columns of ``trends.burst_metrics`` for what ``ringed`` gives."""
    return _metrics(ringed(posts, minutes, baselines, target, late), minutes, z_threshold, min_count)


def sliding(posts: DataFrame, minutes: int = 60, baselines: int = 5, z_threshold: float = 2.5, min_count: int = 3, target: str = "all", late: str = "1 hour") -> DataFrame:
    """The rows of ``stateful`` by windows of all baselines and the current one; of a table those up to the last that closes."""
    width = minutes * 60
    n = baselines + 1
    rows = trends.post_terms(posts.filter("ts is not null").withWatermark("ts", late), target, carry=("ts",))
    if not posts.isStreaming:
        closed = posts.agg(F.max(F.expr(f"ts - interval {late}")).alias("_closed"))  # one row
        rows = rows.join(F.broadcast(closed))
    spanned = rows.withColumn("_w", F.window("ts", f"{n * minutes} minutes", f"{minutes} minutes"))
    if not posts.isStreaming:
        spanned = spanned.filter(F.col("_w.end") <= F.col("_closed"))
    slot = F.floor((F.unix_micros("ts") - F.unix_micros("_w.start")) / (width * 1_000_000))
    counts = F.array(*[F.count(F.when(slot == i, 1)) for i in range(n)])
    counted = spanned.groupBy("_w", "term", "kind").agg(counts.alias("counts"))
    return _metrics(counted.withColumn("window_start", F.timestamp_seconds(F.unix_seconds("_w.end") - width)), minutes, z_threshold, min_count)
