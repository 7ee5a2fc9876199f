"""The live pipeline: counts by window with late data, upserts, enrichment and alerts a micro-batch at a time."""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tables, trends
from ..sources.shared import cut


def hashtag_counts(posts: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, tag, posts) on a stream or a table; a stream drops what is later than ``late``."""
    return posts.withWatermark("ts", late).select("ts", F.explode("hashtags").alias("tag")).groupBy(F.window("ts", window), "tag").agg(F.count(F.lit(1)).alias("posts")).select(F.col("window.start").alias("window_start"), "tag", "posts")


def replay(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Stored posts as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def polled(streams: Sequence[DataFrame]) -> DataFrame:
    """Posts of several feeds as one stream; columns that one of them lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


class Broadcaster:
    """Events to any number of clients: each has a bounded queue that drops its oldest event when full."""

    def __init__(self, size: int = 100):
        self.size, self._clients, self._lock = size, [], threading.Lock()

    def subscribe(self) -> queue.Queue:
        q: queue.Queue = queue.Queue(self.size)
        with self._lock:
            self._clients.append(q)
        return q

    def unsubscribe(self, q: queue.Queue) -> None:
        with self._lock:
            self._clients = [c for c in self._clients if c is not q]

    def publish(self, event: dict) -> None:
        with self._lock:
            for q in self._clients:
                while True:
                    try:
                        q.put_nowait(event)
                        break
                    except queue.Full:
                        try:
                            q.get_nowait()
                        except queue.Empty:
                            pass

    def next(self, q: queue.Queue, heartbeat: float = 15.0) -> dict:
        try:
            return q.get(timeout=heartbeat)
        except queue.Empty:
            return {"type": "heartbeat"}


#: The column that a table's rows are dealt by, as days; other tables are dealt by a hash of their keys.
DAYS = {"posts": "ts"}
BUCKETS = 64


class Store:
    """Tables in partitions, with a manifest that names each partition's folder.

    An upsert rewrites only the partitions that its rows fall in, under a new number, and then puts a new manifest in
    place by a rename; readers see the old or the new one, and a restart goes on from the last. Folders that the last
    two manifests don't name are removed. A key must stay in its partition: the day of a post doesn't change.
    """

    def __init__(self, spark: SparkSession, base: str, days: Mapping[str, str] = DAYS, buckets: int = BUCKETS):
        self.spark, self.base, self.days, self.buckets = spark, base.rstrip("/"), days, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, at: str) -> list[str]:
        path = self._path(at)
        return sorted(f.getPath().getName() for f in self._files.listStatus(path)) if self._files.exists(path) else []

    def _manifests(self, name: str) -> list[int]:
        return [int(f) for f in self._listed(f"{self.base}/{name}/manifests") if f.isdigit()]

    def _manifest(self, name: str, number: int) -> dict[str, str]:
        row = self.spark.read.text(f"{self.base}/{name}/manifests/{number:012d}", wholetext=True).first()
        return json.loads(row["value"])

    def folders(self, name: str) -> dict[str, str]:
        """Partition to folder, of the last manifest."""
        numbers = self._manifests(name)
        return self._manifest(name, numbers[-1]) if numbers else {}

    def _read(self, folders: Iterable[str]) -> DataFrame | None:
        paths = sorted(folders)
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, name: str, last: int | None = None) -> DataFrame | None:
        """The whole table, or its last so many days; None before the first row."""
        return self._read(path for _, path in sorted(self.folders(name).items())[-last if last else 0 :])

    def known(self, name: str, rows: DataFrame, keys: Sequence[str] | None = None) -> DataFrame | None:
        """The rows of the partitions that rows fall in."""
        now, parts = self.folders(name), self._parts(self._dealt(name, rows, keys or tables.KEYS[name]))
        return self._read(now[p] for p in parts if p in now)

    @staticmethod
    def _parts(dealt: DataFrame) -> list[str]:
        return [r["_part"] for r in dealt.select("_part").distinct().collect()]  # days or buckets of a micro-batch

    def _dealt(self, name: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        if name in self.days:
            return rows.withColumn("_part", F.coalesce(F.date_format(self.days[name], "yyyy-MM-dd"), F.lit("none")))
        return rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("string"))

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str] | None = None) -> None:
        self._rewrite(name, rows, keys or tables.KEYS[name], tables.upsert)

    def remove(self, name: str, rows: DataFrame, keys: Sequence[str] | None = None) -> None:
        """Without the rows whose keys are among those of rows."""
        self._rewrite(name, rows, keys or tables.KEYS[name], lambda old, gone, keys: old.join(gone.select(*keys), list(keys), "left_anti"))

    def _rewrite(self, name: str, rows: DataFrame, keys: Sequence[str], change: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]) -> None:
        numbers = self._manifests(name)
        number, now = (numbers[-1] if numbers else 0) + 1, self.folders(name)
        dealt = cut(self._dealt(name, rows, keys))
        parts = self._parts(dealt)
        if not parts:
            return
        old = self._read(now[p] for p in parts if p in now)
        before = dealt.limit(0) if old is None else self._dealt(name, old, keys)
        at = f"{self.base}/{name}/data/{number:012d}"
        change(before, dealt, keys).write.mode("overwrite").partitionBy("_part").parquet(at)
        there = set(self._listed(at))
        left = {p: path for p, path in now.items() if p not in parts}
        new = left | {p: f"{at}/_part={p}" for p in parts if f"_part={p}" in there}
        draft, final = (self._path(f"{self.base}/{name}/{x}") for x in (f"draft-{number:012d}", f"manifests/{number:012d}"))
        self._files.mkdirs(final.getParent())
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self._files.rename(draft, final)
        self._prune(name, number, set(now.values()) | set(new.values()))

    def _prune(self, name: str, number: int, kept: set[str]) -> None:
        for old in self._manifests(name):
            if old < number - 1:
                self._files.delete(self._path(f"{self.base}/{name}/manifests/{old:012d}"), False)
        for folder in self._listed(f"{self.base}/{name}/data"):
            at = f"{self.base}/{name}/data/{folder}"
            if int(folder) < number and not any(k.startswith(f"{at}/") for k in kept):
                self._files.delete(self._path(at), True)


class Pipeline:
    """Posts in, then analytics of the oldest posts without them, then alerts; no stage reads the stored history.

    Posts that are new wait in a table of their own (``pending``) until they have analytics, and trends read the last days
    alone. A micro-batch that can't be taken in fails and is tried again, so no post is lost; a failure of the later stages
    is reported and leaves the others be. ``alerts.trend_alerts`` and ``alerts.unanalysed`` do the later stages as streams of
    their own."""

    def __init__(self, store: Store, enrich: Callable[[DataFrame], DataFrame] | None = None, events: Broadcaster | None = None, batch: int = 50, minutes: int = 60):
        self.store, self.enrich, self.events, self.batch, self.minutes = store, enrich, events or Broadcaster(), batch, minutes
        self.errors: list[tuple[str, str]] = []
        self._query: StreamingQuery | None = None

    def tick(self, rows: DataFrame, number: int) -> None:
        if self.enrich is not None:  # before the posts themselves: a batch that is tried again finds what it has not taken in
            known = self.store.known("posts", rows)
            self.store.upsert("pending", rows if known is None else rows.join(known.select("id"), "id", "left_anti"), ["id"])
        self.store.upsert("posts", rows)
        for name, stage in (("enrich", self._enrich), ("trends", self._trends)):
            try:
                stage(rows, number)
            except Exception as e:  # noqa: BLE001
                self.errors.append((name, str(e)[:500]))
                self.events.publish({"type": "error", "stage": name})

    def _enrich(self, rows: DataFrame, number: int) -> None:
        pending = self.store.read("pending") if self.enrich is not None else None
        if pending is None:
            return
        due = cut(pending.drop("_part").orderBy("ts", "id").limit(self.batch))
        self.store.upsert("post_analytics", tables.with_defaults(self.enrich(due)))
        self.store.remove("pending", due, ["id"])

    def _trends(self, rows: DataFrame, number: int) -> None:
        days = -(-max(12 * 60, trends.FORECAST_WINDOWS * self.minutes) // 1440) + 1
        posts = self.store.read("posts", last=days)
        if posts is None:
            return
        tags = [r["tag"] for r in trends.top_hashtags(posts).collect()]  # five rows
        if tags:
            for r in trends.forecast(posts, tags, self.minutes).filter(F.col("state").isin("viral_surge", "emerging")).collect():
                self.events.publish({"type": "trend_alert", "term": r["term"], "state": r["state"]})

    def start(self, stream: DataFrame, checkpoint: str, seconds: int = 5) -> StreamingQuery:
        if self._query is None or not self._query.isActive:
            self._query = stream.writeStream.foreachBatch(self.tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
        return self._query

    def stop(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None
