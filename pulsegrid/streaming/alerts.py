"""Alerts of a stream and the sink that gives each of them once; posts that no analysis has come for."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..operators import trends
from .bursts import ringed

ALERTING = ("viral_surge", "emerging")


def trend_alerts(posts: DataFrame, minutes: int = 60, windows: int = 3, target: str = "hashtags", late: str = "1 hour", states: Sequence[str] = ALERTING) -> DataFrame:
    """On a stream of posts: (window_start, term, state, volume) of each term that a closed window finds in one of the states."""
    rows = ringed(posts, minutes, windows - 1, target, late)
    rate = lambda i: F.element_at("counts", i) / max(1.0, float(minutes))
    found = rows.withColumn("state", trends.lifecycle(F.col("counts"), rate(-1), rate(-2) if windows > 1 else F.lit(0.0)))
    return found.filter(F.col("state").isin(*states)).select("window_start", "term", "state", F.element_at("counts", -1).alias("volume"))


def unanalysed(posts: DataFrame, analytics: DataFrame, wait: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Of a stream of posts (id, ts) those for which a stream of analytics (post_id, analysed_at) has no row within ``wait`` of
    the post. Each is given once, when the watermarks of both streams have passed that time; state holds only posts and
    analytics of that span, so no stored history is read. A post without a time can't be waited for and is left out."""
    left = posts.filter("ts is not null").withWatermark("ts", late).alias("p")
    right = analytics.filter("analysed_at is not null").select("post_id", "analysed_at").withWatermark("analysed_at", late).alias("a")
    near = F.expr(f"a.post_id = p.id and a.analysed_at >= p.ts and a.analysed_at <= p.ts + interval {wait}")
    return left.join(right, near, "leftOuter").filter("a.post_id is null").select("p.*")


# --- the sink ------------------------------------------------------------------------------------------------------


def _store(path: str):
    """Any store that pyarrow knows by its scheme; a bare path is local."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class _Writer(DataSourceStreamWriter):
    """A task writes its rows to a file of its own; the driver then names the files of the batch in a list under the
    batch's number, by a rename. Only what a list names counts. A batch that comes again finds its list and adds nothing,
    and the files of attempts that failed are named nowhere."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> _Written:
        lines = [json.dumps(r.asDict(recursive=True), default=str) for r in iterator]
        if not lines:
            return _Written()
        store, at = _store(self.path)
        store.create_dir(f"{at}/rows", recursive=True)
        name = f"{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{at}/rows/{name}") as out:
            out.write(("\n".join(lines) + "\n").encode())
        return _Written([name])

    def _files(self, messages: list[WriterCommitMessage | None]) -> list[str]:
        return [f for m in messages if m is not None for f in m.files]

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        from pyarrow import fs

        store, at = _store(self.path)
        final = f"{at}/batches/{batchId:012d}.json"
        if store.get_file_info(final).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)
        store.create_dir(f"{at}/batches", recursive=True)
        store.create_dir(f"{at}/drafts", recursive=True)
        draft = f"{at}/drafts/{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": batchId, "files": self._files(messages)}).encode())
        store.move(draft, final)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, at = _store(self.path)
        for f in self._files(messages):
            store.delete_file(f"{at}/rows/{f}")


class AlertSink(DataSource):
    """``writeStream.format("alert_sink").option("path", folder)``: each batch's rows once, as JSON lines."""

    @classmethod
    def name(cls) -> str:
        return "alert_sink"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options["path"])


def alerts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that committed batches have given to the sink, with the number of their batch."""
    listed = spark.read.schema("batch bigint, files array<string>").json(f"{path.rstrip('/')}/batches")
    rows = spark.read.schema(schema).json(f"{path.rstrip('/')}/rows").withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.join(listed.select("batch", F.explode("files").alias("_file")), "_file").drop("_file")
