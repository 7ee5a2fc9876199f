"""A feed of made posts as a Python data source, for runs without a network: batch and stream."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

_EPOCH = 1_704_067_200  # 2024-01-01


def made_payload(query: str, i: int, platform: str = "twitter") -> str:
    """A payload in the form of a platform, the same for the same query and number."""
    h = hashlib.sha256(f"{query}:{i}".encode()).hexdigest()
    text, user, at, likes = f"{query} update {i} #{query.replace(' ', '')}", f"u{int(h[16:20], 16) % 50}", _EPOCH + 60 * i, int(h[20:23], 16)
    iso = datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    forms = {
        "twitter": {"id": h[:16], "text": text, "author_id": user, "created_at": at, "public_metrics": {"like_count": likes}},
        "reddit": {"id": h[:16], "title": query, "selftext": text, "author": user, "created_utc": at, "score": likes, "permalink": f"/r/made/{h[:8]}"},
        "youtube": {"id": h[:16], "snippet": {"videoId": h[24:35], "topLevelComment": {"snippet": {"textOriginal": text, "authorChannelId": {"value": user}, "likeCount": likes, "publishedAt": iso}}}},
        "telegram": {"message_id": i, "chat": {"id": -int(h[:6], 16), "username": "made"}, "text": text, "date": at, "views": likes},
        "bluesky": {"uri": f"at://{user}/app.bsky.feed.post/{h[:13]}", "author": {"did": user}, "record": {"text": text, "createdAt": iso}, "likeCount": likes},
    }
    return json.dumps(forms[platform])


class _Reader(DataSourceReader):
    def __init__(self, query: str, n: int, parts: int, platform: str):
        self.query, self.n, self.parts, self.platform = query, n, parts, platform

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(partition.value, self.n, self.parts):
            yield (made_payload(self.query, i, self.platform),)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, query: str, each: int, platform: str):
        self.query, self.each, self.platform = query, each, platform

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter([(made_payload(self.query, i, self.platform),) for i in range(start["at"], start["at"] + self.each)]), {"at": start["at"] + self.each}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(made_payload(self.query, i, self.platform),) for i in range(start["at"], end["at"])])

    def commit(self, end: dict) -> None:
        return None


class MadeFeed(DataSource):
    """Options: query, platform, rows (batch), partitions (batch), each (rows of a micro-batch)."""

    @classmethod
    def name(cls) -> str:
        return "made_feed"

    def schema(self) -> str:
        return "payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options.get("query", "trend"), int(self.options.get("rows", 50)), int(self.options.get("partitions", 2)), self.options.get("platform", "twitter"))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options.get("query", "trend"), int(self.options.get("each", 10)), self.options.get("platform", "twitter"))
