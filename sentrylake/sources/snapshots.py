"""Small tables that change: every change is a new version, and a version number is given once.

A writer reads a version, writes the changed rows to a folder of their own and publishes the next number
with that folder's name. If another writer took the number, the change is made again on what that one left.
Readers keep the version that they began with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.operators import history as H
from sentrylake.schema import conform, layout
from sentrylake.sources import published

SUPPRESSION_SCHEMA = layout(
    id="long", taxonomy="string", entity="string", title_contains="string", max_severity="string", reason="string",
    created_at="timestamp", expires_at="timestamp", hits="long",
)
CACHE_SCHEMA = layout(enricher="string", subject="string", fetched_at="timestamp", expires_at="timestamp", verdict="string", body="string")


class ChangedTooOften(RuntimeError):
    """Other writers were faster each time."""


class VersionedTable:
    """Rows of one layout below a folder, in versions."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType):
        self.spark, self.schema, self.folder = spark, schema, f"{root.rstrip('/')}/{name}"

    def version(self) -> int:
        """The newest version; 0 before the first change."""
        found = published.names(self.spark, f"{self.folder}/versions")
        return int(found[-1].split(".")[0]) if found else 0

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        data = published.content(self.spark, self._uri(version))["data"]
        return self.spark.read.schema(self.schema).parquet(data)

    def _uri(self, version: int) -> str:
        return f"{self.folder}/versions/{version:012d}.json"

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 20) -> int:
        """Publish what ``change`` makes of the newest version; it may be called several times."""
        for _ in range(attempts):
            version = self.version()
            data = f"{self.folder}/data/{uuid.uuid4().hex}"
            conform(change(self.read(version)), self.schema).write.parquet(data)
            if published.publish(self.spark, self._uri(version + 1), {"data": data}):
                return version + 1
            published.remove(self.spark, data)
        raise ChangedTooOften(self.folder)

    def vacuum(self, keep: int = 2, before: datetime | None = None) -> int:
        """Drop all versions but the newest ``keep``, and rows that no version names (written before ``before``)."""
        found = published.names(self.spark, f"{self.folder}/versions")
        gone = 0
        for name in found[: max(0, len(found) - keep)]:
            uri = f"{self.folder}/versions/{name}"
            data = published.content(self.spark, uri)["data"]
            published.remove(self.spark, uri)
            gone += published.remove(self.spark, data)
        if before is not None:
            named = {published.content(self.spark, f"{self.folder}/versions/{n}")["data"] for n in found[max(0, len(found) - keep) :]}
            for name in published.names(self.spark, f"{self.folder}/data"):
                data = f"{self.folder}/data/{name}"
                if data not in named and published.changed_before(self.spark, data, before):
                    gone += published.remove(self.spark, data)
        return gone


class Watchlist(VersionedTable):
    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, "watchlist", H.WATCH_SCHEMA)

    def add(self, updates: DataFrame, as_of: datetime | str) -> int:
        return self.update(lambda rows: H.add_watch(rows, updates, as_of))

    def remove(self, removals: DataFrame) -> int:
        return self.update(lambda rows: H.remove_watch(rows, removals))

    def active(self, as_of: datetime | str) -> DataFrame:
        return H.active_watchlist(self.read(), as_of)

    def purge(self, as_of: datetime | str) -> int:
        return self.update(lambda rows: H.active_watchlist(rows, as_of))


class Suppressions(VersionedTable):
    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, "suppressions", SUPPRESSION_SCHEMA)

    def add(self, rules: DataFrame, as_of: datetime | str) -> int:
        return self.update(lambda rows: H.add_suppressions(rows, rules, as_of))

    def delete(self, ids: DataFrame) -> int:
        return self.update(lambda rows: rows.join(ids.select("id").distinct(), "id", "left_anti"))

    def bump(self, matched: DataFrame) -> int:
        return self.update(lambda rows: H.bump_suppressions(rows, matched))

    def active(self, as_of: datetime | str) -> DataFrame:
        return H.active_suppressions(self.read(), as_of)


class AnswerCache(VersionedTable):
    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, "enrichment_cache", CACHE_SCHEMA)

    def put(self, answers: DataFrame) -> int:
        """Store answers; of several of one subject the latest counts, whenever it is stored."""
        return self.update(lambda rows: H.cache_latest(rows.unionByName(conform(answers, CACHE_SCHEMA))))

    def get(self, as_of: datetime | str) -> DataFrame:
        """Answers that hold at a time."""
        return self.read().where(F.col("expires_at") >= H.instant(as_of))

    def purge(self, as_of: datetime | str) -> int:
        return self.update(lambda rows: rows.where(F.col("expires_at") >= H.instant(as_of)))
