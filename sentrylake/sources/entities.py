"""Sightings of entities: one base and the deltas of later runs, hash-bucketed alike, so that history isn't shuffled.

The folder is one table, bucketed by ``value``, with a partition for the base and one for each run since.
A pointer names the partitions that count. Grouping by entity and joining on ``value`` need no exchange of
the table, whatever its size: what is asked is dealt out to its buckets.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.operators import history as H
from sentrylake.sources import published

_COLUMNS = "etype string, value string, first_seen timestamp, last_seen timestamp, occurrences bigint"


class AlreadyMerged(ValueError):
    """A run's sightings have become part of the base."""


class EntityStore:
    """First and last sighting and occurrences of every entity, by runs that can be taken back until they are merged."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.folder, self.buckets = spark, f"{root.rstrip('/')}/entities", buckets
        self.name = "entities_" + hashlib.sha256(self.folder.encode()).hexdigest()[:16]

    # the pointer: {"base": partition or none, "deltas": {run: partition}, "merged": [runs], "buckets": n}

    def _pointer(self) -> tuple[int, dict]:
        found = published.names(self.spark, f"{self.folder}/versions")
        if not found:
            return 0, {"base": None, "deltas": {}, "merged": [], "buckets": self.buckets}
        return int(found[-1].split(".")[0]), published.content(self.spark, f"{self.folder}/versions/{found[-1]}")

    def _point(self, change) -> None:
        while True:
            version, now = self._pointer()
            if published.publish(self.spark, f"{self.folder}/versions/{version + 1:012d}.json", change(now)):
                return

    def _table(self) -> str:
        """The table's name in this session's catalog; the files are the same for every session."""
        buckets = self._pointer()[1]["buckets"]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_COLUMNS}, part string) USING parquet PARTITIONED BY (part) "
            f"CLUSTERED BY (value) SORTED BY (value) INTO {buckets} BUCKETS LOCATION '{self.folder}/data'"
        )
        self.spark.catalog.refreshTable(self.name)
        return self.name

    def _write(self, rows: DataFrame, part: str) -> None:
        buckets = self._pointer()[1]["buckets"]
        ready = rows.select("etype", "value", "first_seen", "last_seen", "occurrences", F.lit(part).alias("part"))
        ready.repartition(buckets, "value").write.insertInto(self._table())  # one file for each bucket

    def observe(self, run_id: str, observed: DataFrame) -> None:
        """Store a run's sightings (``etype, value, seen_at, n``); a run observed again replaces its earlier ones."""
        if run_id in self._pointer()[1]["merged"]:
            raise AlreadyMerged(run_id)
        part = f"run-{uuid.uuid4().hex}"
        self._write(H.entities(observed), part)
        self._point(lambda now: now | {"deltas": now["deltas"] | {run_id: part}})

    def forget(self, run_id: str) -> None:
        """Take a run's sightings back."""
        if run_id in self._pointer()[1]["merged"]:
            raise AlreadyMerged(run_id)
        self._point(lambda now: now | {"deltas": {k: v for k, v in now["deltas"].items() if k != run_id}})

    def _rows(self, pointer: dict) -> DataFrame:
        parts = [p for p in [pointer["base"], *pointer["deltas"].values()] if p]
        return self.spark.table(self._table()).where(F.col("part").isin(parts))

    def _merged(self, pointer: dict) -> DataFrame:
        return self._rows(pointer).groupBy("etype", "value").agg(
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrences").alias("occurrences")
        )

    def known(self) -> DataFrame:
        """``etype, value, first_seen, last_seen, occurrences`` of all runs that count."""
        return self._merged(self._pointer()[1])

    def novel(self, values: DataFrame, etype: str, as_of: datetime | str) -> DataFrame:
        """Values without a sighting before ``as_of``, but for the hour before it."""
        return H.novel(values, self.known(), etype, as_of)

    def compact(self) -> None:
        """Merge base and deltas into a new base; runs observed in the meantime stay deltas."""
        _, seen = self._pointer()
        if not seen["deltas"]:
            return
        base = f"base-{uuid.uuid4().hex}"
        self._write(self._merged(seen), base)

        def change(now: dict) -> dict:
            if now["base"] != seen["base"] or any(now["deltas"].get(r) != p for r, p in seen["deltas"].items()):
                raise RuntimeError("runs were replaced or merged while they were compacted; start again")
            left = {r: p for r, p in now["deltas"].items() if r not in seen["deltas"]}
            return now | {"base": base, "deltas": left, "merged": [*now["merged"], *seen["deltas"]]}

        self._point(change)

    def vacuum(self, before: datetime) -> int:
        """Drop partitions that the pointer doesn't name and that nobody wrote to since ``before``."""
        _, now = self._pointer()
        live = {f"part={p}" for p in [now["base"], *now["deltas"].values()]}
        gone = 0
        for name in published.names(self.spark, f"{self.folder}/data"):
            folder = f"{self.folder}/data/{name}"
            if name.startswith("part=") and name not in live and published.changed_before(self.spark, folder, before):
                gone += published.remove(self.spark, folder)
        return gone
