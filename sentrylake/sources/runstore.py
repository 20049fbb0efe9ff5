"""Run tables behind a manifest: a run's rows are seen when all of its tables are written, or not at all.

Every attempt writes to folders of its own. Its manifest names them and is published in one step, so a run
that dies between two tables leaves nothing that a reader sees, and a run that is done again replaces all
tables of its earlier attempt, also by none. Readers have fixed layouts: a product without rows reads as an
empty table. Rows are never rewritten; retention and deletion publish a shorter manifest first and drop
folders then.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.operators.signals import signal_rows
from sentrylake.schema import EVENT_SCHEMA, FINDING_SCHEMA, METRIC_SCHEMA, SIGNAL_SCHEMA, conform, layout
from sentrylake.sources import published
from sentrylake.sources.sinks import IOC_DAYS, METRIC_DAYS, RAW_DAYS, RunDeletionError, event_rows, metric_rows

_RUN = [T.StructField("run_id", T.StringType())]


def _layout(**columns: str | T.DataType) -> T.StructType:
    return T.StructType(_RUN + layout(**columns).fields)


#: Layout of every run table, and the columns that its folders are split by.
TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "events": (EVENT_SCHEMA, ("kind",)),
    "metrics": (T.StructType([*_RUN, T.StructField("ts", T.TimestampType()), *METRIC_SCHEMA.fields]), ()),
    "signals": (T.StructType([*SIGNAL_SCHEMA.fields, *_RUN]), ()),
    "findings": (FINDING_SCHEMA, ()),
    "source_health": (
        _layout(
            source="string", state="string", records="long", unique_records="long", reported_total="long", span_hours="double",
            requested_hours="double", pages="long", notes=T.ArrayType(T.StringType()), usable="boolean",
        ),
        (),
    ),
    "canaries": (_layout(canary="string", expect_taxonomy="string", detected="boolean"), ()),
    "ioc_dns": (_layout(day="date", client_ip="string", domain="string", queries="long", blocked="long"), ("day",)),
    "ioc_flow": (_layout(day="date", src_ip="string", dst_ip="string", dst_port="integer", proto="string", hits="long"), ("day",)),
}

RUNS = "run_id string, number bigint, started_at timestamp, finished_at timestamp"


def _text(moment: datetime | str | None) -> str | None:
    if moment is None:
        return None
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc).isoformat()


class RunWriter:
    """One attempt at a run. Nothing of it is seen before ``commit``."""

    def __init__(self, store: RunStore, run_id: str, number: int, started_at: str):
        self.store, self.run_id, self.number, self.started_at = store, run_id, number, started_at
        self.attempt, self.tables = uuid.uuid4().hex, {}

    def write(self, table: str, rows: DataFrame) -> None:
        """Rows of one table in its layout; a second call for a table replaces the first."""
        schema, split = TABLES[table]
        ready = conform(rows.withColumn("run_id", F.lit(self.run_id)), schema).drop("run_id")
        folder = f"{self.store.root}/data/{table}/run_id={quote(self.run_id, safe='')}/attempt={self.attempt}"
        writer = ready.write.mode("overwrite")
        (writer.partitionBy(*split) if split else writer).parquet(folder)
        found = published.names(self.store.spark, folder)
        parts = [n for n in found if "=" in n] if split else [""] if any(n.endswith(".parquet") for n in found) else []
        self.tables[table] = {"folder": folder, "parts": parts}

    def events(self, events: DataFrame) -> None:
        self.write("events", event_rows(events, self.run_id))

    def metrics(self, metrics: DataFrame, at: datetime | str) -> None:
        self.write("metrics", metric_rows(metrics, self.run_id, at))

    def signals(self, signals: DataFrame) -> None:
        self.write("signals", signals if "evidence" in signals.columns else signal_rows(signals))

    def commit(self, finished_at: datetime | str | None) -> None:
        """Publish the attempt: its tables, and no others, are the run's from now on."""
        self.store._publish(
            {"run_id": self.run_id, "number": self.number, "started_at": self.started_at, "finished_at": _text(finished_at), "tables": self.tables}
        )


class RunStore:
    """Run tables below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _uri(self, run_id: str) -> str:
        return f"{self.root}/runs/{quote(run_id, safe='')}.json"

    def _publish(self, manifest: dict) -> None:
        published.publish(self.spark, self._uri(manifest["run_id"]), manifest, replace=True)

    def manifests(self) -> list[dict]:
        """One small dictionary for each run that is kept."""
        return [published.content(self.spark, f"{self.root}/runs/{n}") for n in published.names(self.spark, f"{self.root}/runs")]

    def runs(self) -> DataFrame:
        """``run_id, number, started_at, finished_at``; a run that has begun and not ended has no end."""
        rows = [(m["run_id"], m["number"], *[m[k] and datetime.fromisoformat(m[k]) for k in ("started_at", "finished_at")]) for m in self.manifests()]
        return self.spark.createDataFrame(rows, RUNS)

    def begin(self, run_id: str, started_at: datetime | str) -> RunWriter:
        """Start an attempt; what an earlier attempt at this run has published stays until this one commits."""
        known = {m["run_id"]: m for m in self.manifests()}
        number = known[run_id]["number"] if run_id in known else 1 + max((m["number"] for m in known.values()), default=0)
        writer = RunWriter(self, run_id, number, _text(started_at))
        published.publish(
            self.spark, self._uri(run_id), {"run_id": run_id, "number": number, "started_at": writer.started_at, "finished_at": None, "tables": {}}
        )
        return writer

    def read(self, table: str, run_ids: Iterable[str] | None = None) -> DataFrame:
        """Published rows of a table, of all runs or of some; filters on run and split columns prune folders."""
        schema, _ = TABLES[table]
        wanted = None if run_ids is None else set(run_ids)
        paths = []
        for m in self.manifests():
            if table in m["tables"] and (wanted is None or m["run_id"] in wanted):
                entry = m["tables"][table]
                paths += [f"{entry['folder']}/{part}".rstrip("/") for part in entry["parts"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        with_attempt = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
        rows = self.spark.read.schema(with_attempt).option("basePath", f"{self.root}/data/{table}").parquet(*paths)
        return rows.select(*schema.names)

    def delete_run(self, run_id: str, *, force: bool = False) -> dict[str, int]:
        """Take a run out of sight, then drop its folders; how many partitions each table loses."""
        known = {m["run_id"]: m for m in self.manifests()}
        if run_id not in known:
            raise RunDeletionError(f"no run {run_id!r}")
        if known[run_id]["finished_at"] is None and not force:
            raise RunDeletionError(f"run {run_id!r} has not finished; force to remove it anyway")
        published.remove(self.spark, self._uri(run_id))
        for table in TABLES:
            published.remove(self.spark, f"{self.root}/data/{table}/run_id={quote(run_id, safe='')}")
        return {t: len(e["parts"]) for t, e in known[run_id]["tables"].items() if e["parts"]}

    def purge(self, as_of: datetime, *, raw_days: int = RAW_DAYS, ioc_days: int = IOC_DAYS, metric_days: int = METRIC_DAYS) -> dict[str, int]:
        """Drop what retention no longer keeps: events and metrics by the age of their run, slices by their day."""
        now = datetime.fromisoformat(_text(as_of))
        oldest_day = "day=" + (now - timedelta(days=ioc_days)).date().isoformat()
        removed: dict[str, int] = {}
        for m in self.manifests():
            started, gone = datetime.fromisoformat(m["started_at"]), []
            for table, entry in m["tables"].items():
                old = {
                    "events": lambda _, s=started: s < now - timedelta(days=raw_days),
                    "metrics": lambda _, s=started: s < now - timedelta(days=metric_days),
                    "ioc_dns": lambda part: part < oldest_day,
                    "ioc_flow": lambda part: part < oldest_day,
                }.get(table, lambda _: False)
                lost = [p for p in entry["parts"] if old(p)]
                if lost:
                    entry["parts"] = [p for p in entry["parts"] if p not in lost]
                    gone += [f"{entry['folder']}/{p}".rstrip("/") for p in lost]
                    removed[table] = removed.get(table, 0) + len(lost)
            if gone:
                self._publish(m)
                for path in gone:
                    published.remove(self.spark, path)
        return removed

    def vacuum(self, before: datetime) -> int:
        """Drop folders of attempts that no manifest names and that nobody wrote to since ``before``."""
        kept = {entry["folder"] for m in self.manifests() for entry in m["tables"].values()}
        gone = 0
        for table in TABLES:
            for run in published.names(self.spark, f"{self.root}/data/{table}"):
                for attempt in published.names(self.spark, f"{self.root}/data/{table}/{run}"):
                    folder = f"{self.root}/data/{table}/{run}/{attempt}"
                    if folder not in kept and published.changed_before(self.spark, folder, before):
                        gone += published.remove(self.spark, folder)
        return gone
