"""Run products as Parquet tables: append, retention and removal.

A table is a folder partitioned by ``run_id`` (events also by ``kind``, retained slices by ``day``).
Writing a run replaces that run's partitions and nothing else, so a job that is started again after
a failure leaves the same rows as one that ran through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.operators.history import before, instant
from sentrylake.operators.signals import signal_rows
from sentrylake.schema import (
    EVENT_SCHEMA,
    FINDING_SCHEMA,
    METRIC_SCHEMA,
    SIGNAL_SCHEMA,
    conform,
    conform_events,
)

# Tables whose rows belong to exactly one run.
RUN_TABLES = (
    "events", "metrics", "signals", "findings", "source_health", "canaries", "ioc_dns", "ioc_flow",
)

# Days that rows are kept.
RAW_DAYS = 7
IOC_DAYS = 180
METRIC_DAYS = 730


class RunDeletionError(ValueError):
    """A run cannot be removed."""


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def write_run(df: DataFrame, root: str, table: str, partition_by: Sequence[str] = ("run_id",)) -> None:
    """Replace the partitions that ``df`` touches."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(table_path(root, table))
    )


def event_rows(events: DataFrame, run_id: str) -> DataFrame:
    """Events ready to be stored: run, a stable id, and the raw record as text."""
    number = F.shiftrightunsigned(F.xxhash64("source", "dedup_key"), 1)
    return conform_events(events).withColumns(
        {
            "run_id": F.lit(run_id),
            "id": F.coalesce("id", number),
            "raw_json": F.coalesce("raw_json", F.to_json("raw")),
        }
    )


def append_events(events: DataFrame, root: str, run_id: str) -> None:
    """Store the events of a run by kind, rows of one kind spread over several files."""
    write_run(event_rows(events, run_id), root, "events", ("run_id", "kind"))


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """The event table in today's layout, also where older files lack a column."""
    return conform_events(spark.read.schema(EVENT_SCHEMA).parquet(table_path(root, "events")))


def metric_rows(metrics: DataFrame, run_id: str, at: datetime | str) -> DataFrame:
    """Metrics ready to be stored: numbers and texts apart."""
    return conform(metrics, METRIC_SCHEMA).select(
        F.lit(run_id).alias("run_id"), instant(at).alias("ts"), "*"
    )


def split_value(rows: DataFrame, value: str) -> DataFrame:
    """A text value as a number where it is one; truth values stay text."""
    number = F.col(value).try_cast("double")
    return rows.withColumns(
        {"value_num": number, "value_text": F.when(number.isNull(), F.col(value))}
    )


def save_metrics(metrics: DataFrame, root: str, run_id: str, at: datetime | str) -> None:
    write_run(metric_rows(metrics, run_id, at), root, "metrics")


def save_signals(signals: DataFrame, root: str, run_id: str) -> None:
    rows = signals if "evidence" in signals.columns else signal_rows(signals)
    write_run(
        conform(rows, SIGNAL_SCHEMA).withColumn("run_id", F.lit(run_id)), root, "signals"
    )


def save_findings(findings: DataFrame, root: str, run_id: str, at: datetime | str) -> None:
    rows = findings.withColumns({"run_id": F.lit(run_id), "ts": instant(at)})
    write_run(conform(rows, FINDING_SCHEMA), root, "findings")


def save_health(health: DataFrame, root: str, run_id: str) -> None:
    write_run(health.withColumn("run_id", F.lit(run_id)), root, "source_health")


def save_canaries(results: DataFrame, root: str, run_id: str) -> None:
    write_run(results.withColumn("run_id", F.lit(run_id)), root, "canaries")


def save_slice(rows: DataFrame, root: str, table: str) -> None:
    """Store a retained slice, by day and run."""
    write_run(rows, root, table, ("day", "run_id"))


def write_report_json(report: DataFrame, path: str) -> None:
    """A report (nested, or as rows) as JSON lines below a folder per run; a rerun replaces its own."""
    (
        report.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .json(path)
    )


# ----- retention and removal


def retained(
    tables: Mapping[str, DataFrame],
    runs: DataFrame,
    as_of: datetime | str,
    *,
    raw_days: int = RAW_DAYS,
    ioc_days: int = IOC_DAYS,
    metric_days: int = METRIC_DAYS,
) -> dict[str, DataFrame]:
    """What retention keeps of each table: events by the age of their run, the rest by their own."""
    old = runs.where(F.col("started_at") < before(as_of, days=raw_days)).select("run_id")
    oldest_day = F.to_date(before(as_of, days=ioc_days))
    rules = {
        "events": lambda df: df.join(old, "run_id", "left_anti"),
        "ioc_dns": lambda df: df.where(F.col("day") >= oldest_day),
        "ioc_flow": lambda df: df.where(F.col("day") >= oldest_day),
        "metrics": lambda df: df.where(F.col("ts") >= before(as_of, days=metric_days)),
        "enrichment_cache": lambda df: df.where(F.col("expires_at") >= instant(as_of)),
        "watchlist": lambda df: df.where(
            F.col("expires_at").isNull() | (F.col("expires_at") >= instant(as_of))
        ),
    }
    return {name: rules[name](df) if name in rules else df for name, df in tables.items()}


def _partition_folders(spark: SparkSession, root: str, table: str, column: str) -> list[tuple[str, object]]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path(root, table))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{column}="):
            found.append((name.split("=", 1)[1], status.getPath()))
    return found


def drop_partitions(spark: SparkSession, root: str, table: str, column: str, values: set[str]) -> int:
    """Remove whole top-level partitions: no data is read or rewritten."""
    gone = 0
    for value, path in _partition_folders(spark, root, table, column):
        if value in values:
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            gone += bool(fs.delete(path, True))
    return gone


def purge(
    spark: SparkSession,
    root: str,
    runs: DataFrame,
    as_of: datetime,
    *,
    raw_days: int = RAW_DAYS,
    ioc_days: int = IOC_DAYS,
) -> dict[str, int]:
    """Drop the partitions that retention no longer keeps."""
    old = {
        r.run_id
        for r in runs.where(F.col("started_at") < before(as_of, days=raw_days)).select("run_id").collect()
    }
    removed = {"events": drop_partitions(spark, root, "events", "run_id", old)}
    limit = (as_of - timedelta(days=ioc_days)).date().isoformat()
    for table in ("ioc_dns", "ioc_flow"):
        days = {d for d, _ in _partition_folders(spark, root, table, "day") if d < limit}
        removed[table] = drop_partitions(spark, root, table, "day", days)
    return {k: v for k, v in removed.items() if v}


def check_deletable(runs: DataFrame, run_id: str, *, force: bool = False) -> None:
    """Raise unless the run is known and, without ``force``, finished."""
    row = runs.where(F.col("run_id") == run_id).select("finished_at").head()
    if row is None:
        raise RunDeletionError(f"no run {run_id!r}")
    if row.finished_at is None and not force:
        raise RunDeletionError(f"run {run_id!r} has not finished; force to remove it anyway")


def without_run(tables: Mapping[str, DataFrame], run_id: str) -> dict[str, DataFrame]:
    """Tables without the rows of one run; tables no single run owns are returned as they are."""
    return {
        name: df.where(F.col("run_id") != run_id) if name in (*RUN_TABLES, "runs") else df
        for name, df in tables.items()
    }


def delete_run(
    spark: SparkSession, root: str, runs: DataFrame, run_id: str, *, force: bool = False
) -> dict[str, int]:
    """Drop one run's partitions of the tables partitioned by run first."""
    check_deletable(runs, run_id, force=force)
    tables = [t for t in RUN_TABLES if not t.startswith("ioc_")]
    removed = {t: drop_partitions(spark, root, t, "run_id", {run_id}) for t in tables}
    for table in ("ioc_dns", "ioc_flow"):
        removed[table] = 0
        for day, _ in _partition_folders(spark, root, table, "day"):
            removed[table] += drop_partitions(
                spark, table_path(root, table), f"day={day}", "run_id", {run_id}
            )
    return {k: v for k, v in removed.items() if v}


def evolve_schema(old: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Old rows in a newer layout: columns that were added later are null."""
    return conform(old, schema)


# ----- analyst views


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame], run_id: str) -> None:
    """Views for ad-hoc SQL. The view of the events holds one run, so no query can leave it."""
    for name, df in tables.items():
        scoped = df.where(F.col("run_id") == run_id) if name == "events" else df
        scoped.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, statement: str, limit: int | None = 200) -> DataFrame:
    """At most ``limit`` (1 to 1000) rows of a query over the registered views; all of them with ``None``."""
    rows = spark.sql(statement)
    return rows if limit is None else rows.limit(max(1, min(limit, 1000)))
