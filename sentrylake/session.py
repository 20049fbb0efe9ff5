"""Session helpers: where scratch tables go, and settings that results depend on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = "file:" + tempfile.mkdtemp(prefix="sentrylake-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str, partition_by: tuple[str, ...] = ()):
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives executor loss.

    A written table also has a known size. A join that filters events by a derived frame would
    otherwise be planned as a shuffle of all events; with the size at hand the planner broadcasts the
    frame when it is below its threshold and shuffles only when it is not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
