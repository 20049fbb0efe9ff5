"""Small files that appear whole or not at all: what manifests and version pointers are made of."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def locate(spark: SparkSession, uri: str):
    """The path of a URI and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, uri: str, content: dict, *, replace: bool = False) -> bool:
    """Write ``content`` as JSON beside ``uri`` and give it its name in one step.

    Without ``replace`` the step fails if the name is taken, and the answer is false: of several writers
    of one name exactly one succeeds. That is an atomic rename on HDFS and a hard link on a local disk; a
    store without atomic renames needs a committer of its own.
    """
    path, fs = locate(spark, uri)
    body = json.dumps(content, sort_keys=True).encode()
    fs.mkdirs(path.getParent())
    if fs.getUri().getScheme() == "file":
        return _publish_local(path.toUri().getPath(), body, replace)
    return _publish_renamed(spark, path, fs, body, replace)


def _publish_local(target: str, body: bytes, replace: bool) -> bool:
    folder, name = os.path.split(target)
    hidden = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(hidden, "wb") as f:
        f.write(body)
        f.flush()
        os.fsync(f.fileno())
    if replace:
        os.replace(hidden, target)
        return True
    try:
        os.link(hidden, target)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(hidden)


def _publish_renamed(spark: SparkSession, path, fs, body: bytes, replace: bool) -> bool:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    hidden = hadoop.Path(path.getParent(), f".{path.getName()}-{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(body))
    out.close()
    mode = gateway.new_array(hadoop.Options.Rename, 1)
    mode[0] = hadoop.Options.Rename.OVERWRITE if replace else hadoop.Options.Rename.NONE
    files = hadoop.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(hidden, path, mode)
        return True
    except Py4JJavaError:
        if not fs.exists(path):
            raise
        fs.delete(hidden, False)
        return False


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the published files of a folder, in order; hidden ones are still being written."""
    path, fs = locate(spark, folder)
    if not fs.exists(path):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n for n in found if not n.startswith((".", "_")))


def content(spark: SparkSession, uri: str) -> dict:
    path, fs = locate(spark, uri)
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def remove(spark: SparkSession, uri: str) -> bool:
    path, fs = locate(spark, uri)
    return bool(fs.delete(path, True))


def changed_before(spark: SparkSession, uri: str, moment: datetime) -> bool:
    path, fs = locate(spark, uri)
    return fs.getFileStatus(path).getModificationTime() < moment.timestamp() * 1000
