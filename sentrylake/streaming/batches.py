"""Tables that micro-batches write: each batch counts once, and small folders are packed into larger ones.

A head names the folders that make up the table and the last batch in them. It is published in one step
under the next number, so a batch that dies while it writes isn't seen, and one that is done again after its
head stands is passed over. ``PACKED`` folders of one level become one folder of the next level: with ``n``
batches there are at most ``PACKED`` folders for each digit of ``n``, and a row is written once a level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sentrylake.operators.history import latest_per_key
from sentrylake.sources import published

PACKED = 16
#: Size of the files that packing makes of rows without a key.
FILE_BYTES = 128 << 20
_BATCH = "_batch"


class BatchTable:
    """Rows of all batches, or with ``keys`` the row of each key that its last batch gave.

    A table belongs to one streaming checkpoint, whose batch numbers it goes by. Keys may be null; of several
    rows of one key in one batch any may stay. An unwritten table can't be read.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), *, packed: int = PACKED) -> None:
        self.spark, self.path, self.keys, self.packed = spark, path.rstrip("/"), list(keys), packed

    # ----- heads

    def _head(self) -> tuple[int, dict]:
        found = published.names(self.spark, f"{self.path}/heads")
        if not found:
            return 0, {"last": -1, "folders": [], "schema": None}
        return int(found[-1]), published.content(self.spark, f"{self.path}/heads/{found[-1]}")

    def _publish(self, number: int, head: dict) -> bool:
        return published.publish(self.spark, f"{self.path}/heads/{number:012d}", head)

    def folders(self) -> list[str]:
        return [name for name, _ in self._head()[1]["folders"]]

    # ----- writing

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def write(self, batch: DataFrame, number: int) -> bool:
        """Add a batch, unless it is in already; then pack what is to be packed."""
        if number <= self._head()[1]["last"]:
            return False
        name = self._write(batch.withColumn(_BATCH, F.lit(number).cast("long")))
        while True:
            at, head = self._head()
            if number <= head["last"]:
                return False  # another attempt of this batch was first
            grown = {"last": number, "folders": [*head["folders"], [name, 0]], "schema": batch.schema.json()}
            if self._publish(at + 1, grown):
                break
        while self.pack():
            pass
        return True

    def pack(self) -> bool:
        """Make one folder of those of the lowest level that has enough; false if none has, or the table changed meanwhile."""
        at, head = self._head()
        levels = [level for _, level in head["folders"]]
        full = [level for level in sorted(set(levels)) if levels.count(level) >= self.packed]
        if not full:
            return False
        old = [name for name, level in head["folders"] if level == full[0]]
        rows = self._rows(old, head)
        if self.keys:
            rows = latest_per_key(rows, self.keys, [_BATCH])
        else:
            rows = rows.coalesce(max(1, -(-sum(map(self._bytes, old)) // FILE_BYTES)))
        folders = [x for x in head["folders"] if x[0] not in old]
        return self._publish(at + 1, head | {"folders": [*folders, [self._write(rows), full[0] + 1]]})

    def _bytes(self, name: str) -> int:
        path, fs = published.locate(self.spark, f"{self.path}/data/{name}")
        return fs.getContentSummary(path).getLength()

    # ----- reading

    def _rows(self, names: list[str], head: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(head["schema"])).add(_BATCH, "long")
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{name}" for name in names])

    def read(self) -> DataFrame:
        head = self._head()[1]
        if head["schema"] is None:
            raise ValueError(f"no batch has been written to {self.path}")
        rows = self._rows([name for name, _ in head["folders"]], head)
        if self.keys:
            rows = latest_per_key(rows, self.keys, [_BATCH])
        return rows.drop(_BATCH)

    def vacuum(self, keep: int = 10) -> int:
        """Drop folders that none of the last ``keep`` heads names, and older heads; not while a batch is being written."""
        found = published.names(self.spark, f"{self.path}/heads")
        used = {name for x in found[-keep:] for name, _ in published.content(self.spark, f"{self.path}/heads/{x}")["folders"]}
        old = [name for name in published.names(self.spark, f"{self.path}/data") if name not in used]
        for x in found[:-keep]:
            published.remove(self.spark, f"{self.path}/heads/{x}")
        for name in old:
            published.remove(self.spark, f"{self.path}/data/{name}")
        return len(old)

