"""Delivered audit files as a data source: filters on time, account and region choose folders and files before any is opened.

Layout: ``<root>/AWSLogs/[<org>/]<account>/CloudTrail/<region>/<Y>/<M>/<D>/<name>.json.gz``. A row is a file with
its whole text; ``earliest`` and ``latest`` bound its delivery, by the time in its name or else its day.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

NAME = "audit_files"
#: A name with the time of delivery.
FILE_STAMP = re.compile(r"_(\d{8}T\d{4})Z_")
#: Compressed bytes that one task reads, or one file.
TASK_BYTES = 64 << 20

_SCHEMA = "file string, account string, region string, earliest timestamp, latest timestamp, body string"
_ARROW = pa.schema(
    [("file", pa.string()), ("account", pa.string()), ("region", pa.string()), ("earliest", pa.timestamp("us", "UTC")), ("latest", pa.timestamp("us", "UTC")), ("body", pa.string())]
)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class FileGroup(InputPartition):
    """Files of one day folder: path, account, region, earliest, latest."""

    def __init__(self, files: list[tuple]):
        super().__init__(len(files))
        self.files = files


class AuditFiles(DataSource):
    """Option ``path`` is the root; filters do the rest."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> AuditFileReader:
        return AuditFileReader(self.options["path"])


class AuditFileReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.since: datetime | None = None  # of ``latest``
        self.until: datetime | None = None  # of ``earliest``
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take bounds and lists to choose files by; Spark tests every filter again, as a bound is taken with its edge."""
        for f in filters:
            match f:
                case GreaterThan(("latest",), value) | GreaterThanOrEqual(("latest",), value):
                    self.since = max(self.since or _utc(value), _utc(value))
                case LessThan(("earliest",), value) | LessThanOrEqual(("earliest",), value):
                    self.until = min(self.until or _utc(value), _utc(value))
                case EqualTo((("account" | "region") as column,), value):
                    self._only(column, {value})
                case In((("account" | "region") as column,), values):
                    self._only(column, set(values))
            yield f

    def _only(self, column: str, names: set[str]) -> None:
        self.only[column] = self.only.get(column, names) & names

    def _folders(self, files, path: str, level: str) -> list[tuple[str, str]]:
        """Folders below a path with their names, those left out that a filter on this level excludes."""
        from pyarrow import fs

        found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = [(i.path, i.base_name) for i in found if i.type == fs.FileType.Directory]
        return sorted((p, n) for p, n in names if level not in self.only or n in self.only[level])

    def _days(self, files, path: str) -> Iterator[tuple[str, date]]:
        """Day folders of a region that can hold files between the bounds; years and months outside aren't listed."""
        first = self.since and self.since.date()
        last = self.until and self.until.date()

        def within(low: date, high: date) -> bool:
            return (first is None or high >= first) and (last is None or low <= last)

        for y_path, y in self._folders(files, path, "year"):
            if not y.isdigit() or not within(date(int(y), 1, 1), date(int(y), 12, 31)):
                continue
            for m_path, m in self._folders(files, y_path, "month"):
                if not m.isdigit() or not 1 <= int(m) <= 12:
                    continue
                low = date(int(y), int(m), 1)
                if not within(low, low + timedelta(days=31)):
                    continue
                for d_path, d in self._folders(files, m_path, "day"):
                    try:
                        day = date(int(y), int(m), int(d))
                    except ValueError:
                        continue
                    if within(day, day):
                        yield d_path, day

    def partitions(self) -> list[FileGroup]:
        from pyarrow import fs

        files, top = _open(f"{self.root}/AWSLogs")
        groups: list[FileGroup] = []
        trails = [(p, n) for p, n in self._folders(files, top, "any")]
        accounts = [(p, n) for p, n in trails if not n.startswith("o-")]
        for p, n in trails:
            accounts += self._folders(files, p, "account") if n.startswith("o-") else []
        for a_path, account in accounts:
            if "account" in self.only and account not in self.only["account"]:
                continue
            for r_path, region in self._folders(files, f"{a_path}/CloudTrail", "region"):
                for d_path, day in self._days(files, r_path):
                    group, size = [], 0
                    for info in sorted(files.get_file_info(fs.FileSelector(d_path)), key=lambda i: i.path):
                        if info.type != fs.FileType.File or not info.base_name.endswith(".json.gz"):
                            continue
                        low, high = _bounds(info.base_name, day)
                        if (self.since and high < self.since) or (self.until and low > self.until):
                            continue
                        if group and size + info.size > TASK_BYTES:
                            groups.append(FileGroup(group))
                            group, size = [], 0
                        group.append((info.path, account, region, low, high))
                        size += info.size
                    if group:
                        groups.append(FileGroup(group))
        return groups

    def read(self, partition: FileGroup | None) -> Iterator[pa.RecordBatch]:
        """The files of a partition; there is none (Spark then hands over nothing) where no file is left."""
        files, _ = _open(f"{self.root}/AWSLogs")
        for path, account, region, low, high in partition.files if partition else ():
            with files.open_input_stream(path, compression=None) as f:
                body = gzip.decompress(f.read()).decode("utf-8", "replace")
            yield pa.RecordBatch.from_pydict(
                {"file": [path], "account": [account], "region": [region], "earliest": [low], "latest": [high], "body": [body]}, schema=_ARROW
            )


def _utc(value: datetime) -> datetime:
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def _bounds(name: str, day: date) -> tuple[datetime, datetime]:
    """When a file can have been delivered."""
    found = FILE_STAMP.search(name)
    if found:
        try:
            at = datetime.strptime(found[1], "%Y%m%dT%H%M").replace(tzinfo=timezone.utc)
            return at, at
        except ValueError:
            pass
    start = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
    return start, start + timedelta(days=1) - timedelta(microseconds=1)
