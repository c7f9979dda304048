"""Archive listings and zipped archives as batch sources: filters decide what is listed, tasks do the listing and reading."""

from __future__ import annotations

import csv
import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Objects lie under ``raw/<day>/<hour>/<26 letters and digits>.ndjson.gz``; whatever else is listed doesn't count (fixed layout).
OBJECT = r"/raw/(\d{4}-\d{2}-\d{2})/([01]\d|2[0-3])/[0-9A-HJKMNP-TV-Z]{26}\.ndjson\.gz$"
#: Partitions that list the days of a range at most.
MOST_PARTITIONS = 1000
ROWS_AT_ONCE = 20_000


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system of pyarrow (local, HDFS, S3, ...) and the path in it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (pafs.LocalFileSystem(), path)


def _folders(store: pafs.FileSystem, path: str) -> list[str]:
    return [f.base_name for f in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.type == pafs.FileType.Directory]


@dataclass
class Days(InputPartition):
    days: list[date]


@dataclass
class Wanted:
    """What the filters leave: days from ``first`` to ``last`` (or those of ``days``), and hours."""

    first: date | None = None
    last: date | None = None
    days: set[date] | None = None
    hours: set[int] = field(default_factory=lambda: set(range(24)))

    def take(self, f: Filter) -> bool:
        """Whether the filter is taken over whole."""
        column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        values = set(f.value) if isinstance(f, In) else {f.value} if isinstance(f, EqualTo) else None
        if column in ("day", "hour") and isinstance(f, IsNotNull):
            return True  # they always have a value
        if column not in ("day", "hour") or (values is None and not isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))):
            return False
        if values is not None:
            values.discard(None)
            if column == "hour":
                self.hours &= values
            else:
                self.days = values if self.days is None else self.days & values
            return True
        if f.value is None:
            return False
        above, strict = isinstance(f, (GreaterThan, GreaterThanOrEqual)), isinstance(f, (GreaterThan, LessThan))
        if column == "hour":
            self.hours = {h for h in self.hours if (h > f.value or (h == f.value and not strict) if above else h < f.value or (h == f.value and not strict))}
        elif above:
            bound = f.value + timedelta(days=int(strict))
            self.first = bound if self.first is None else max(self.first, bound)
        else:
            bound = f.value - timedelta(days=int(strict))
            self.last = bound if self.last is None else min(self.last, bound)
        return True


class ArchiveObjects(DataSource):
    """``spark.read.format("archive_objects").load(root)``: ``day, hour, path, size`` of each object of an archive.

    Filters on ``day`` and ``hour`` go into the listing (``spark.sql.python.filterPushdown.enabled``): only the folders of the
    asked days and hours are listed, each by the task that has the day.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_objects"

    def schema(self) -> str:
        return "day date, hour int, path string, size long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"])


class ArchiveReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.wanted = root.rstrip("/"), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        w = self.wanted
        if w.days is not None:
            days = sorted(w.days)
        elif w.first is not None and w.last is not None:
            days = [w.first + timedelta(days=k) for k in range((w.last - w.first).days + 1)]
        else:  # an open range: the days that there are, by one listing of their folders
            store, path = open_store(self.root)
            days = sorted(date.fromisoformat(n) for n in _folders(store, f"{path}/raw") if re.fullmatch(r"\d{4}-\d{2}-\d{2}", n))
        days = [d for d in days if (w.first is None or d >= w.first) and (w.last is None or d <= w.last)]
        step = -(-len(days) // MOST_PARTITIONS) or 1
        return [Days(days[a : a + step]) for a in range(0, len(days), step)] or [Days([])]

    def read(self, partition: Days) -> Iterator[tuple]:
        store, path = open_store(self.root)
        prefix = self.root[: len(self.root) - len(path)] if self.root.endswith(path) else ""
        for day in partition.days:
            for hour in sorted(self.wanted.hours):
                folder = f"{path}/raw/{day}/{hour:02d}"
                for f in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                    full = f"{folder}/{f.base_name}"
                    if f.type == pafs.FileType.File and re.search(OBJECT, full):
                        yield day, hour, prefix + full, f.size


@dataclass
class Member(InputPartition):
    archive: str
    name: str


class ZippedCsv(DataSource):
    """``spark.read.format("zipped_csv").schema(...).load("folder/202407*.zip")``: rows of a CSV member of each archive.

    A partition is a member: its archive's directory is read at planning, the member is streamed through the task, so that
    neither is ever in memory whole. Columns go by the header; missing ones are null. ``members`` is ``first`` (the first
    ``.csv`` of each archive, an error if there is none) or ``all``. A wild card stands in the last part of the path only.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader(schema, self.options["path"], self.options.get("members", "first"))


class ZipReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, members: str):
        self.columns, self.path, self.members = schema.names, path, members

    def partitions(self) -> list[InputPartition]:
        folder, _, pattern = self.path.rpartition("/")
        store, inside = open_store(folder or ".")
        names = sorted(f.base_name for f in store.get_file_info(pafs.FileSelector(inside, allow_not_found=True)) if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))
        if not names:
            raise FileNotFoundError(f"no archive at {self.path}")
        out = []
        for n in names:
            with store.open_input_file(f"{inside}/{n}") as f, zipfile.ZipFile(f) as z:
                found = [m for m in z.namelist() if m.lower().endswith(".csv")]
                if not found:
                    raise ValueError(f"no .csv member in {n}")
                out += [Member(f"{folder}/{n}" if folder else n, m) for m in (found if self.members == "all" else found[:1])]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        store, inside = open_store(partition.archive)
        with store.open_input_file(inside) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
            rows, batch = csv.DictReader(io.TextIOWrapper(member, "utf-8", "replace")), []
            for row in rows:
                batch.append([row.get(c) for c in self.columns])
                if len(batch) == ROWS_AT_ONCE:
                    yield self._batch(batch)
                    batch = []
            if batch:
                yield self._batch(batch)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], self.columns)
