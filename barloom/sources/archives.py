"""Zip archives of daily files as a data source: a partition a session, members read as streams.

Register with ``spark.dataSource.register(DailyArchives)``, then
``spark.read.format("daily_archives").load(folder)`` gives rows (path, date, row).  The date is
that in a file's name; options ``since`` and ``until`` leave files unopened, and so do filters
on ``date`` with the option ``push``, which needs ``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import os
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

ISO, NAMED = re.compile(r"(\d{4})-?(\d{2})-?(\d{2})"), re.compile(r"(\d{2})-?([A-Za-z]{3})-?(\d{4})")
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_BOUNDS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


def local(path: str) -> str:
    """A path that Python opens: mounted folders, with or without ``file:``."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} is not on a mounted file system")
    return parts.path or path


def date_in(name: str) -> dt.date | None:
    """The date in a file's name: 2024-01-05, 20240105 or 05JAN2024."""
    if found := NAMED.search(name):
        month = MONTHS.get(found[2].lower())
        return dt.date(int(found[3]), month, int(found[1])) if month else None
    found = ISO.search(name)
    return dt.date(*map(int, found.groups())) if found else None


class _Session(InputPartition):
    def __init__(self, path: str, date: dt.date) -> None:
        self.path, self.date = path, date


def members(path: str) -> Iterator[dict[str, str]]:
    """Lines of all CSV members of an archive as maps by lower-cased header; no member is held whole."""
    with zipfile.ZipFile(path) as archive:
        for name in archive.namelist():
            if not name.lower().endswith(".csv"):
                continue
            with archive.open(name) as stream:
                lines = csv.reader(io.TextIOWrapper(stream, "utf-8-sig", "replace", newline=""))
                names = [x.strip().lower() for x in next(lines, [])]
                for cells in lines:
                    if any(c.strip() for c in cells):
                        yield dict(zip(names, cells, strict=False))


class _Reader(DataSourceReader):
    def __init__(self, folder: str, since: str | None, until: str | None) -> None:
        self.folder = folder
        self.tests = [(c, dt.date.fromisoformat(x)) for c, x in ((GreaterThanOrEqual, since), (LessThanOrEqual, until)) if x]

    def partitions(self) -> list[InputPartition]:
        dated = ((os.path.join(self.folder, n), date_in(n)) for n in sorted(os.listdir(self.folder)) if n.lower().endswith(".zip"))
        return [_Session(p, d) for p, d in dated if d and all(_BOUNDS[c](d, x) for c, x in self.tests)] or [_Session("", dt.date.min)]

    def read(self, partition: _Session) -> Iterator[tuple]:
        if partition.path:
            for row in members(partition.path):
                yield partition.path, partition.date, row


class _Pushed(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _BOUNDS and f.attribute == ("date",):
                self.tests.append((type(f), f.value))
            else:
                yield f


class DailyArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "daily_archives"

    def schema(self) -> str:
        return "path string, date date, row map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        kind = _Pushed if self.options.get("push", "").lower() == "true" else _Reader
        return kind(local(self.options["path"]), self.options.get("since"), self.options.get("until"))
