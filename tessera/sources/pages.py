"""A data source of document pages: files that hold one image after the other.

``register(spark)``, then ``spark.read.format("pages").load(folder)`` gives
(file, file_no, page, content), a row a page, pages from 0. A partition is a
range of pages of one file; ranges that a filter on ``page``, ``file`` or
``file_no`` rules out are never opened. Options: ``glob`` (``*.ppm``) and
``pagesPerPartition`` (16).

The folder must be one that the driver and all executors can open by its path.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessera.functions.pixels import pages_of

_TESTS = {
    EqualTo: lambda v, x: v == x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    In: lambda v, xs: v in xs,
}


@dataclass
class PageRange(InputPartition):
    """Pages of one file: the first one's number, and where each stands."""

    path: str
    file_no: int
    first: int
    places: list[tuple[int, int]]


class PageReader(DataSourceReader):
    def __init__(self, path: str, glob: str, size: int):
        self.path, self.glob, self.size = path, glob, size
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters of one column and values are all taken; the others are left to Spark."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("page",), ("file",), ("file_no",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def fits(self, **values: object) -> bool:
        return all(_TESTS[kind](values[name], x) for name, kind, x in self.tests if name in values)

    def partitions(self) -> list[PageRange]:
        names = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, n) for n in fnmatch.filter(os.listdir(self.path), self.glob))
        out = []
        for i, name in enumerate(names):
            if not self.fits(file=os.path.basename(name), file_no=i):
                continue
            with open(name, "rb") as f:
                places = pages_of(f)
            for first in range(0, len(places), self.size):
                part = places[first : first + self.size]
                if any(self.fits(page=first + k) for k in range(len(part))):
                    out.append(PageRange(name, i, first, part))
        return out

    def read(self, partition: PageRange | None) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where there are none
            return
        with open(partition.path, "rb") as f:
            for k, (at, size) in enumerate(partition.places):
                if self.fits(page=partition.first + k):
                    f.seek(at)
                    yield os.path.basename(partition.path), partition.file_no, partition.first + k, f.read(size)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "file string, file_no int, page int, content binary"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], self.options.get("glob", "*.ppm"), int(self.options.get("pagesPerPartition", 16)))


def register(spark: SparkSession) -> None:
    """Let a session read the format ``pages``, and push filters to Python sources, which this one asks for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
