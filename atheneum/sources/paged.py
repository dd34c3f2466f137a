"""A paged listing as a Spark data source: one input partition a page, so pages are fetched in parallel and a lost one is fetched again."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def next_offset(offset: int, returned: int, total: int | None) -> int | None:
    """Where the next page starts: after the rows returned, however many were asked for. None after an empty page or the last row."""
    if returned <= 0:
        return None
    after = offset + returned
    return None if total is not None and after >= total else after


def walk(fetch: Callable[[int], tuple[list, int | None]]) -> Iterator:
    """All rows of ``fetch(offset) -> (rows, total)``, page by page."""
    offset: int | None = 0
    while offset is not None:
        rows, total = fetch(offset)
        yield from rows
        offset = next_offset(offset, len(rows), total)


#: A connector: (options, offset, count) -> (rows, total). The rows may be fewer than asked for; without a total the listing ends with an empty page.
Fetch = Callable[[dict, int, int], tuple[list[tuple], int | None]]


def parquet_pages(options: dict, offset: int, count: int) -> tuple[list[tuple], int | None]:
    """A connector to a Parquet file or folder: ``path`` and ``columns``, comma-separated. As servers do, it gives at most ``most`` rows at once. Of the row groups, only those
    that hold the rows asked for are read."""
    import pyarrow.dataset as ds

    count, columns = min(count, int(options.get("most", count))), options["columns"].split(",")
    out, at = [], 0
    for file in ds.dataset(options["path"]).get_fragments():
        for i, group in enumerate(file.row_groups):  # their numbers of rows are in the footer: what lies before is passed over unread
            low, high = max(0, offset - at), min(group.num_rows, offset + count - at)
            if low < high:
                part = file.subset(row_group_ids=[group.id if hasattr(group, "id") else i]).to_table(columns=columns).slice(low, high - low)
                out += list(zip(*(c.to_pylist() for c in part.columns), strict=True))
            at += group.num_rows
    return out, at


class Page(InputPartition):
    def __init__(self, start: int, stop: int | None):
        super().__init__(start)
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    """The first page tells how many rows a request really gives and how many there are; from these the pages are dealt out. Without a total one partition walks on alone."""

    def __init__(self, options: dict):
        module, _, name = options["connector"].partition(":")
        self.options, self.fetch = dict(options), getattr(importlib.import_module(module), name)
        self.count = int(options.get("page_size", "100"))

    def partitions(self) -> list[InputPartition]:
        rows, total = self.fetch(self.options, 0, self.count)
        if not rows or total is None:
            return [Page(0, None if rows else 0)]
        return [Page(o, min(o + len(rows), total)) for o in range(0, total, len(rows))]

    def read(self, partition: Page) -> Iterator[tuple]:
        at: int | None = partition.start
        while at is not None and (partition.stop is None or at < partition.stop):
            wanted = self.count if partition.stop is None else partition.stop - at
            rows, total = self.fetch(self.options, at, wanted)
            yield from rows
            at = next_offset(at, len(rows), total)


class PagedListing(DataSource):
    """``spark.read.format("paged_listing").schema(...)``: the rows of a paged listing, one input partition a page. The option ``connector`` names the function that
    fetches a page as ``module:function``; it gets all options."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "id bigint, name string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
