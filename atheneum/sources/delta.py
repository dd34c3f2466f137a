"""What has changed since, as a stream: a source whose offsets are (time, id) of the last row taken.

A connector lists rows by time and id. The stream's position is in Spark's checkpoint, so a walk that was stopped goes on where it was, and a batch that failed comes again with the
same rows. A batch is read in windows of rows, one input partition each, and each connector call seeks to its window's first key.
"""

from __future__ import annotations

import datetime
import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Rows of a window.
WINDOW = 250
Key = tuple[datetime.datetime, int]
EPOCH: Key = (datetime.datetime(1970, 1, 1), -1)


class ParquetDelta:
    """A connector to a Parquet file or folder with the columns named by ``at`` and ``id``; row groups without the keys asked for are not read."""

    def __init__(self, options: dict):
        import pyarrow.dataset as ds

        self.table, self.columns = ds.dataset(options["path"]), options["columns"].split(",")
        self.at, self.id = options.get("at", "updated_at"), options.get("id", "page_id")

    def _between(self, after: Key, upto: Key | None):
        import pyarrow.compute as pc

        at, id = pc.field(self.at), pc.field(self.id)
        later = (at > after[0]) | ((at == after[0]) & (id > after[1]))
        return later if upto is None else later & ((at < upto[0]) | ((at == upto[0]) & (id <= upto[1])))

    def _rows(self, columns: list[str], after: Key, upto: Key | None) -> list[tuple]:
        table = self.table.to_table(columns=columns, filter=self._between(after, upto)).sort_by([(self.at, "ascending"), (self.id, "ascending")])
        return list(zip(*(c.to_pylist() for c in table.columns), strict=True))

    def ends(self, after: Key, count: int, upto: Key | None = None) -> list[Key]:
        """The last key of each window of ``count`` rows; only the keys are read."""
        keys = self._rows([self.at, self.id], after, upto)
        return [keys[min(i + count, len(keys)) - 1] for i in range(0, len(keys), count)]

    def rows(self, after: Key, upto: Key) -> list[tuple]:
        return self._rows(list(dict.fromkeys([*self.columns, self.at, self.id])), after, upto)


class _Window(InputPartition):
    def __init__(self, after: Key, upto: Key):
        super().__init__(upto)
        self.after, self.upto = after, upto


def _offset(key: Key) -> dict:
    return {"at": key[0].isoformat(), "id": str(key[1])}


def _key(offset: dict) -> Key:
    return datetime.datetime.fromisoformat(offset["at"]), int(offset["id"])


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.wanted = dict(options) | {"columns": ",".join(columns)}, columns
        self.window, since = int(options.get("window", WINDOW)), options.get("since")
        self.start: Key = (datetime.datetime.fromisoformat(since), 2**62) if since else EPOCH
        self.seen = self.start

    def _connector(self):
        module, _, name = self.options["connector"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def initialOffset(self) -> dict:
        return _offset(self.start)

    def latestOffset(self) -> dict:
        ends = self._connector().ends(self.seen, self.window)
        if ends:
            self.seen = ends[-1]
        return _offset(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = _key(start), _key(end)
        if upto <= after:
            return []
        ends = self._connector().ends(after, self.window, upto)
        return [_Window(a, b) for a, b in zip([after, *ends], ends, strict=False)]

    def read(self, partition: _Window) -> Iterator[tuple]:
        n = len(self.wanted)
        return iter([r[:n] for r in self._connector().rows(partition.after, partition.upto)])


class DeltaListing(DataSource):
    """``spark.readStream.format("delta_listing").schema(...)`` with the options ``connector`` (``module:Class``), ``since`` (a time; rows of that very time are not taken), ``window`` and
    the connector's own."""

    @classmethod
    def name(cls) -> str:
        return "delta_listing"

    def schema(self) -> str:
        return "page_id bigint, updated_at timestamp_ntz"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options, schema.names)
