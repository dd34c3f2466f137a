"""Tables in buckets by key that merge on read: a change writes only what changes.

A table is a base, one folder a bucket, and deltas, each the rows of one change. A key's rows are those of the newest delta that names it, or else the base's: so a delta replaces all rows
of its keys, and a key that it names without rows is gone. The manifest (which folders hold which buckets) is the table's value in the commit log (``log``), so several tables change in one
commit. A reader that knows its keys opens only their buckets. Compaction rewrites the buckets that deltas touch, and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .log import Conflict, SnapshotLog, Stale

BUCKETS, TRIES = 64, 50
NAME = "merge:"


class MergeTable:
    """``key`` names what a change replaces; ``bucket_by`` (of the key's columns; all of them unless given) decides the bucket."""

    def __init__(self, log: SnapshotLog, name: str, schema: StructType, key: list[str], bucket_by: list[str] | None = None, buckets: int = BUCKETS):
        self.log, self.name, self.schema, self.key, self.bucket_by, self.buckets = log, name, schema, key, bucket_by or key, buckets
        self.spark, self._listed = log.spark, {}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast(self.schema[c].dataType) for c in self.bucket_by]), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, what: str) -> tuple[str, list[int]]:
        """The folder, and the buckets it has rows of."""
        folder = f"{self.name}/{what}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.log.root}/{folder}")
        names = [f.getPath().getName() for f in self.log.fs.listStatus(self.log.path(folder))]
        return folder, sorted(int(n.partition("=")[2]) for n in names if n.startswith("_bucket="))

    def _manifest(self, state: dict) -> dict:
        return state.get(NAME + self.name) or {"base": {}, "deltas": []}

    def _folder(self, folder: str, schema: StructType) -> DataFrame:
        """A folder's files; they never change, so they are listed once."""
        if folder not in self._listed:
            self._listed[folder] = self.spark.read.schema(StructType([*schema.fields]).add("_bucket", "integer")).parquet(f"{self.log.root}/{folder}")
        return self._listed[folder]

    def _files(self, folders: dict[str, list[int]], schema: StructType) -> DataFrame:
        """The rows of some buckets of each folder: these are partitions, and others are not opened."""
        parts = [self._folder(folder, schema).filter(F.col("_bucket").isin(buckets)).drop("_bucket") for folder, buckets in folders.items() if buckets]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def buckets_of(self, values: Iterable[tuple]) -> list[int]:
        """The buckets of these values of ``bucket_by``."""
        fields = StructType([self.schema[c] for c in self.bucket_by])
        return sorted({r[0] for r in self.spark.createDataFrame(list(values), fields).select(self._bucket()).collect()})

    def replaced(self, rows: DataFrame) -> dict:
        """The change that makes these rows the whole table, for ``SnapshotLog.transact``."""
        folder, buckets = self._write(rows.select(*self.schema.names), "base")
        return {NAME + self.name: {"base": {str(b): folder for b in buckets}, "deltas": []}}

    def delta(self, rows: DataFrame, gone: DataFrame | None = None) -> dict:
        """Writes a change: the new rows of their keys, and keys (of ``gone``) that have no others. Returns what ``added`` takes."""
        new = rows.select(*self.schema.names, F.lit(False).alias("_gone"))
        if gone is not None:
            empty = gone.select(*self.key).join(rows.select(*self.key), self.key, "left_anti").distinct()
            new = new.unionByName(empty.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        folder, buckets = self._write(new, "delta")
        return {"folder": folder, "buckets": buckets}

    def added(self, state: dict, delta: dict) -> dict:
        """The change of the log's state that adds a written delta. Deltas count in the order of their commits, so one that lost the race is added after the winner's, not written again."""
        old = self._manifest(state)
        return {NAME + self.name: {"base": old["base"], "deltas": [*old["deltas"], delta] if delta["buckets"] else old["deltas"]}}

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        delta = self.delta(rows, gone)
        return self.log.transact(lambda state: self.added(state, delta))

    def update(self, change: Callable[[DataFrame], DataFrame | None], values: Iterable[tuple] | None = None) -> int | None:
        """Upserts what ``change`` makes of the rows (or of those in the buckets of ``values``); made again if another commit changed the table meanwhile. None if there is nothing to change."""
        for _ in range(TRIES):
            version, state = self.log.state()
            rows = change(self.read(values, state))
            if rows is None:
                return None
            delta = self.delta(rows)

            def same(now: dict, state=state, delta=delta) -> dict:
                if self._manifest(now) != self._manifest(state):
                    raise Stale
                return self.added(now, delta)

            try:
                return self.log.transact(same)
            except Stale:
                self.log.fs.delete(self.log.path(delta["folder"]), True)
        raise Conflict(f"{self.name}: {TRIES} changes of others came first")

    def read(self, values: Iterable[tuple] | None = None, state: dict | None = None) -> DataFrame:
        """All rows, or those in the buckets of ``values`` of ``bucket_by``: other rows of these buckets come along."""
        return self._merged(self._manifest(self.log.state()[1] if state is None else state), None if values is None else set(self.buckets_of(values)))

    def _merged(self, manifest: dict, wanted: set[int] | None) -> DataFrame:
        own = lambda buckets: [b for b in map(int, buckets) if wanted is None or b in wanted]
        base: dict[str, list[int]] = {}
        for b in own(manifest["base"]):
            base.setdefault(manifest["base"][str(b)], []).append(b)
        rows = self._files(base, self.schema)
        schema = StructType([*self.schema.fields]).add("_gone", "boolean")
        deltas = [self._files({d["folder"]: buckets}, schema).withColumn("_seq", F.lit(i)) for i, d in enumerate(manifest["deltas"]) if (buckets := own(d["buckets"]))]
        if not deltas:
            return rows
        changes = reduce(DataFrame.unionByName, deltas)
        newest = changes.groupBy(*[F.col(c).alias(f"_k_{c}") for c in self.key]).agg(F.max("_seq").alias("_newest"))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in self.key])
        live = changes.join(newest, same & (F.col("_seq") == F.col("_newest")), "left_semi").filter(~F.col("_gone")).select(*self.schema.names)
        return rows.join(newest, same, "left_anti").unionByName(live)

    def compact(self, least: int = 4) -> list[int]:
        """Rewrites the buckets that at least so many deltas touch; the others stay as they are. If another commit changes the table meanwhile, its deltas come after the new base.
        Returns the buckets."""
        _, state = self.log.state()
        before = self._manifest(state)
        touched = [b for b in range(self.buckets) if sum(b in d["buckets"] for d in before["deltas"]) >= least]
        if not touched:
            return []
        folder, filled = self._write(self._merged(before, set(touched)), "base")

        def change(now: dict) -> dict:
            manifest = self._manifest(now)
            if manifest["base"] != before["base"] or manifest["deltas"][: len(before["deltas"])] != before["deltas"]:
                return {}  # replaced or compacted by another; this rewrite is not needed
            base = {b: f for b, f in manifest["base"].items() if int(b) not in touched} | {str(b): folder for b in filled}
            old = [d | {"buckets": [b for b in d["buckets"] if b not in touched]} for d in before["deltas"]]
            return {NAME + self.name: {"base": base, "deltas": [d for d in old if d["buckets"]] + manifest["deltas"][len(old) :]}}

        self.log.transact(change)
        return touched
