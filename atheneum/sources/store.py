"""Snapshots of tables: each is a new folder, and a log of commits says which ones hold.

A reader sees the state of one commit, never a mixture; tables that change together are committed together, and a change made to what another has replaced meanwhile is made again.
All paths go through Hadoop's file systems, so they may be in any store Spark reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Conflict, SnapshotLog, Stale

TABLE, META = "table:", "meta:"
TRIES = 50


class Snapshot:
    """The tables as of one commit; remembers which were read."""

    def __init__(self, store: Store, version: int, state: dict):
        self.store, self.version, self.state, self.seen = store, version, state, set()

    def read(self, table: str, schema=None) -> DataFrame:
        """The table's rows; empty, with the schema given, before its first snapshot."""
        self.seen.add(table)
        folder = self.state.get(TABLE + table)
        if folder is None:
            if schema is None:
                raise LookupError(f"{table} has no snapshot")
            return self.store.spark.createDataFrame([], schema)
        return self.store.spark.read.parquet(f"{self.store.root}/{folder}")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, SnapshotLog(spark, root)
        self.root = self.log.root

    def _write(self, table: str, df: DataFrame, key: list[str] | None = None, name: str = "") -> str:
        if key and not df.groupBy(*key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{table}: rows with the same {key}")
        folder = f"{table}/{name}{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def discard(self, folder: str) -> None:
        self.log.fs.delete(self.log.path(folder), True)

    def snapshot(self) -> Snapshot:
        return Snapshot(self, *self.log.state())

    def read(self, table: str, schema=None) -> DataFrame:
        return self.snapshot().read(table, schema)

    def publish(self, table: str, df: DataFrame, key: list[str] | None = None, number: int | None = None) -> str:
        """Writes the rows as the table's next snapshot, whatever it holds now. Keys must be unique; with a number, publishing again writes the same snapshot once more."""
        folder = self._write(table, df, key, "" if number is None else f"n{number}-")
        self.log.transact(lambda _: {TABLE + table: folder})
        return folder

    def update(self, change: Callable[[Snapshot], dict[str, DataFrame]], keys: dict[str, list[str]] | None = None) -> int:
        """Publishes the tables that ``change`` makes of a snapshot, all in one commit. If another commit has replaced one that was read or made, the change is made again from the new
        snapshot; other commits meanwhile don't matter. Returns the version."""
        for _ in range(TRIES):
            base = self.snapshot()
            made = {t: self._write(t, df, (keys or {}).get(t)) for t, df in change(base).items()}
            touched = [TABLE + t for t in base.seen | set(made)]

            def same(state: dict, base=base, touched=touched, made=made) -> dict:
                if any(state.get(t) != base.state.get(t) for t in touched):
                    raise Stale
                return {TABLE + t: folder for t, folder in made.items()}

            try:
                return self.log.transact(same)
            except Stale:
                for folder in made.values():
                    self.discard(folder)
        raise Conflict(f"{self.root}: {TRIES} changes of others came first")

    def backup(self, folder: str, stamp: str, keep: int = 5) -> str:
        """Copies every table of one snapshot to ``folder/backup-<stamp>``; the ``keep`` newest backups, by stamp, stay. A backup without its ``done`` file is not whole."""
        out, fs, now = f"{folder.rstrip('/')}/backup-{stamp}", self.log.fs, self.snapshot()
        for name in (t.removeprefix(TABLE) for t in now.state if t.startswith(TABLE)):
            now.read(name).write.mode("overwrite").parquet(f"{out}/{name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs.create(path(f"{out}/done")).close()
        made = sorted(f.getPath().toString() for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("backup-"))
        for old in made[:-keep]:
            fs.delete(path(old), True)
        return out

    def set(self, key: str, value) -> None:
        self.log.transact(lambda _: {META + key: [value]})

    def get(self, key: str, default=None):
        found = self.log.state()[1].get(META + key)
        return default if found is None else found[0]


def needs_reindex(store: Store, wanted: dict[str, object]) -> bool:
    """Whether the chunker's version, the model or its width differ from what the store was made with; a width that was never stored doesn't."""
    return any(store.get(k) != v and not (k == "embed_dims" and store.get(k) is None) for k, v in wanted.items())


def reindex_on_change(store: Store, wanted: dict[str, object], reindex: Callable[[], None]) -> bool:
    """Calls ``reindex``, which clears the search tables and queues a job for everything, if that is needed, and stores the new values only after it:
    whoever is stopped between the two does it again. Whether it was called."""
    needed = needs_reindex(store, wanted)
    if needed:
        reindex()
    for k, v in wanted.items():
        store.set(k, v)
    return needed


def needs_initial_walk(store: Store) -> bool:
    return store.get("last_full_walk_at") is None


def kv_latest(rows: DataFrame) -> DataFrame:
    """(key, value) of the highest version."""
    return rows.groupBy("key").agg(F.max_by("value", "version").alias("value"))
