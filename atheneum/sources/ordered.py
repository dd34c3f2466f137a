"""An ordered table: files by ranges of its order, and a manifest of how many rows lie before each, so that a page far into a listing opens the files that hold it and no others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .log import SnapshotLog

NAME = "ordered:"
#: Rows of a file, about.
FILE_ROWS = 1_000_000


class OrderedTable:
    """``order`` has no ties. The manifest is the table's value in the commit log."""

    def __init__(self, log: SnapshotLog, name: str, schema: StructType, order: list[str], file_rows: int = FILE_ROWS):
        self.log, self.spark, self.name, self.schema, self.order, self.file_rows = log, log.spark, name, schema, order, file_rows

    def publish(self, rows: DataFrame) -> int:
        """These rows are the table from now on."""
        folder, files = f"{self.name}/{uuid.uuid4().hex}", max(1, -(-rows.count() // self.file_rows))
        rows.select(*self.schema.names).repartitionByRange(files, *self.order).sortWithinPartitions(*self.order).write.parquet(f"{self.log.root}/{folder}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.log.root}/{folder}")
        counted = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.min(F.struct(*self.order)).alias("first")).orderBy("first").collect()  # a row a file
        manifest, before = [], 0
        for r in counted:
            manifest.append({"file": r.file, "before": before, "n": r.n})
            before += r.n
        return self.log.transact(lambda _: {NAME + self.name: {"folder": folder, "files": manifest}})

    def _manifest(self) -> dict:
        return self.log.state()[1].get(NAME + self.name) or {"folder": "", "files": []}

    def count(self) -> int:
        return sum(f["n"] for f in self._manifest()["files"])

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order, in order, with their place ``pos`` from 1."""
        manifest = self._manifest()
        files = [f for f in manifest["files"] if f["before"] < offset + limit and f["before"] + f["n"] > offset]
        if not files:
            return self.spark.createDataFrame([], self.schema).withColumn("pos", F.lit(0).cast("long"))
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.log.root}/{manifest['folder']}/{f['file']}" for f in files]).withColumn("_file", F.col("_metadata.file_name"))
        before = F.create_map(*[F.lit(x) for f in files for x in (f["file"], f["before"])])[F.col("_file")]
        place = F.row_number().over(Window.partitionBy("_file").orderBy(*self.order)) + before
        found = rows.withColumn("pos", place.cast("long")).drop("_file")
        return found.filter((F.col("pos") > offset) & (F.col("pos") <= offset + limit)).orderBy("pos")
