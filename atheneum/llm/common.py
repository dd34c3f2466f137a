"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are compared: it sorts before every other id.
NULL_ID = -(2**63)
#: Bytes of text that vectorised operators take at once, to the next end of a text.
HASH_BYTES = 1 << 18
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB in this session: rows are whole texts, and each of a task's buffers holds one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="atheneum-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder written for this run, once nothing reads it any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def text_parts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive whole texts as bytes, about HASH_BYTES at a time, with the place of the first."""
    at, part, size = 0, [], 0
    for i, t in enumerate(column):
        part.append((t.as_py() or "").encode())
        size += len(part[-1])
        if size >= HASH_BYTES:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, so that Python objects made of a piece stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(fn: Callable) -> Callable:
    """``fn`` for ``mapInArrow`` or ``applyInArrow``, after which the Python worker, which waits for other tasks, holds no freed memory."""
    if inspect.isgeneratorfunction(fn):

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from fn(batches)
            finally:
                _give_back()

        return stream
    if len(inspect.signature(fn).parameters) == 2:

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return fn(left, right)
            finally:
                _give_back()

        return pair

    def one(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            _give_back()

    return one
