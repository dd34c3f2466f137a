"""Rows settled on the way: written to the shared folder, so that what follows neither computes them again nor piles up their plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a temporary one only where none is set and all run on this machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="atheneum-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows, checkpointed to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def pool(df: DataFrame, most: int) -> DataFrame:
    """The rows of a search pool, which has at most so many by its limits, as a local table: joins with it need no shuffle, and it is computed once."""
    rows = df.limit(most + 1).toArrow()
    if len(rows) > most:
        raise ValueError(f"a pool of more than {most} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)  # from Arrow, so that the planner knows its size


#: Rows that are held by the driver between two steps of a query, about a megabyte.
HELD = 20_000


def held(df: DataFrame, most: int = HELD) -> DataFrame:
    """The rows, worked out once: as a local table if they are few, so that joins with them need no shuffle; checkpointed beyond that."""
    rows = df.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= most else settled(df)


#: Rows that a task is given where each of them becomes many.
ROWS_A_TASK = 100_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, of about so many ``rows``, dealt by these columns over as many tasks as it takes for ``ROWS_A_TASK`` each. Rows that are about to become many are small before that, so
    the planner would put too many of them into one task; what then groups or orders by these columns needs no other shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *by)


#: Ranges that an order is numbered in at most, and sampled keys of each.
RANGES, KEYS_A_RANGE = 256, 32


def numbered(df: DataFrame, *order: str, name: str = "pos", descending: bool = False) -> DataFrame:
    """``df`` with its place, from 1, in the order of these columns (which should have no ties).

    Keys with the smallest hashes are a sample whose quantiles cut the order into ranges; rows are numbered within their range, after the counts of the ranges before, so no task
    sees all rows. The ranges are constants of the plan: nothing is checkpointed, and filters and columns still reach the scan."""
    ranges = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = df.select(*order).orderBy(F.xxhash64(*order)).limit(ranges * KEYS_A_RANGE)
    keys = df.sparkSession.createDataFrame(sample.toArrow(), df.select(*order).schema).orderBy(*order).collect()
    if len(keys) < ranges * KEYS_A_RANGE:  # these are all rows: one range
        cuts = []
    else:
        cuts = [F.struct(*[F.lit(k[c]).cast(df.schema[c].dataType).alias(c) for c in order]) for k in keys[KEYS_A_RANGE::KEYS_A_RANGE]]

    def range_of(low: int, high: int) -> Column:
        """How many of the cuts a key has reached, between these; halved at each comparison."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.struct(*order) >= cuts[middle], range_of(middle + 1, high)).otherwise(range_of(low, middle))

    part = range_of(0, len(cuts))
    ranged = df.withColumn("_part", -part if descending else part)
    counts = ranged.groupBy("_part").count()
    # One row a range: this window is over as many rows as there are ranges.
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*[F.desc(c) if descending else F.asc(c) for c in order])
    place = F.row_number().over(within) + F.col("_before")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_part", "_before")
