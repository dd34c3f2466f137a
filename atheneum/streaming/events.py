"""Events to work: which jobs an event asks for, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources import delta

EVENT_SCHEMA = "event string, related_item struct<id: bigint, book_id: bigint>"


def parse(payload: Column) -> Column:
    """(event, item_id, book_id) of an event's JSON; what is missing is null."""
    p = F.from_json(payload, EVENT_SCHEMA)
    return F.struct(p["event"].alias("event"), p["related_item"]["id"].alias("item_id"), p["related_item"]["book_id"].alias("book_id"))


def route_embed(events: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(event_id, scope): embedding jobs, ``delete:page:N`` and ``delete:role:N`` for what goes at once.

    Events meet the (static) books and chapters in joins, so the same function serves a stream.
    """
    of_shelf = books.filter("NOT deleted AND shelf_id IS NOT NULL").groupBy("shelf_id").agg(F.array_sort(F.collect_list("book_id")).alias("shelf_books"))
    where = chapters.select(F.col("chapter_id"), F.col("book_id").alias("old_book"))
    rows = events.join(of_shelf, F.col("event").startswith("bookshelf_") & (F.col("item_id") == F.col("shelf_id")), "left")
    rows = rows.join(where, (F.col("event") == "chapter_move") & (F.col("item_id") == F.col("chapter_id")), "left")
    e, item, book = F.col("event"), F.col("item_id"), F.col("book_id")
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    source = F.when(item.isNotNull() & F.col("old_book").isNull(), "all").when(F.col("old_book").isNotNull() & (book.isNull() | (F.col("old_book") != book)), F.concat(F.lit("book:"), F.col("old_book")))
    scopes = (
        F.when(e.isin("page_create", "page_update", "page_restore", "page_move"), some(F.concat(F.lit("page:"), item)))
        .when(e == "page_delete", some(F.concat(F.lit("delete:page:"), item)))
        .when(e.isin("chapter_create", "chapter_update", "chapter_delete"), some(F.concat(F.lit("book:"), book)))
        .when(e == "chapter_move", some(F.concat(F.lit("book:"), book), source))
        .when(e.isin("book_update", "book_sort", "book_create_from_chapter"), some(F.concat(F.lit("book:"), item)))
        .when(e.isin("bookshelf_create_from_book", "bookshelf_update", "bookshelf_delete"), F.coalesce(F.transform("shelf_books", lambda b: F.concat(F.lit("book:"), b)), F.array(F.lit("all"))))
        .when(e.isin("role_create", "role_update", "permissions_update"), F.array(F.lit("acl_reconcile")))
        .when(e == "role_delete", some(F.concat(F.lit("delete:role:"), item), F.lit("acl_reconcile")))
    )
    return rows.select("event_id", F.explode(scopes).alias("scope"))


def route_index(events: DataFrame) -> DataFrame:
    """(event_id, scope): index jobs, and ``delete:KIND:N`` for soft deletions."""
    e, item = F.col("event"), F.col("item_id")
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    gone = lambda kind: F.concat(F.lit(f"delete:{kind}:"), item)
    scopes = (
        F.when(e.isin("page_create", "page_update", "page_restore", "page_move"), some(F.concat(F.lit("page:"), item)))
        .when(e == "page_delete", some(gone("page")))
        .when(e == "chapter_delete", some(gone("chapter"), F.lit("all")))
        .when(e == "book_delete", some(gone("book"), F.lit("all")))
        .when(e == "bookshelf_delete", some(gone("shelf"), F.lit("all")))
        .when(e.isin("chapter_create", "chapter_update", "chapter_move", "book_update", "book_sort", "book_create_from_chapter", "bookshelf_create_from_book", "bookshelf_update"), F.array(F.lit("all")))
    )
    return events.select("event_id", F.explode(scopes).alias("scope"))


def delta_walk(spark: SparkSession, stream: DataFrame, checkpoint: str, process: Callable[[DataFrame], DataFrame], retry: Callable[[DataFrame], None], publish: Callable[[DataFrame, int], None]) -> None:
    """Takes in what a stream has new since the last walk, and returns when that is done.

    ``process`` gives rows with an ``error`` column. Rows with an error go to ``retry``; the others are published, once for each batch: the checkpoint holds the batch's number,
    and publishing the same number twice replaces it. If even ``retry`` fails the walk ends there with that error, nothing of the batch is published, and the next walk begins with it again.
    """

    def window(batch: DataFrame, number: int) -> None:
        done = process(batch).persist()
        try:
            retry(done.filter("error IS NOT NULL"))
            publish(done.filter("error IS NULL").drop("error"), number)
        finally:
            done.unpersist()

    query = stream.writeStream.foreachBatch(window).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def files_since(spark: SparkSession, source: str, schema: StructType, files: int = 250) -> DataFrame:
    """A stream of the files of a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)


def updates_since(spark: SparkSession, schema: str, since: str | None = None, **options: str) -> DataFrame:
    """A stream of the rows of a listing by (time, id), see ``sources.delta``."""
    spark.dataSource.register(delta.DeltaListing)
    own = options | ({} if since is None else {"since": since})
    return spark.readStream.format("delta_listing").schema(schema).options(**own).load()


class _OpenJobs(StatefulProcessor):
    """Of one scope: the event that made the job which is still to be done, if there is one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "event_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["event_id", "ends"], ascending=[True, False])
        made, going = [], self.open.exists()
        for event, ends in zip(events["event_id"].tolist(), events["ends"].tolist(), strict=True):
            if ends:
                going = False
                self.open.clear()
            elif not going:
                going = True
                made.append(event)
                self.open.update((event,))
        yield pd.DataFrame({"scope": pd.Series([key[0]] * len(made), dtype=object), "event_id": pd.Series(made, dtype="int64")})

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_jobs(requests: DataFrame) -> DataFrame:
    """(scope, event_id) of the jobs that a stream of (event_id, scope, ends) makes: a request makes one unless one of its scope is still to be done; an event that ``ends`` a scope's job
    makes room for the next. The state holds one row a scope with an open job, and none for others. Events come in order, at least from batch to batch."""
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return requests.groupBy("scope").transformWithStateInPandas(_OpenJobs(), "scope string, event_id bigint", "Append", "None")
