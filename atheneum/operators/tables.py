"""Tables as snapshots: scans, look-ups, and changes that give the next snapshot as a DataFrame.

Nothing is changed in place: each change is a union or an anti-join over the old rows, published by writing a new folder (``sources.store``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Store


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("deleted"))


def fresh(df: DataFrame, column: str, since: int) -> DataFrame:
    """Rows not older than ``since`` (epoch seconds)."""
    return df.filter(F.col(column) >= since)


def delta(updates: DataFrame, since, count: int = 250) -> DataFrame:
    """The next ``count`` updates after a checkpoint, oldest first."""
    return updates.filter(F.col("updated_at") > F.lit(since)).orderBy("updated_at", "page_id").limit(count)


def latest(rows: DataFrame, key: list[str], version: str, tie: str | None = None) -> DataFrame:
    """One row a key: that of the highest version, of these that with the largest ``tie``."""
    order = [F.desc(version)] if tie is None else [F.desc(version), F.desc(tie)]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` rows replace ``old`` ones with their key. ``new`` has one row a key: where it may have more, ``latest`` comes first."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def replace_group(old: DataFrame, new: DataFrame, changed: DataFrame, key: list[str], only: Column | None = None) -> DataFrame:
    """All old rows of the changed keys (of these, where ``only`` holds) make way for the new rows."""
    if only is None:
        return old.join(changed.select(*key), key, "left_anti").unionByName(new)
    gone = old.filter(only)
    return old.filter(~only).unionByName(gone.join(changed.select(*key), key, "left_anti")).unionByName(new).dropDuplicates()


def delete_pages(pages: DataFrame, chunks: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, chunks and edges (in either direction) without the pages of ``gone`` (page_id)."""
    ends = edges.join(gone.withColumnRenamed("page_id", "source_page_id"), "source_page_id", "left_anti").join(gone.withColumnRenamed("page_id", "target_page_id"), "target_page_id", "left_anti")
    return pages.join(gone, "page_id", "left_anti"), chunks.join(gone, "page_id", "left_anti"), ends


def soft_delete(df: DataFrame, key: str, ids: list[int]) -> DataFrame:
    return df.withColumn("deleted", F.col("deleted") | F.col(key).isin(ids))


def by_name_ci(df: DataFrame, name: str) -> DataFrame:
    """Rows of that name, letters A-Z in either case."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.filter(fold(F.col("name")) == fold(F.lit(name)))


def scoped(chunks: DataFrame, pages: DataFrame, books: list[int] = (), chapters: list[int] = (), page_ids: list[int] = (), shelves: list[int] = (), strict: bool = True) -> DataFrame:
    """Chunks of pages in any of the books, chapters or pages. Without any scope all chunks; shelves that were not resolved to books select nothing."""
    parts = [F.col(c).isin(list(ids)) for c, ids in (("book_id", books), ("chapter_id", chapters), ("page_id", page_ids)) if ids]
    if not parts:
        return chunks.filter(F.lit(False)) if shelves and strict else chunks
    wanted = pages.filter(reduce(lambda a, b: a | b, parts)).select("page_id")
    return chunks.join(wanted, "page_id", "left_semi")


def books_of_shelves(books: DataFrame, shelves: list[int]) -> DataFrame:
    return live(books).filter(F.col("shelf_id").isin(list(shelves))).select("book_id")


def cleared(df: DataFrame) -> DataFrame:
    """The table's next snapshot after everything in it was removed: its columns without rows."""
    return df.limit(0)


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def index_lookup(shelves: DataFrame, books: DataFrame, chapters: DataFrame, pages: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """(kind, id, name) of the wanted entry of each kind."""
    of = {"shelf": (shelves, "shelf_id"), "book": (books, "book_id"), "chapter": (chapters, "chapter_id"), "page": (pages, "page_id")}
    found = [by_id(of[k][0], of[k][1], v).select(F.lit(k).alias("kind"), F.col(of[k][1]).alias("id"), "name") for k, v in wanted.items()]
    return reduce(DataFrame.unionByName, found)


def page_by_key(index: DataFrame, identity: str, kind: str, key: str) -> DataFrame:
    """The live page (identity_ouid, page_kind, page_key) of an identity; of several that with the smallest id."""
    mine = (F.col("identity_ouid") == identity) & (F.col("page_kind") == kind) & (F.col("page_key") == key)
    return live(index.filter(mine)).orderBy("page_id").limit(1)


def upsert_index_pages(index: DataFrame, cache: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The index and the page cache after pages (of the index's columns but ``indexed_at``, with markdown, raw_markdown and html) were indexed ``now``."""
    rows = latest(new.withColumns({"indexed_at": F.lit(now).cast("long"), "cached_at": F.lit(now).cast("long")}), ["page_id"], "page_updated_at")
    return upsert(index, rows.select(*index.columns), ["page_id"]), upsert(cache, rows.select(*cache.columns), ["page_id"])


def publish_index_pages(store: Store, new: DataFrame, now: int) -> int:
    """The same in a store's tables ``index`` and ``cache``: both in one commit, so that a reader finds a page in both as it is now or as it was. Returns the version."""
    return store.update(lambda now_there: dict(zip(("index", "cache"), upsert_index_pages(now_there.read("index"), now_there.read("cache"), new, now), strict=True)), {"index": ["page_id"], "cache": ["page_id"]})


def masked(df: DataFrame, given: dict[str, Column]) -> DataFrame:
    """An update that names only some fields: a field that is not named, or null, stays."""
    return df.withColumns({c: F.coalesce(v, F.col(c)) for c, v in given.items()})


def set_edit(ids: Column, add: list[int] = (), remove: list[int] = ()) -> Column:
    """A sorted set of ids, some added and some removed."""
    these = lambda x: F.array(*[F.lit(i) for i in x]).cast("array<bigint>")
    return F.array_sort(F.array_except(F.array_union(ids, these(add)), these(remove)))


def recent(pages: DataFrame, updates: DataFrame, n: int) -> DataFrame:
    """The ``n`` pages updated last; those without a date come last, ties by id."""
    return pages.join(updates, "page_id", "left").orderBy(F.desc_nulls_last("updated_at"), "page_id").limit(n)


def window_of(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def last_shelf(shelf_books: DataFrame) -> DataFrame:
    """(book_id, shelf_id): of several shelves (book_id, shelf_id, ord) the last one holds."""
    return shelf_books.groupBy("book_id").agg(F.max_by("shelf_id", "ord").alias("shelf_id"))


def first_shelf(shelf_books: DataFrame) -> DataFrame:
    """(book_id, shelf_id): of several shelves (book_id, shelf_id, ord) the first one that has the book."""
    return shelf_books.groupBy("book_id").agg(F.min_by("shelf_id", "ord").alias("shelf_id"))
