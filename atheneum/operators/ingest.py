"""From pages to the search tables: chunks, vectors, links; and the walk that keeps the structural index."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import documents, text
from ..sources.staging import held, numbered, scratch, settled
from . import jobs as queue
from . import models, tables

MAX_FAILURES = 10


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_page_id, target_page_id, link_type) of (page_id, path): pages by slug, the first of that slug; short links by their number."""
    bare = F.regexp_replace("path", r"[?#].*$", "")
    rows = links.select("page_id", F.regexp_extract(bare, r"^/link/(\d+)$", 1).try_cast("bigint").alias("number"), F.regexp_extract(bare, r"/page/([^/]+)", 1).alias("slug"))
    slugs = pages.groupBy("slug").agg(F.min("page_id").alias("by_slug"))
    found = rows.join(slugs, "slug", "left").select(F.col("page_id").alias("source_page_id"), F.coalesce("number", "by_slug").alias("target_page_id"))
    return found.filter("target_page_id IS NOT NULL").distinct().withColumn("link_type", F.lit("link"))


def changed(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages whose content hash is new."""
    rows = pages.withColumn("content_hash", text.content_hash(F.col("html")))
    return rows.join(stored.select("page_id", F.col("content_hash").alias("old")), "page_id", "left").filter(~F.col("content_hash").eqNullSafe(F.col("old"))).drop("old")


class Ingested(NamedTuple):
    pages: DataFrame
    chunks: DataFrame
    links: DataFrame


def ingest(raw: DataFrame, books: DataFrame, chapters: DataFrame, shelves: DataFrame, pages: DataFrame, dims: int, make=models.hashing_embedder) -> Ingested:
    """The tables' new rows for raw pages (page_id, html) known to the index. A chunk that cannot be embedded has an ``error`` instead of its vector."""
    own = pages.join(books.select("book_id", F.col("name").alias("book"), "shelf_id"), "book_id", "left").join(chapters.select("chapter_id", F.col("name").alias("chapter")), "chapter_id", "left")
    own = own.join(shelves.select("shelf_id", F.col("name").alias("shelf")), "shelf_id", "left")
    rows = raw.join(own.select("page_id", F.col("name").alias("page"), "book", "chapter", "shelf"), "page_id")
    chunks = documents.chunk_pages(rows.select("page_id", "html", "page"), name_col="page").join(rows.select("page_id", text.context_prefix(F.col("shelf"), F.col("book"), F.col("chapter"), F.col("page")).alias("prefix")), "page_id")
    chunks = chunks.withColumn("e", models.try_embed(F.concat("prefix", "content"), dims, make)).select("page_id", "chunk_index", "heading_path", "content", "content_hash", "e.embedding", "e.error")
    links = raw.select("page_id", F.explode(text.extract_links(F.col("html"))).alias("path"))
    return Ingested(rows.select("page_id", text.content_hash(F.col("html")).alias("content_hash")), chunks, resolve_links(links, pages))


def in_scope(scope: str) -> Column:
    """Pages of an embedding job's scope."""
    if scope == "all":
        return F.lit(True)
    kind, _, number = scope.partition(":")
    if kind not in ("book", "page") or not number.isdigit():
        raise ValueError(f"unknown scope {scope}")
    return F.col(f"{kind}_id") == int(number)


def attempt(raw: DataFrame, books: DataFrame, chapters: DataFrame, shelves: DataFrame, pages: DataFrame, dims: int, make=models.hashing_embedder) -> tuple[Ingested, DataFrame]:
    """As ``ingest``, but a page that fails leaves the others alone: the new rows of the pages that went well, and (page_id, error) of all, error being null for these.

    A page of the listing that the index doesn't know fails too."""
    done = ingest(raw, books, chapters, shelves, pages, dims, make)
    chunks = settled(done.chunks)
    bad = chunks.groupBy("page_id").agg(F.min("error").alias("error"))
    results = raw.select("page_id").join(done.pages.select("page_id", F.lit(True).alias("_known")), "page_id", "left").join(bad, "page_id", "left")
    results = settled(results.select("page_id", F.when(F.col("_known").isNull(), "page not in the index").otherwise(F.col("error")).alias("error")))
    good = results.filter("error IS NULL").select("page_id")
    links = done.links.join(good.withColumnRenamed("page_id", "source_page_id"), "source_page_id", "left_semi")
    return Ingested(done.pages.join(good, "page_id", "left_semi"), chunks.drop("error").join(good, "page_id", "left_semi"), links), results


def aborted_after(results: DataFrame, most: int = MAX_FAILURES) -> int | None:
    """The page_id, in order, at which ``most`` pages in a row have failed; None if that never happened. Runs are found by numbering, not by a walk."""
    results = settled(results.select("page_id", "error"))
    if results.filter("error IS NOT NULL").limit(most).count() < most:
        return None
    rows = settled(numbered(results, "page_id"))
    bad = numbered(rows.filter("error IS NOT NULL").select("page_id", F.col("pos").alias("at")), "page_id")
    runs = bad.withColumn("run", F.col("at") - F.col("pos")).groupBy("run").agg(F.count("*").alias("n"), F.min("at").alias("first")).filter(F.col("n") >= most)
    first = runs.agg(F.min("first")).first()[0]
    return None if first is None else rows.filter(F.col("pos") == first + most - 1).first().page_id


def outcome(results: DataFrame, most: int = MAX_FAILURES) -> DataFrame:
    """(done, failures, aborted, status) of a job over (page_id, error): pages after ``most`` failures in a row are not done; it fails if that happened or with so many failures in all."""
    last = aborted_after(results, most)
    rows = results if last is None else results.filter(F.col("page_id") <= last)
    n = F.count("error")
    return rows.agg(F.count("*").alias("done"), n.alias("failures"), F.lit(last is not None).alias("aborted"), F.when((n >= most) | F.lit(last is not None), "failed").otherwise("succeeded").alias("status"))


class Embedded(NamedTuple):
    """What a job did: new rows of the pages that went well, (page_id, error) of the pages it got to, whether it was aborted or stopped, and how it ended."""

    done: Ingested
    results: DataFrame
    aborted: bool
    stopped: bool
    status: str


WINDOW = 1_000


def embed_job(raw: DataFrame, books: DataFrame, chapters: DataFrame, shelves: DataFrame, pages: DataFrame, dims: int, make=models.hashing_embedder, window: int = WINDOW, most: int = MAX_FAILURES, should_stop: Callable[[], bool] | None = None) -> Embedded:
    """An embedding job over raw pages in windows by id: the first of ``window`` pages, each later one of as many as all before it, so that their number hardly grows with the job and an
    abort or a stop comes after at most as much again as was done. After ``most`` failures in a row, counted across windows, or when ``should_stop`` says so, no further window is begun,
    and what comes after the failures is not among the results. Each window's rows are written before the next is begun.

    Raw pages are dealt into a folder a window first, so a window reads its own alone."""
    spark = raw.sparkSession
    before = F.expr(f"(pos - 1) div {int(window)}")
    rows = numbered(settled(raw.select("page_id")), "page_id").withColumn("_window", F.when(before == 0, 0).otherwise(F.length(F.bin(before))))
    rows = settled(rows.groupBy("page_id").agg(F.min("_window").alias("_window")))
    windows = rows.agg(F.max("_window")).first()[0]
    folder = scratch(spark, "raw-pages")
    raw.join(rows, "page_id").select(*raw.columns, "_window").write.partitionBy("_window").parquet(folder)
    by_window = spark.read.schema(StructType([*raw.schema.fields]).add("_window", "integer")).parquet(folder)
    kept: list[Ingested] = []
    tail = results = spark.createDataFrame([], "page_id long, error string")
    aborted = stopped = False
    for n in range(0 if windows is None else windows + 1):
        if should_stop is not None and should_stop():
            stopped = True
            break
        done, found = attempt(by_window.filter(F.col("_window") == n).drop("_window"), books, chapters, shelves, pages, dims, make)
        last = aborted_after(tail.unionByName(found), most)  # a row of failures may have begun before
        if last is not None:
            found = settled(found.filter(F.col("page_id") <= last))
            good = found.filter("error IS NULL").select("page_id")
            done = Ingested(done.pages.join(good, "page_id", "left_semi"), done.chunks.join(good, "page_id", "left_semi"), done.links.join(good.withColumnRenamed("page_id", "source_page_id"), "source_page_id", "left_semi"))
        kept.append(Ingested(*[settled(x) for x in done]))
        results = results.unionByName(found)
        if last is not None:
            aborted = True
            break
        tail = held(tail.unionByName(found).orderBy(F.desc("page_id")).limit(most))
    whole = kept[0] if kept else Ingested(*[settled(x) for x in attempt(raw.limit(0), books, chapters, shelves, pages, dims, make)[0]])
    for more in kept[1:]:
        whole = Ingested(*[a.unionByName(b) for a, b in zip(whole, more, strict=True)])
    failures = results.filter("error IS NOT NULL").limit(most).count()
    return Embedded(whole, results, aborted, stopped, "failed" if aborted or failures >= most else "cancelled" if stopped else "succeeded")


def retries_of(job: Embedded, jobs: DataFrame) -> DataFrame:
    """(scope, id, is_new) of the jobs for the pages that failed in a job that succeeded as a whole; a page that has one already gets no other."""
    failed = job.results.filter("error IS NOT NULL").select(F.concat(F.lit("page:"), F.col("page_id")).alias("scope"))
    return queue.create_dedup(jobs, failed if job.status == "succeeded" else failed.limit(0))


def retry_scopes(results: DataFrame, most: int = MAX_FAILURES) -> DataFrame:
    """(scope) of the jobs that try failed pages again: none where the job as a whole failed."""
    whole = outcome(results, most).select(F.col("status").alias("_status"))
    return results.filter("error IS NOT NULL").join(F.broadcast(whole)).filter("_status = 'succeeded'").select(F.concat(F.lit("page:"), F.col("page_id")).alias("scope"))


class Listing(NamedTuple):
    """What is there upstream: shelves, (book_id, shelf_id, ord) of books on shelves, books, chapters, pages, each with name and slug."""

    shelves: DataFrame
    shelf_books: DataFrame
    books: DataFrame
    chapters: DataFrame
    pages: DataFrame


class Index(NamedTuple):
    """The structural index: (shelf_id, name, slug, shelf_kind), (book_id, name, slug, shelf_id, book_kind), (chapter_id, book_id, name, slug, chapter_kind, archive_year),
    (page_id, book_id, chapter_id, name, slug, page_kind, page_key, archive_year), each with ``deleted``."""

    shelves: DataFrame
    books: DataFrame
    chapters: DataFrame
    pages: DataFrame


KEYS = Index("shelf_id", "book_id", "chapter_id", "page_id")


def classified(listing: Listing, shelf_of=tables.last_shelf) -> Index:
    """The index of a whole listing: books through their shelves, a book on many shelves under the last, then those on none; chapters and pages through their books.

    Four levels are joined, each with the kind of the one above; nothing is walked entry by entry."""
    live = F.lit(False).alias("deleted")
    shelves = listing.shelves.select("shelf_id", "name", "slug", text.classify_shelf(F.col("shelf_id")).alias("shelf_kind"), live)
    books = listing.books.select("book_id", "name", "slug").join(shelf_of(listing.shelf_books), "book_id", "left").join(shelves.select("shelf_id", "shelf_kind"), "shelf_id", "left")
    books = books.dropDuplicates(["book_id"]).select("book_id", "name", "slug", "shelf_id", text.classify_book(F.col("name"), F.coalesce("shelf_kind", F.lit("unclassified"))).alias("book_kind"), live)
    chapters = listing.chapters.join(books.select("book_id", "book_kind"), "book_id").select("chapter_id", "book_id", "name", "slug", text.classify_chapter(F.col("name"), F.col("book_kind")).alias("c"))
    chapters = chapters.select("chapter_id", "book_id", "name", "slug", F.col("c.kind").alias("chapter_kind"), F.col("c.archive_year").alias("archive_year"), live)
    of = chapters.select("chapter_id", "chapter_kind", F.col("archive_year").alias("chapter_year"))
    pages = listing.pages.join(books.select("book_id", "book_kind"), "book_id").join(of, "chapter_id", "left")
    pages = pages.select("page_id", "book_id", "chapter_id", "name", "slug", text.classify_page(F.col("name"), F.col("book_kind"), F.col("chapter_kind"), F.col("chapter_year")).alias("p"))
    return Index(shelves, books, chapters, pages.select("page_id", "book_id", "chapter_id", "name", "slug", F.col("p.kind").alias("page_kind"), F.col("p.key").alias("page_key"), F.col("p.archive_year").alias("archive_year"), live))


def full_walk(listing: Listing, index: Index | None = None, tombstones: bool = False) -> Index:
    """The index after a walk over everything. Entries of the old index that are not listed any more stay as they are, or are marked as deleted with ``tombstones``."""
    new = classified(listing)
    if index is None:
        return new
    out = []
    for old, rows, key in zip(index, new, KEYS, strict=True):
        gone = old.join(rows.select(key), key, "left_anti")
        out.append(rows.unionByName((gone.withColumn("deleted", F.lit(True)) if tombstones else gone).select(*rows.columns)))
    return Index(*out)


def wanted_of(scopes: DataFrame) -> list[DataFrame]:
    """For shelves, books, chapters and pages the ids that the scopes (``page:1``, ``chapter:2`` and so on) name."""
    return [settled(scopes.select(text.scope_id(F.col("scope"), key.removesuffix("_id")).alias(key)).filter(F.col(key).isNotNull()).distinct()) for key in KEYS]


def listed(listing: Listing, wanted: list[DataFrame]) -> Listing:
    """The part of a listing that these entries take: they, and the chapters and books that classify them."""
    of_shelf, of_book, of_chapter, of_page = wanted
    pages = settled(listing.pages.join(of_page, "page_id", "left_semi"))
    chapters = settled(listing.chapters.join(of_chapter.unionByName(pages.filter("chapter_id IS NOT NULL").select("chapter_id")).distinct(), "chapter_id", "left_semi"))
    ids = of_book.unionByName(chapters.select("book_id")).unionByName(pages.select("book_id")).distinct()
    books = settled(listing.books.join(ids, "book_id", "left_semi"))
    on = settled(listing.shelf_books.join(books.select("book_id"), "book_id", "left_semi"))
    shelves = listing.shelves.join(of_shelf.unionByName(on.select("shelf_id")).distinct(), "shelf_id", "left_semi")
    return Listing(shelves, on, books, chapters, pages)


def reconcile_some(scopes: DataFrame, listing: Listing, index: Index) -> tuple[Index, DataFrame]:
    """The index after the entries of these scopes were looked up again, and the jobs (scope) it takes first: a chapter or page whose book, or a book whose shelf, the index lacks is not
    taken in, its parent's job comes instead. A book is on the first shelf that has it; what is not listed is left alone, and only what the scopes need is read of the listing and classified."""
    wanted = wanted_of(scopes)
    new, out, jobs = classified(listed(listing, wanted), tables.first_shelf), [], []
    for old, rows, key, ids in zip(index, new, KEYS, wanted, strict=True):
        rows = settled(rows.join(ids, key, "left_semi").select(*rows.columns))
        if key == "book_id":
            jobs.append(missing_shelves(rows, index.shelves))
            rows = rows.join(index.shelves.select("shelf_id").withColumn("_there", F.lit(True)), "shelf_id", "left").filter("shelf_id IS NULL OR _there").select(*rows.columns)
        if key in ("chapter_id", "page_id"):
            jobs.append(missing_parents(rows, index.books, None))
            rows = rows.join(index.books.select("book_id"), "book_id", "left_semi").select(*rows.columns)
        out.append(tables.upsert(old.select(*rows.columns), rows, [key]))
    return Index(*out), jobs[0].unionByName(jobs[1]).unionByName(jobs[2]).distinct()


def missing_shelves(books: DataFrame, shelves: DataFrame) -> DataFrame:
    """(scope): the jobs for shelves of these books that the index doesn't have."""
    return books.filter("shelf_id IS NOT NULL").join(shelves.select("shelf_id"), "shelf_id", "left_anti").select(F.concat(F.lit("shelf:"), F.col("shelf_id")).alias("scope"))


def orphans(books: DataFrame, walked: DataFrame) -> DataFrame:
    return books.join(walked.select("book_id"), "book_id", "left_anti").dropDuplicates(["book_id"])


def missing_parents(pages: DataFrame, books: DataFrame, key: str | None = "page_id") -> DataFrame:
    """(key, scope): pages whose book the index doesn't have, and the job that brings it; a book marked as deleted counts as there."""
    scope = F.concat(F.lit("book:"), F.col("book_id")).alias("scope")
    return pages.join(books.select("book_id"), "book_id", "left_anti").select(*([key] if key else []), scope)


def parse_book_contents(json: Column) -> Column:
    """(page_id, name, chapter_id) of a book's contents: pages at its root and in its chapters; other types are skipped."""
    page = "struct<type: string, id: bigint, name: string, pages: array<struct<id: bigint, name: string>>>"
    items = F.coalesce(F.from_json(json, f"array<{page}>"), F.array().cast(f"array<{page}>"))
    one = lambda i, n, c: F.struct(i.alias("page_id"), n.alias("name"), c.cast("bigint").alias("chapter_id"))
    root = F.transform(F.filter(items, lambda x: x["type"] == "page"), lambda x: one(x["id"], x["name"], F.lit(None)))
    inner = F.flatten(F.transform(F.filter(items, lambda x: x["type"] == "chapter"), lambda x: F.transform(F.coalesce(x["pages"], F.array().cast("array<struct<id: bigint, name: string>>")), lambda p: one(p["id"], p["name"], x["id"]))))
    return F.concat(root, inner)
