"""The link graph: neighbours of pages, for all pages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import held, settled, spread

LINKS, CO_LINKS, SIBLINGS = 20, 10, 20
#: Pages of a search pool, whose ids become constants of the plan.
MAX_POOL = 1_000


def _first(rows: DataFrame, n: int, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def linked_from(edges: DataFrame, pages: DataFrame, n: int = LINKS) -> DataFrame:
    """(page_id, neighbour_id, link_type): pages that link to it."""
    rows = edges.select(F.col("target_page_id").alias("page_id"), F.col("source_page_id").alias("neighbour_id"), "link_type")
    return _first(rows.join(pages.select(F.col("page_id").alias("neighbour_id")), "neighbour_id", "left_semi"), n, "neighbour_id", "link_type").select("page_id", "neighbour_id", "link_type")


def links_to(edges: DataFrame, pages: DataFrame, n: int = LINKS) -> DataFrame:
    """(page_id, neighbour_id, link_type): pages that it links to."""
    rows = edges.select(F.col("source_page_id").alias("page_id"), F.col("target_page_id").alias("neighbour_id"), "link_type")
    return _first(rows.join(pages.select(F.col("page_id").alias("neighbour_id")), "neighbour_id", "left_semi"), n, "neighbour_id", "link_type").select("page_id", "neighbour_id", "link_type")


def co_linked(edges: DataFrame, pages: DataFrame, wanted: DataFrame | None = None, n: int = CO_LINKS) -> DataFrame:
    """(page_id, neighbour_id): other pages that link to a page it links to. ``wanted`` (page_id) keeps the join to the pages asked for."""
    own = edges.select(F.col("source_page_id").alias("page_id"), "target_page_id").distinct()
    there = own.join(pages.select("page_id"), "page_id", "left_semi")
    return _co_linked(own if wanted is None else own.join(wanted.select("page_id"), "page_id", "left_semi"), there, n, edges.count())


def _co_linked(own: DataFrame, there: DataFrame, n: int = CO_LINKS, many: int | None = None) -> DataFrame:
    """Of the pages that link to a target, the first n + 1 are enough for each of them, so a popular target is joined with these and not with itself.

    ``many`` links, more than those of a search pool, are dealt by page as lists, before these become n + 1 rows each: no task holds the pairs of more links than it is given."""
    rank = F.row_number().over(Window.partitionBy("target_page_id").orderBy("page_id"))
    first = there.withColumn("_r", rank).filter(F.col("_r") <= n + 1).groupBy("target_page_id").agg(F.collect_list("page_id").alias("near"))
    rows = own.join(first, "target_page_id").select("page_id", "near")
    rows = (rows if many is None else spread(rows, many, "page_id")).select("page_id", F.explode("near").alias("neighbour_id"))
    return _first(rows.filter("page_id <> neighbour_id").distinct(), n, "neighbour_id")


def siblings(pages: DataFrame, wanted: DataFrame | None = None, n: int = SIBLINGS) -> DataFrame:
    """(page_id, neighbour_id): pages of its chapter, or, without a chapter or alone in it, of its book. Deleted pages are no one's siblings.

    A window over each chapter or book lists its first n + 1 pages, which are enough for every page in it, so nothing is joined pairwise.
    """
    asked = (pages if wanted is None else pages.join(wanted.select("page_id"), "page_id", "left_semi")).select("page_id", "chapter_id", "book_id")
    return _siblings(spread(asked, pages.count(), "page_id"), pages, n)


def _siblings(asked: DataFrame, pages: DataFrame, n: int = SIBLINGS) -> DataFrame:
    all_live = pages.filter(~F.col("deleted"))

    def lists(group: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(group).orderBy("page_id"))
        first = all_live.filter(F.col(group).isNotNull()).select(group, "page_id").withColumn("_r", rank).filter(F.col("_r") <= n + 1)
        return first.groupBy(group).agg(F.array_sort(F.collect_list("page_id")).alias(f"in_{group}"))

    near = asked.join(lists("chapter_id"), "chapter_id", "left").join(lists("book_id"), "book_id", "left")
    others = lambda c: F.slice(F.filter(F.coalesce(F.col(c), F.array().cast("array<bigint>")), lambda x: x != F.col("page_id")), 1, n)
    found = F.when(F.size(others("in_chapter_id")) > 0, others("in_chapter_id")).otherwise(others("in_book_id"))
    return near.select("page_id", F.explode(found).alias("neighbour_id"))


def blanket(edges: DataFrame, pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(page_id, relation, neighbour_id): all four kinds of neighbours, with repetitions. The few pages of a search pool, ``wanted``, are asked for by their ids."""
    if wanted is not None:
        ids = [r.page_id for r in wanted.select("page_id").distinct().limit(MAX_POOL + 1).collect()]
        if len(ids) <= MAX_POOL:
            return blanket_of_pool(edges, pages, ids)
    return blanket_of_many(edges, pages, wanted)


def blanket_of_many(edges: DataFrame, pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The blanket of all pages, or of more of them (page_id) than a search pool has: joins, and no list of ids."""
    known = pages.select("page_id", F.lit(True).alias("is_page"))
    ends = edges.join(known.withColumnsRenamed({"page_id": "source_page_id", "is_page": "source_is_page"}), "source_page_id", "left")
    ends = settled(ends.join(known.withColumnsRenamed({"page_id": "target_page_id", "is_page": "target_is_page"}), "target_page_id", "left"))
    to, of, there = ends.filter("source_is_page"), ends.filter("target_is_page"), ends.filter("source_is_page")
    own = ends
    if wanted is not None:
        some = settled(wanted.select("page_id").distinct())
        to, of, own = (x.join(some.withColumnRenamed("page_id", c), c, "left_semi") for x, c in ((to, "target_page_id"), (of, "source_page_id"), (ends, "source_page_id")))
    return _relations(to, of, own, there, siblings(pages, wanted), ends.count())


def _relations(to: DataFrame, of: DataFrame, own: DataFrame, there: DataFrame, near: DataFrame, many: int | None = None) -> DataFrame:
    """From the edges to the pages asked for, those from them, these again for what they share, and the edges that these may share with; edges' other ends are pages."""
    kinds = {
        "linked_from": _first(to.select(F.col("target_page_id").alias("page_id"), F.col("source_page_id").alias("neighbour_id"), "link_type"), LINKS, "neighbour_id", "link_type"),
        "links_to": _first(of.select(F.col("source_page_id").alias("page_id"), F.col("target_page_id").alias("neighbour_id"), "link_type"), LINKS, "neighbour_id", "link_type"),
        "co_linked": _co_linked(own.select(F.col("source_page_id").alias("page_id"), "target_page_id").distinct(), there.select(F.col("source_page_id").alias("page_id"), "target_page_id").distinct(), many=many),
        "sibling": near,
    }
    out = None
    for name, rows in kinds.items():
        rows = rows.select("page_id", F.lit(name).alias("relation"), "neighbour_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def blanket_of_pool(edges: DataFrame, pages: DataFrame, ids: list[int]) -> DataFrame:
    """The blanket of a few pages: their ids are filters of the scans, so that windows see only edges that touch them, or share a target with them, and pages of their chapters and books."""
    ends = held(edges.filter(F.col("source_page_id").isin(ids) | F.col("target_page_id").isin(ids)))
    return blanket_of_edges(ends.filter(F.col("source_page_id").isin(ids)), ends.filter(F.col("target_page_id").isin(ids)), edges, pages, ids)


def blanket_of_edges(outgoing: DataFrame, incoming: DataFrame, edges: DataFrame, pages: DataFrame, ids: list[int]) -> DataFrame:
    """The same, with the edges from and to these pages; ``edges`` has at least all edges to what they link to."""
    others = held(edges.join(outgoing.select("target_page_id").distinct(), "target_page_id", "left_semi").select("source_page_id", "target_page_id").distinct())
    met = incoming.select(F.col("source_page_id").alias("page_id")).unionAll(outgoing.select("target_page_id")).unionAll(others.select("source_page_id")).distinct()
    known = held(pages.join(met, "page_id", "left_semi").select("page_id"))
    to = incoming.join(known.withColumnRenamed("page_id", "source_page_id"), "source_page_id", "left_semi")
    of = outgoing.join(known.withColumnRenamed("page_id", "target_page_id"), "target_page_id", "left_semi")
    there = others.join(known.withColumnRenamed("page_id", "source_page_id"), "source_page_id", "left_semi")
    rows = pages.filter(F.col("page_id").isin(ids)).select("page_id", "chapter_id", "book_id").collect()
    asked = pages.sparkSession.createDataFrame(rows, pages.select("page_id", "chapter_id", "book_id").schema)
    around = pages.filter(F.col("chapter_id").isin(list({r.chapter_id for r in rows} - {None})) | F.col("book_id").isin(list({r.book_id for r in rows} - {None})))
    return _relations(to, of, outgoing, there, _siblings(asked, around))


def times_named(neighbours: DataFrame, pages: int) -> DataFrame:
    """(page_id, neighbour_id, n): how often each neighbour is named, of the blankets of so many pages. Pages are dealt first, so that no task counts the neighbours of more than its own."""
    return spread(neighbours.select("page_id", "neighbour_id"), pages * (2 * LINKS + CO_LINKS + SIBLINGS) // 10, "page_id").groupBy("page_id", "neighbour_id").agg(F.count("*").alias("n"))


def strong_weak(neighbours: DataFrame, scored: DataFrame, hits: DataFrame) -> DataFrame:
    """(page_id, strong, weak): neighbours that are scored pages, and those that are only among the raw hits."""
    known = scored.select(F.col("page_id").alias("neighbour_id"), F.lit(True).alias("is_scored")).unionByName(hits.select(F.col("page_id").alias("neighbour_id"), F.lit(False).alias("is_scored")))
    known = known.groupBy("neighbour_id").agg(F.max("is_scored").alias("is_scored"))
    rows = neighbours.join(known, "neighbour_id")
    return rows.groupBy("page_id").agg(F.sum(F.col("is_scored").cast("long")).alias("strong"), F.sum((~F.col("is_scored")).cast("long")).alias("weak"))
