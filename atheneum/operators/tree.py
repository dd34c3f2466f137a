"""The directory tree: four levels as rows, each with its parent and the containers above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

SCOPES = ("shelf", "book", "chapter")
UNSHELVED = (0, "Unshelved")


def parse_scope(arguments: dict | None) -> tuple[str, int | None]:
    """("all", None) or the one scope named; more than one is an error."""
    given = [(k, v) for k in SCOPES if (v := (arguments or {}).get(k)) is not None]
    if len(given) > 1:
        raise ValueError("name one of shelf, book and chapter")
    if not given:
        return "all", None
    kind, value = given[0]
    try:
        return kind, int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{kind} must be an id, not {value!r}") from None


NODE = ["kind", "id", "parent_kind", "parent_id", "depth", "name", "in_shelf", "in_book", "in_chapter"]


def nodes(shelves: DataFrame, books: DataFrame, chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """All live nodes with their parent and, as ``in_<kind>``, the containers they are reached through (null beyond one that is deleted).

    Books without a shelf hang under a made-up shelf, which is there only if one does. Four levels are three joins, so nothing recurses.
    """
    none = F.lit(None).cast("long")
    made = F.lit(UNSHELVED[0]).cast("long")
    live_shelves = shelves.filter("NOT deleted").select(F.col("shelf_id").alias("s"))
    b = books.filter("NOT deleted").join(live_shelves, F.col("shelf_id") == F.col("s"), "left")
    b = b.select("book_id", "name", F.coalesce("shelf_id", made).alias("parent"), F.when(F.col("shelf_id").isNull(), made).otherwise(F.col("s")).alias("in_shelf"))
    of_book = b.select(F.col("book_id").alias("b"), F.col("in_shelf").alias("b_shelf"))
    c = chapters.filter("NOT deleted").join(of_book, F.col("book_id") == F.col("b"), "left").select("chapter_id", "name", "book_id", F.col("b").alias("in_book"), F.col("b_shelf").alias("in_shelf"))
    of_chapter = c.select(F.col("chapter_id").alias("c"), F.col("in_book").alias("c_book"), F.col("in_shelf").alias("c_shelf"))
    p = pages.filter("NOT deleted").join(of_chapter, F.col("chapter_id") == F.col("c"), "left").join(of_book, F.col("chapter_id").isNull() & (F.col("book_id") == F.col("b")), "left")

    def row(df: DataFrame, kind: str, id: str, parent_kind, parent, depth, in_shelf, in_book=none, in_chapter=none) -> DataFrame:
        values = (F.lit(kind), F.col(id), parent_kind, parent, depth, F.col("name"), in_shelf, in_book, in_chapter)
        return df.select(*[v.alias(n) for v, n in zip(values, NODE, strict=True)])

    roots = shelves.filter("NOT deleted").select("shelf_id", "name").unionByName(books.filter("NOT deleted AND shelf_id IS NULL").select(made.alias("shelf_id"), F.lit(UNSHELVED[1]).alias("name")).distinct())
    root_page = F.col("chapter_id").isNull()
    out = row(roots, "shelf", "shelf_id", F.lit(None).cast("string"), none, F.lit(0), none)
    out = out.unionByName(row(b, "book", "book_id", F.lit("shelf"), F.col("parent"), F.lit(1), F.col("in_shelf")))
    out = out.unionByName(row(c, "chapter", "chapter_id", F.lit("book"), F.col("book_id"), F.lit(2), F.col("in_shelf"), F.col("in_book")))
    return out.unionByName(row(p, "page", "page_id", F.when(root_page, "book").otherwise("chapter"), F.coalesce("chapter_id", "book_id"), F.when(root_page, 2).otherwise(3), F.coalesce("c_shelf", "b_shelf"), F.coalesce("c_book", "b"), F.col("c")))


def below(shelves: DataFrame, books: DataFrame, chapters: DataFrame, pages: DataFrame, kind: str, id: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables cut down to what lies at, under or above one node, so that the filter reaches the scans of chapters and pages; ``nodes`` of them has the same subtree."""
    if kind == "shelf":
        own = F.col("shelf_id") == id
        books = books.filter(own | F.col("shelf_id").isNull() if id == UNSHELVED[0] else own)
        ids = books.select("book_id")
        return shelves, books, chapters.join(ids, "book_id", "left_semi"), pages.join(ids, "book_id", "left_semi")
    if kind == "book":
        return shelves, *[df.filter(F.col("book_id") == id) for df in (books, chapters, pages)]
    chapters = chapters.filter(F.col("chapter_id") == id)
    return shelves, books.join(chapters.select("book_id"), "book_id", "left_semi"), chapters, pages.filter(F.col("chapter_id") == id)


def directory(all_nodes: DataFrame, kind: str = "all", id: int | None = None, depth: int | None = None) -> DataFrame:
    """The nodes at or under the root(s), with ``level`` from 0, at most ``depth`` levels below: one filter on the containers."""
    if kind == "all":
        found = all_nodes.filter("kind = 'shelf' OR in_shelf IS NOT NULL").withColumn("level", F.col("depth"))
    else:
        root = (F.col("kind") == kind) & (F.col("id") == id)
        if all_nodes.filter(root).isEmpty():
            raise LookupError(f"{kind} {id} not found")
        found = all_nodes.filter(root | (F.col(f"in_{kind}") == id)).withColumn("level", F.col("depth") - SCOPES.index(kind))
    return found if depth is None else found.filter(F.col("level") <= depth)


def pages_of(tree: DataFrame) -> DataFrame:
    return tree.filter("kind = 'page'").select(F.col("id").alias("page_id"))


def prune(tree: DataFrame, allowed: DataFrame) -> DataFrame:
    """Without pages that are not allowed (page_id) and containers that this empties; containers that had no children stay."""
    had = tree.filter("parent_kind IS NOT NULL").select(F.col("parent_kind").alias("kind"), F.col("parent_id").alias("id")).distinct()
    pages = tree.filter("kind = 'page'").join(allowed.select(F.col("page_id").alias("id")), "id", "left_semi").select(*tree.columns)
    out, below = pages, [pages]
    for kind in ("chapter", "book", "shelf"):
        filled = [x.filter(F.col("parent_kind") == kind).select(F.col("parent_id").alias("id"), F.lit(True).alias("filled")) for x in below]
        marks = filled[0] if len(filled) == 1 else filled[0].unionByName(filled[1])
        level = tree.filter(F.col("kind") == kind).join(marks.distinct(), "id", "left").join(had.withColumn("had", F.lit(True)), ["kind", "id"], "left")
        kept = level.filter("filled OR had IS NULL").select(*tree.columns)
        out = out.unionByName(kept)
        below = [pages, kept] if kind == "chapter" else [kept]
    return out


def to_json(tree: DataFrame) -> DataFrame:
    """(id, tree) of each root: nested JSON, children by name, a book's chapters before its own pages; containers always have children, pages never."""
    plain = F.to_json(F.struct("kind", "id", "name"))

    def filled(kind: str, below: DataFrame) -> DataFrame:
        order = F.struct(F.when(F.col("kind") == "page", 1).otherwise(0).alias("o"), F.col("name"), F.col("id"), F.col("json"))
        of = below.filter(F.col("parent_kind") == kind).groupBy(F.col("parent_id").alias("of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["json"]), ",").alias("children"))
        whole = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        return tree.filter(F.col("kind") == kind).join(of, F.col("id") == F.col("of"), "left").withColumn("json", whole).drop("of", "children")

    pages = tree.filter("kind = 'page'").withColumn("json", plain)
    chapters = filled("chapter", pages)
    books = filled("book", chapters.unionByName(pages))
    shelves = filled("shelf", books)
    roots = chapters.unionByName(books).unionByName(shelves).filter("level = 0")
    return roots.select("id", F.col("json").alias("tree"))


def outline(shelves: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(shelf_id, outline): a shelf, its books and their chapters as indented lines with ids, and descriptions (a column of that name, which may be lacking), and an empty line at the end."""

    def line(df: DataFrame, kind: str, key: str, indent: str) -> Column:
        said = text.truncate_description(F.coalesce("description", F.lit(""))) if "description" in df.columns else F.lit("")
        return F.concat(F.lit(f"{indent}{kind}: "), F.col("name"), F.lit(" (ID: "), F.col(key).cast("string"), F.lit(")"), F.when(said != "", F.concat(F.lit(" — "), said)).otherwise(""), F.lit("\n"))

    def under(df: DataFrame, parent: str, key: str, lines: Column) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("name", key, lines.alias("lines"))))
        return df.groupBy(parent).agg(F.array_join(F.transform(parts, lambda s: s["lines"]), "").alias("inner"))

    live_chapters, live_books = chapters.filter("NOT deleted"), books.filter("NOT deleted AND shelf_id IS NOT NULL")
    c = under(live_chapters, "book_id", "chapter_id", line(live_chapters, "Chapter", "chapter_id", "    "))
    b = under(live_books.join(c, "book_id", "left"), "shelf_id", "book_id", F.concat(line(live_books, "Book", "book_id", "  "), F.coalesce("inner", F.lit(""))))
    return shelves.filter("NOT deleted").join(b, "shelf_id", "left").select("shelf_id", F.concat(line(shelves, "Shelf", "shelf_id", ""), F.coalesce("inner", F.lit("")), F.lit("\n")).alias("outline"))
