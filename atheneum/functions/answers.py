"""What a client is told after a change, and lists of search results, as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

PREVIEW, NO_RESULTS = 200, "No results found."


def _or(value: Column | None, default: str) -> Column:
    return F.lit(default) if value is None else F.coalesce(value.cast("string"), F.lit(default))


def _line(label: str, value: Column) -> Column:
    """A line of its own, left out where the value is empty."""
    return F.when(value != "", F.concat(F.lit(f"\n{label}: "), value)).otherwise("")


def _under_book(base_url: str, book_slug: Column, kind: str, slug: Column) -> Column:
    """The address below a book; empty unless both slugs are known."""
    return F.when((book_slug != "") & (slug != ""), F.concat(F.lit(f"{base_url}/books/"), book_slug, F.lit(f"/{kind}/"), slug)).otherwise("")


def page_success(action: str, base_url: str, id: Column, book_id: Column, name: Column, slug: Column, editor: Column | None = None, revision: Column | None = None, url: Column | None = None, book_slug: Column | None = None) -> Column:
    """For a page that was made or changed. ``url`` is the path the server gave, if any; else the address follows from the slugs."""
    path = _or(url, "")
    address = F.when(path != "", text.join_base_url(F.lit(base_url), path)).otherwise(_under_book(base_url, _or(book_slug, ""), "page", _or(slug, "")))
    return F.concat(
        F.lit(f"{action}\nPage ID: "), _or(id, "0"), F.lit("\nBook ID: "), _or(book_id, "0"), F.lit("\nName: "), _or(name, ""), F.lit("\nEditor: "), _or(editor, "unknown"),
        F.lit("\nSlug: "), _or(slug, ""), F.lit("\nRevision: "), _or(revision, "0"), _line("URL", address), F.lit("\nUse get_page("), _or(id, "0"), F.lit(") to verify content if needed."),
    )


def shelf_success(action: str, base_url: str, id: Column, name: Column, slug: Column, description: Column | None = None) -> Column:
    return F.concat(F.lit(f"{action}\nShelf ID: "), _or(id, "0"), F.lit("\nName: "), _or(name, ""), F.lit("\nSlug: "), _or(slug, ""), _line("Description", _or(description, "")), F.lit(f"\nURL: {base_url}/shelves/"), _or(slug, ""))


def book_success(action: str, base_url: str, id: Column, name: Column, slug: Column, description: Column | None = None) -> Column:
    return F.concat(F.lit(f"{action}\nBook ID: "), _or(id, "0"), F.lit("\nName: "), _or(name, ""), F.lit("\nSlug: "), _or(slug, ""), _line("Description", _or(description, "")), F.lit(f"\nURL: {base_url}/books/"), _or(slug, ""))


def chapter_success(action: str, base_url: str, id: Column, book_id: Column, name: Column, slug: Column, description: Column | None = None, book_slug: Column | None = None) -> Column:
    return F.concat(
        F.lit(f"{action}\nChapter ID: "), _or(id, "0"), F.lit("\nBook ID: "), _or(book_id, "0"), F.lit("\nName: "), _or(name, ""), F.lit("\nSlug: "), _or(slug, ""),
        _line("Description", _or(description, "")), _line("URL", _under_book(base_url, _or(book_slug, ""), "chapter", _or(slug, ""))),
    )


def result_lines(base_url: str, type: Column, name: Column, id: Column, url: Column, preview: Column) -> Column:
    """One search result: its type, name, id and address, the first characters of its preview without tags, and an empty line."""
    address = F.when(_or(url, "") != "", F.concat(F.lit(" — "), text.join_base_url(F.lit(base_url), url))).otherwise("")
    head = F.concat(F.lit("- ["), _or(type, "unknown"), F.lit("] "), _or(name, ""), F.lit(" (id: "), _or(id, "0"), F.lit(")"), address)
    shown = F.when(_or(preview, "") != "", F.concat(F.lit("\n  Preview: "), F.substring(text.strip_tags(_or(preview, "")), 1, PREVIEW))).otherwise("")
    return F.concat(head, shown, F.lit("\n"))


def search_texts(requests: DataFrame, results: DataFrame, base_url: str, request: str = "request", total: str | None = None) -> DataFrame:
    """(request, shown) for each of ``requests``: its results (request, pos, type, name, id, url, preview), a page of a search and so a bounded number, under a line with how many there are,
    which is ``total`` of ``requests`` where that is given."""
    line = result_lines(base_url, F.col("type"), F.col("name"), F.col("id"), F.col("url"), F.col("preview"))
    lists = results.select(request, F.struct("pos", line.alias("line")).alias("r")).groupBy(request).agg(F.array_sort(F.collect_list("r")).alias("lines"))
    n = F.col(total) if total else F.size("lines")
    shown = F.concat(F.lit("Found "), n.cast("string"), F.lit(" results:\n\n"), F.array_join(F.transform("lines", lambda r: r["line"]), "\n"))
    return requests.join(lists.hint("merge"), request, "left").select(request, F.coalesce(shown, F.lit(NO_RESULTS)).alias("shown"))
