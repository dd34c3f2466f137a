"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Descriptions that say nothing.
PLACEHOLDERS = ("todo", "tbd", "placeholder", "description", "xxx", "fixme", "n/a")


def normalize_ws(s: Column) -> Column:
    """Each run of white space (Unicode) becomes one: a line break if it begins with one, else a blank."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)(\s)\s*", "$1"), r"(?U)[\s&&[^\n]]", " ")


def strip_tags(s: Column) -> Column:
    """Without tags; what follows an unclosed one goes too, and so do single ``>``."""
    return F.replace(F.regexp_replace(s, "<[^>]*>?", ""), F.lit(">"), F.lit(""))


def ascii_lower(s: Column) -> Column:
    """Letters A-Z in lower case; all others as they are."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trimmed(s: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")


def strip_dup_title(body: Column, name: Column) -> Column:
    """Without a first heading (one ``#``, blank or not, or ``<h1``) that repeats the page's name, letters A-Z in either case, and the line ends after it.

    After a Markdown heading the text's end is trimmed too."""
    start = F.regexp_replace(body, r"(?U)^\s+", "")
    under = trimmed(F.regexp_replace(start, "^#", ""))
    line = F.regexp_extract(under, r"(?s)^([^\n]*?)(?:\r?\n|\z)", 1)
    tag = F.regexp_extract(start, r"(?s)^(<h1.*?</h1>)", 1)
    same = lambda c: ascii_lower(trimmed(c)) == ascii_lower(trimmed(name))
    after = lambda whole, head: F.regexp_replace(whole.substr(F.length(head) + 1, F.length(whole)), r"^\n*\r*", "")
    markdown = start.startswith("#") & ~start.startswith("##") & same(line)
    return F.when(markdown, after(under, line)).when((tag != "") & same(strip_tags(tag)), after(start, tag)).otherwise(body)


def truncate_description(s: Column) -> Column:
    """Tags and white space reduced; up to 150 bytes as they are, else 147 characters and three dots."""
    t = F.trim(F.regexp_replace(strip_tags(s), r"(?U)\s+", " "))
    return F.when(F.octet_length(t) <= 150, t).otherwise(F.concat(F.substring(t, 1, 147), F.lit("...")))


def extract_links(html: Column) -> Column:
    """Paths of links to pages (``/books/…/page/…``) and short links (``/link/…``), hosts cut off."""
    hrefs = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)
    found = F.transform(hrefs, lambda h: F.when(F.locate("/books/", h) > 0, h.substr(F.locate("/books/", h), F.length(h))).when(F.locate("/link/", h) > 0, h.substr(F.locate("/link/", h), F.length(h))))
    return F.filter(found, lambda p: p.isNotNull() & (p.startswith("/link/") | (p.startswith("/books/") & p.contains("/page/"))))


def context_prefix(shelf: Column, book: Column, chapter: Column, page: Column) -> Column:
    """``[Shelf > Book > Chapter > Page]`` and a blank line; empty levels are left out."""
    none = lambda c: F.when(c != "", c)
    return F.concat(F.lit("["), F.concat_ws(" > ", none(shelf), none(book), none(chapter), none(page)), F.lit("]\n\n"))


def content_hash(s: Column) -> Column:
    return F.sha2(s, 256)


def edit_text(body: Column, find: Column, put: Column, replace_all: Column) -> Column:
    """(text, error): ``find`` replaced; an error if it isn't there, or more than once without ``replace_all``."""
    n = (F.length(body) - F.length(F.replace(body, find, F.lit("")))) / F.length(find)
    error = F.when(F.coalesce(F.length(find), F.lit(0)) == 0, "nothing to find").when(n == 0, "text not found").when((n > 1) & ~replace_all, "text found more than once")
    return F.struct(F.when(error.isNull(), F.replace(body, find, put)).alias("text"), error.alias("error"))


def append_text(body: Column, more: Column, editor: Column | None = None, html: Column | None = None) -> Column:
    """``more`` after the body without the white space at its end: a blank line between them in Markdown; where ``editor`` is another, ``html`` on the next line."""
    end = F.regexp_replace(body, r"(?U)\s+\z", "")
    markdown = F.concat(end, F.lit("\n\n"), more)
    return markdown if editor is None else F.when(editor == "markdown", markdown).otherwise(F.concat(end, F.lit("\n"), html))


def lines_of(body: Column) -> Column:
    """Lines without their ends; an end of line at the very end begins no other."""
    parts = F.split(body, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def insert_after_line(body: Column, anchor: Column, more: Column) -> Column:
    """``more`` on a line of its own, which is always ended, after the first line equal to ``anchor``, both trimmed; null if there is none. A last line is not ended."""
    lines = lines_of(body)
    at = F.array_position(F.transform(lines, trimmed), trimmed(anchor))
    rest = F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n")
    return F.when(at > 0, F.concat(F.array_join(F.slice(lines, F.lit(1), at), "\n"), F.lit("\n"), more, F.lit("\n"), rest))


def strip_frontmatter(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)^---\r?\n.*?\n---\r?(?:\n|$)", "")


def frontmatter_field(body: Column, *names: str) -> Column:
    """The first of these fields in a leading ``---`` block, without quotes; null if there is none."""
    block = F.regexp_extract(body, r"(?s)^---\r?\n(.*?)\n---", 1)
    values = [F.regexp_extract(block, rf"(?m)^{n}:[ \t]*[\"']?([^\"'\r\n]*?)[\"']?[ \t\r]*$", 1) for n in names]
    return F.coalesce(*[F.when(v != "", v) for v in values])


def archive_year(name: Column) -> Column:
    """The year of ``Journal Archive - YYYY``, 1900 to 9999."""
    year = F.regexp_extract(trimmed(name), r"^Journal Archive\s*-\s*(\d{4})$", 1).try_cast("int")
    return F.when(year.between(1900, 9999), year)


def iso_date(name: Column) -> Column:
    """A name of the shape YYYY-MM-DD."""
    return F.when(trimmed(name).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), trimmed(name))


def classify_shelf(shelf_id: Column) -> Column:
    return F.lit("unclassified")


def classify_book(name: Column, shelf_kind: Column) -> Column:
    n = trimmed(name)
    hive = F.when(n.endswith(" Identity"), "identity").when(n == "Cross-Identity Collage", "shared_collage").when(n.endswith(" Collage"), "collage")
    own = F.when(n.contains(" — Identity") | n.contains(" - Identity"), "user_identity").when((n == "Journal") | n.endswith(" Journal"), "user_journal")
    return F.coalesce(F.when(shelf_kind == "hive", hive).when(shelf_kind == "user_journals", own), F.lit("unclassified"))


def classify_chapter(name: Column, book_kind: Column) -> Column:
    """(kind, archive_year)."""
    n, year = trimmed(name), archive_year(name)
    kind = F.when(n == "Agents", "agents").when(n == "Subagent Conversations", "subagent_conversations").when(n == "Journal", "journal_active").when(year.isNotNull(), "journal_archive")
    named = book_kind == "identity"
    return F.struct(F.coalesce(F.when(named, kind), F.lit("unclassified")).alias("kind"), F.when(named, year).alias("archive_year"))


def classify_page(name: Column, book_kind: Column, chapter_kind: Column, chapter_year: Column) -> Column:
    """(kind, key, archive_year): a classified chapter decides, else the book."""
    n, date = trimmed(name), iso_date(name)
    some = lambda c: F.when(c != "", c)
    journal = chapter_kind.isin("journal_active", "journal_archive")
    by_chapter = F.when(chapter_kind == "agents", "agent").when(chapter_kind == "subagent_conversations", "subagent_conversation").when(journal & date.isNotNull(), "journal_entry").when(journal, "unclassified")
    by_book = (
        F.when(book_kind.isin("identity", "user_identity") & (n == "Identity"), "manifest")
        .when(book_kind.isin("collage", "shared_collage"), "collage_topic")
        .when((book_kind == "user_journal") & date.isNotNull(), "journal_entry")
        .otherwise("unclassified")
    )
    kind = F.coalesce(by_chapter, by_book)
    key = F.when(kind == "agent", some(F.trim(F.regexp_extract(n, r"^Agent: (.*)$", 1)))).when(kind == "journal_entry", date).when(kind.isin("subagent_conversation", "collage_topic"), some(n))
    year = F.when((kind == "journal_entry") & (chapter_kind == "journal_archive"), chapter_year)
    return F.struct(kind.alias("kind"), key.alias("key"), year.alias("archive_year"))


def unix_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def content_select(editor: Column, markdown: Column, html: Column) -> Column:
    return F.coalesce(F.when(editor == "markdown", markdown).otherwise(html), F.lit(""))


def valid_description(s: Column) -> Column:
    """Not empty, at least 15 bytes, and no placeholder, alone or as a first word."""
    t = F.lower(trimmed(F.coalesce(s, F.lit(""))))
    hollow = t.isin(*PLACEHOLDERS)
    for p in PLACEHOLDERS:
        hollow = hollow | t.startswith(p + " ")
    return (F.octet_length(t) >= 15) & ~hollow


def join_base_url(base: Column, path: Column) -> Column:
    return F.when(path.startswith("http://") | path.startswith("https://"), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))


def scope_id(scope: Column, kind: str) -> Column:
    """The id of ``kind:id``."""
    return F.when(F.split_part(scope, F.lit(":"), F.lit(1)) == kind, F.split_part(scope, F.lit(":"), F.lit(2)).try_cast("bigint"))


def id_list(values: Column) -> Column:
    """Ids out of an array of text, what is no number left out."""
    return F.filter(F.transform(values, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def bounded(value: Column, default: int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("bigint"), F.lit(default))))
