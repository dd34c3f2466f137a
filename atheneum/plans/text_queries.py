"""Queries for text functions, chunking, models and ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers, documents, text
from ..operators import graph, ingest, models, requests, search, tables, vectors
from ..operators.trained_embedder import TrainedEmbedder
from ..sources.schemas import altered_width
from ..sources.views import Knowledge
from .catalog import LIMIT, SIBLINGS, THRESHOLD, query, query_vector

DIMS = 32


def docs(k: Knowledge):
    return k.base("documents")


query("strip_tags", "SELECT page_id, replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', '') AS plain FROM kb_html")(lambda k: k.html.select("page_id", text.strip_tags(F.col("html")).alias("plain")))
query("normalize_ws", r"SELECT doc_id, regexp_replace(regexp_replace(text, '([\s\x{00A0}])[\s\x{00A0}]*', '\1', 'g'), '[\t\r\f\v\x{00A0} ]', ' ', 'g') AS clean FROM documents")(lambda k: docs(k).select("doc_id", text.normalize_ws(F.col("text")).alias("clean")))
query("truncate_desc", r"SELECT page_id, CASE WHEN strlen(t) <= 150 THEN t ELSE substr(t, 1, 147) || '...' END AS description FROM (SELECT page_id, trim(regexp_replace(replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', ''), '[\s\x{00A0}]+', ' ', 'g')) AS t FROM kb_html)")(
    lambda k: k.html.select("page_id", text.truncate_description(F.col("html")).alias("description"))
)
_LINKS = """SELECT page_id, p FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: CASE WHEN strpos(h, '/books/') > 0 THEN substr(h, strpos(h, '/books/')) WHEN strpos(h, '/link/') > 0 THEN substr(h, strpos(h, '/link/')) END)) AS p FROM kb_html) WHERE p LIKE '/link/%' OR (p LIKE '/books/%' AND p LIKE '%/page/%')"""
query("extract_links", f"SELECT page_id, p AS path FROM ({_LINKS})")(lambda k: k.html.select("page_id", F.explode(text.extract_links(F.col("html"))).alias("path")))
query("resolve_links", rf"SELECT DISTINCT l.page_id AS source_page_id, coalesce(try_cast(nullif(regexp_extract(p, '^/link/(\d+)$', 1), '') AS BIGINT), s.page_id) AS target_page_id, 'link' AS link_type FROM ({_LINKS}) l LEFT JOIN (SELECT slug, min(page_id) AS page_id FROM kb_pages GROUP BY slug) s ON s.slug = regexp_extract(p, '/page/([^/?#]+)', 1) WHERE coalesce(try_cast(nullif(regexp_extract(p, '^/link/(\d+)$', 1), '') AS BIGINT), s.page_id) IS NOT NULL")(
    lambda k: ingest.resolve_links(k.html.select("page_id", F.explode(text.extract_links(F.col("html"))).alias("path")), k.pages)
)
query("sha256_hex", "SELECT doc_id, sha256(text) AS content_hash FROM documents")(lambda k: docs(k).select("doc_id", text.content_hash(F.col("text")).alias("content_hash")))
query("change_detect", "SELECT page_id FROM kb_html WHERE page_id % 3 = 0 OR page_id % 5 = 0")(
    lambda k: ingest.changed(k.html, k.html.filter("page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 3 == 0, "old").otherwise(text.content_hash(F.col("html"))).alias("content_hash"))).select("page_id")
)
query("context_prefix", "SELECT page_id, '[' || concat_ws(' > ', s.name, b.name, c.name, p.name) || ']' || chr(10) || chr(10) AS prefix FROM kb_pages p LEFT JOIN kb_books b USING (book_id) LEFT JOIN kb_chapters c USING (chapter_id) LEFT JOIN kb_shelves s ON s.shelf_id = b.shelf_id")(
    lambda k: k.pages.join(k.books.select("book_id", F.col("name").alias("b"), "shelf_id"), "book_id", "left").join(k.chapters.select("chapter_id", F.col("name").alias("c")), "chapter_id", "left").join(k.shelves.select("shelf_id", F.col("name").alias("s")), "shelf_id", "left").select("page_id", text.context_prefix(F.col("s"), F.col("b"), F.col("c"), F.col("name")).alias("prefix"))
)
query("join_shelf_name", "WITH sb AS (SELECT book_id, book_id % 5 AS shelf_id, 1 AS ord FROM kb_books UNION ALL SELECT book_id, (book_id + 2) % 5, 2 FROM kb_books WHERE book_id % 3 = 0) SELECT book_id, s.name AS shelf FROM (SELECT book_id, arg_max(shelf_id, ord) AS shelf_id FROM sb GROUP BY book_id) JOIN kb_shelves s USING (shelf_id)")(
    lambda k: tables.last_shelf(k.books.select("book_id", (F.col("book_id") % 5).alias("shelf_id"), F.lit(1).alias("ord")).unionByName(k.books.filter("book_id % 3 = 0").select("book_id", ((F.col("book_id") + 2) % 5).alias("shelf_id"), F.lit(2).alias("ord")))).join(k.shelves, "shelf_id").select("book_id", F.col("name").alias("shelf"))
)
_TITLED = ("# {}\n\nB", "#{}\nB", " \n#\n{}\r\nB \n", "## {}\nB", "<h1 id='x'> <b>{}</b></h1>\n\n B", "<H1>{}</H1>B", "# {} too\nB", "<h1>{}</h1>  B")
_LEFT = ("B", "B", "\nB", "## {}\nB", " B", "<H1>{}</H1>B", "# {} too\nB", "  B")  # by the rules, case for case
query("strip_dup_title", "SELECT page_id, replace(CASE page_id % 8 " + " ".join("WHEN {} THEN '{}'".format(i, t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '")) for i, t in enumerate(_LEFT)) + " END, '{}', upper(name)) AS body FROM kb_pages")(
    lambda k: k.pages.select("page_id", text.strip_dup_title(F.replace(F.element_at(F.array(*map(F.lit, _TITLED)), (F.col("page_id") % 8 + 1).cast("int")), F.lit("{}"), F.upper("name")), F.col("name")).alias("body"))
)
query("edit_text", "SELECT doc_id, CASE WHEN n = 1 OR (n > 1 AND doc_id % 2 = 0) THEN replace(text, 'the', 'THE') END AS edited, CASE WHEN n = 0 THEN 'text not found' WHEN n > 1 AND doc_id % 2 = 1 THEN 'text found more than once' END AS error FROM (SELECT *, (length(text) - length(replace(text, 'the', ''))) / 3 AS n FROM documents)")(
    lambda k: docs(k).select("doc_id", text.edit_text(F.col("text"), F.lit("the"), F.lit("THE"), F.col("doc_id") % 2 == 0).alias("e")).select("doc_id", F.col("e.text").alias("edited"), "e.error")
)
query("append_text", r"SELECT doc_id, regexp_replace(text, '[\s\x{00A0}]+$', '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || source ELSE chr(10) || '<p>' || source || '</p>' || chr(10) END AS body FROM documents")(
    lambda k: docs(k).select("doc_id", text.append_text(F.concat("text", F.lit(" \n\n")), F.col("source"), F.when(F.col("doc_id") % 2 == 0, "markdown").otherwise("wysiwyg"), documents.markdown_column(F.col("source"))).alias("body"))
)
query("insert_after_line", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN name || chr(10) || '  anchor ' || chr(10) || 'new' || chr(10) || slug WHEN 1 THEN name || chr(10) || 'anchor' || chr(10) || 'new' || chr(10) END AS body FROM kb_pages")(
    lambda k: k.pages.select("page_id", text.insert_after_line(F.concat("name", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\n  anchor \r\n"), "slug", F.lit("\n"))).when(F.col("page_id") % 3 == 1, "\nanchor").otherwise("\nnone")), F.lit(" anchor"), F.lit("new")).alias("body"))
)
query("strip_frontmatter", "SELECT page_id, 'Body of ' || name AS body, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'id' || page_id END AS ouid FROM kb_pages")(
    lambda k: k.pages.select("page_id", F.concat(F.lit("---\ntitle: x\n"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.when(F.col("page_id") % 3 == 1, 'ouid: "id').otherwise('ai_identity_ouid: "id'), F.col("page_id").cast("string"), F.lit('"\n'))), F.lit("---\nBody of "), F.col("name")).alias("raw")).select("page_id", text.strip_frontmatter(F.col("raw")).alias("body"), text.frontmatter_field(F.col("raw"), "ai_identity_ouid", "ouid").alias("ouid"))
)
query("frontmatter_field", "SELECT page_id, name AS ouid FROM kb_pages")(lambda k: k.pages.select("page_id", text.frontmatter_field(F.concat(F.lit("---\nouid: '"), F.col("name"), F.lit("'\n---\nx")), "ouid").alias("ouid")))
query("classify_shelf", "SELECT shelf_id, 'unclassified' AS kind FROM kb_shelves")(lambda k: k.shelves.select("shelf_id", text.classify_shelf(F.col("shelf_id")).alias("kind")))


def named_books(k: Knowledge):
    i = F.col("book_id") % 5
    name = F.when(i == 0, F.concat("name", F.lit(" Identity"))).when(i == 1, F.concat("name", F.lit("'s Collage"))).when(i == 2, F.lit("Cross-Identity Collage")).when(i == 3, F.lit(" Journal ")).otherwise(F.concat("name", F.lit(" — Identity of x")))
    kind = F.when(F.col("book_id") % 3 == 0, "hive").when(F.col("book_id") % 3 == 1, "user_journals").otherwise("unclassified")
    return k.books.select("book_id", name.alias("name"), kind.alias("shelf_kind"))


query("classify_book", "SELECT book_id, CASE book_id % 3 WHEN 0 THEN CASE book_id % 5 WHEN 0 THEN 'identity' WHEN 1 THEN 'collage' WHEN 2 THEN 'shared_collage' ELSE 'unclassified' END WHEN 1 THEN CASE book_id % 5 WHEN 3 THEN 'user_journal' WHEN 4 THEN 'user_identity' ELSE 'unclassified' END ELSE 'unclassified' END AS kind FROM kb_books")(
    lambda k: named_books(k).select("book_id", text.classify_book(F.col("name"), F.col("shelf_kind")).alias("kind"))
)


def named_chapters(k: Knowledge):
    i = F.col("chapter_id") % 5
    name = F.when(i == 0, "Agents").when(i == 1, "Subagent Conversations").when(i == 2, "Journal").when(i == 3, F.concat(F.lit("Journal Archive - "), (F.col("chapter_id") + 1895).cast("string"))).otherwise("Notes")
    return k.chapters.select("chapter_id", name.alias("name"), F.when(F.col("chapter_id") % 7 == 0, "collage").otherwise("identity").alias("book_kind"))


query("classify_chapter", "SELECT chapter_id, CASE WHEN chapter_id % 7 = 0 THEN 'unclassified' ELSE CASE chapter_id % 5 WHEN 0 THEN 'agents' WHEN 1 THEN 'subagent_conversations' WHEN 2 THEN 'journal_active' WHEN 3 THEN CASE WHEN chapter_id >= 5 THEN 'journal_archive' ELSE 'unclassified' END ELSE 'unclassified' END END AS kind, CASE WHEN chapter_id % 7 <> 0 AND chapter_id % 5 = 3 AND chapter_id >= 5 THEN CAST(chapter_id + 1895 AS INT) END AS archive_year FROM kb_chapters")(
    lambda k: named_chapters(k).select("chapter_id", text.classify_chapter(F.col("name"), F.col("book_kind")).alias("c")).select("chapter_id", "c.kind", "c.archive_year")
)
query("parse_archive_year", "SELECT chapter_id, CASE WHEN chapter_id % 5 = 3 AND chapter_id >= 5 THEN CAST(chapter_id + 1895 AS INT) END AS year FROM kb_chapters")(lambda k: named_chapters(k).select("chapter_id", text.archive_year(F.col("name")).alias("year")))
query("match_iso_date", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day FROM kb_events")(
    lambda k: k.events.select("event_id", text.iso_date(F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_id") % 3 == 0, "x").otherwise(" "))).alias("day"))
)
query("classify_page", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'agent' WHEN 1 THEN CASE WHEN page_id % 3 = 0 THEN 'journal_entry' ELSE 'unclassified' END WHEN 2 THEN 'collage_topic' ELSE 'unclassified' END AS kind, CASE page_id % 4 WHEN 0 THEN name WHEN 1 THEN CASE WHEN page_id % 3 = 0 THEN '2024-02-30' END WHEN 2 THEN name END AS key, CASE WHEN page_id % 4 = 1 AND page_id % 3 = 0 THEN 2024 END AS archive_year FROM kb_pages")(
    lambda k: k.pages.select("page_id", (F.col("page_id") % 4).alias("i"), "name").select("page_id", text.classify_page(
        F.when(F.col("i") == 0, F.concat(F.lit("Agent: "), "name")).when((F.col("i") == 1) & (F.col("page_id") % 3 == 0), "2024-02-30").otherwise(F.col("name")),
        F.when(F.col("i") == 2, "collage").otherwise("identity"),
        F.when(F.col("i") == 0, "agents").when(F.col("i") == 1, "journal_archive"),
        F.lit(2024),
    ).alias("c")).select("page_id", "c.kind", "c.key", "c.archive_year")
)
query("unix_to_iso", "SELECT event_id, strftime(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso FROM kb_events")(lambda k: k.events.select("event_id", text.unix_to_iso(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("iso")))
query("content_select", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN name WHEN page_id % 3 = 1 THEN slug ELSE '' END AS body FROM kb_pages")(
    lambda k: k.pages.select("page_id", text.content_select(F.when(F.col("page_id") % 3 == 0, "markdown").otherwise(""), F.col("name"), F.when(F.col("page_id") % 3 == 1, F.col("slug"))).alias("body"))
)
_FIRST = (" ToDo ", "TBD ", "placeholder ", "Description ", "xxx ", "fixme ", "n/a ", "test ", "none ", "todos ", "")
query("validate_description", "SELECT p_partkey, strlen(trim(list_extract([" + ", ".join(f"'{x}'" for x in _FIRST) + "], CAST(p_partkey % 11 + 1 AS INT)) || p_name)) >= 15 AND p_partkey % 11 > 6 AS ok FROM part")(
    lambda k: k.base("part").select("p_partkey", text.valid_description(F.concat(F.element_at(F.array(*map(F.lit, _FIRST)), (F.col("p_partkey") % 11 + 1).cast("int")), F.col("p_name"))).alias("ok"))
)
query("join_base_url", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://x.org/' || slug ELSE 'https://kb.org/' || slug END AS url FROM kb_pages")(
    lambda k: k.pages.select("page_id", text.join_base_url(F.lit("https://kb.org/"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://x.org/"), "slug")).otherwise(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), "slug")).otherwise(F.col("slug")))).alias("url"))
)
query("array_set_edit", "SELECT shelf_id, list_sort(list_filter(list_distinct(list_append(list(book_id), 99)), lambda b: b <> 3))::VARCHAR AS books FROM kb_books WHERE shelf_id IS NOT NULL GROUP BY shelf_id")(
    lambda k: k.books.filter("shelf_id IS NOT NULL").groupBy("shelf_id").agg(tables.set_edit(F.collect_list("book_id"), [99], [3]).cast("string").alias("books"))
)
query("update_field_mask", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN slug ELSE name END AS name FROM kb_pages")(lambda k: tables.masked(k.pages, {"name": F.when(F.col("page_id") % 3 == 0, F.col("slug"))}).select("page_id", "name"))
query("parse_scope_id", "SELECT id, CASE WHEN scope LIKE 'book:%' THEN CAST(substr(scope, 6) AS BIGINT) END AS book_id, CAST(NULL AS BIGINT) AS page_id FROM kb_jobs")(lambda k: k.jobs.select("id", text.scope_id(F.col("scope"), "book").alias("book_id"), text.scope_id(F.col("scope"), "page").alias("page_id")))
query("arg_coercion", "SELECT page_id, [page_id, page_id + 1]::VARCHAR AS ids, greatest(1, least(100, CASE WHEN page_id % 3 = 0 THEN 10 ELSE page_id END)) AS limit_arg FROM kb_pages")(
    lambda k: k.pages.select("page_id", text.id_list(F.array(F.col("page_id").cast("string"), F.lit("x"), (F.col("page_id") + 1).cast("string"))).cast("string").alias("ids"), text.bounded(F.when(F.col("page_id") % 3 != 0, F.col("page_id").cast("string")).otherwise("many"), 10, 1, 100).alias("limit_arg"))
)
_BASE = "https://kb.org"
# Each page is a request, and its siblings, at most 20, are its results.
query("format_search_text", f"""WITH n AS ({SIBLINGS}), r AS (SELECT n.page_id AS request, row_number() OVER (PARTITION BY n.page_id ORDER BY neighbour_id) AS pos, q.name, neighbour_id AS id, q.slug FROM n JOIN kb_pages q ON q.page_id = neighbour_id),
 t AS (SELECT request, count(*) AS n, string_agg('- [page] ' || name || ' (id: ' || id || ')' || CASE WHEN id % 3 > 0 THEN ' — https://kb.org/books/b/page/' || slug ELSE '' END
  || CASE WHEN id % 2 = 0 THEN chr(10) || '  Preview: ' || substr(repeat(slug || ' of ' || name || '; ', 9), 1, 200) ELSE '' END || chr(10), chr(10) ORDER BY pos) AS lines FROM r GROUP BY request)
 SELECT page_id AS request, coalesce('Found ' || (n + page_id % 5) || ' results:' || chr(10) || chr(10) || lines, 'No results found.') AS shown FROM kb_pages LEFT JOIN t ON request = page_id""")(lambda k: _shown(k))


def _shown(k: Knowledge):
    # The planner takes siblings for as many rows as there are pages, and would send them or their counts to all executors.
    near = graph.siblings(k.pages)
    of = k.pages.select(F.col("page_id").alias("neighbour_id"), "name", "slug").hint("shuffle_hash")
    rows = near.join(of, "neighbour_id").select(
        F.col("page_id").alias("request"), F.col("neighbour_id").alias("pos"), F.lit("page").alias("type"), "name", F.col("neighbour_id").alias("id"),
        F.when(F.col("neighbour_id") % 3 > 0, F.concat(F.lit("books/b/page/"), "slug")).alias("url"),
        F.when(F.col("neighbour_id") % 2 == 0, F.repeat(F.concat(F.lit("<p>"), "slug", F.lit(" of <b>"), "name", F.lit("</b>; </p>")), F.lit(9))).alias("preview"),
    )
    counts = near.groupBy("page_id").agg(F.count("*").alias("n")).hint("merge")
    asked = k.pages.join(counts, "page_id", "left").select(F.col("page_id").alias("request"), (F.coalesce("n", F.lit(0)) + F.col("page_id") % 5).alias("total"))
    return answers.search_texts(asked, rows, _BASE + "/", "request", "total")


query("format_success", """SELECT 'page' AS kind, page_id AS id, 'Page updated.' || chr(10) || 'Page ID: ' || page_id || chr(10) || 'Book ID: ' || book_id || chr(10) || 'Name: ' || name || chr(10) || 'Editor: ' || CASE WHEN page_id % 2 = 0 THEN 'markdown' ELSE 'unknown' END
  || chr(10) || 'Slug: ' || slug || chr(10) || 'Revision: ' || page_id % 7 || CASE page_id % 3 WHEN 0 THEN chr(10) || 'URL: https://kb.org/books/b' || book_id || '/page/' || slug WHEN 1 THEN chr(10) || 'URL: https://kb.org/p/' || slug ELSE '' END
  || chr(10) || 'Use get_page(' || page_id || ') to verify content if needed.' AS said FROM kb_pages
 UNION ALL SELECT 'shelf', shelf_id, 'Shelf created.' || chr(10) || 'Shelf ID: ' || shelf_id || chr(10) || 'Name: ' || name || chr(10) || 'Slug: ' || slug || CASE WHEN shelf_id % 2 = 0 THEN chr(10) || 'Description: about ' || name ELSE '' END || chr(10) || 'URL: https://kb.org/shelves/' || slug FROM kb_shelves
 UNION ALL SELECT 'book', book_id, 'Book created.' || chr(10) || 'Book ID: ' || book_id || chr(10) || 'Name: ' || name || chr(10) || 'Slug: ' || slug || CASE WHEN book_id % 2 = 0 THEN chr(10) || 'Description: about ' || name ELSE '' END || chr(10) || 'URL: https://kb.org/books/' || slug FROM kb_books
 UNION ALL SELECT 'chapter', chapter_id, 'Chapter updated.' || chr(10) || 'Chapter ID: ' || chapter_id || chr(10) || 'Book ID: ' || book_id || chr(10) || 'Name: ' || name || chr(10) || 'Slug: ' || slug || CASE WHEN chapter_id % 2 = 0 THEN chr(10) || 'Description: about ' || name ELSE '' END
  || CASE WHEN chapter_id % 3 = 0 THEN chr(10) || 'URL: https://kb.org/books/b' || book_id || '/chapter/' || slug ELSE '' END FROM kb_chapters""")(lambda k: _said(k))


def _said(k: Knowledge):
    name, slug, book = F.col("name"), F.col("slug"), F.col("book_id")
    about = lambda key: F.when(F.col(key) % 2 == 0, F.concat(F.lit("about "), name))
    of_book = lambda key: F.when(F.col(key) % 3 == 0, F.concat(F.lit("b"), book))
    page, path = F.col("page_id"), F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("/p/"), slug))
    parts = [
        (k.pages, "page", "page_id", answers.page_success("Page updated.", _BASE, page, book, name, slug, F.when(page % 2 == 0, "markdown"), page % 7, path, of_book("page_id"))),
        (k.shelves, "shelf", "shelf_id", answers.shelf_success("Shelf created.", _BASE, F.col("shelf_id"), name, slug, about("shelf_id"))),
        (k.books, "book", "book_id", answers.book_success("Book created.", _BASE, book, name, slug, about("book_id"))),
        (k.chapters, "chapter", "chapter_id", answers.chapter_success("Chapter updated.", _BASE, F.col("chapter_id"), book, name, slug, about("chapter_id"), of_book("chapter_id"))),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), said.alias("said")) for df, kind, key, said in parts])


query("time_block", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS now_unix, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS now_utc, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS now_local, strftime(ts + INTERVAL 9 HOUR, '%A, %B %-d, %Y at %-I:%M %p') AS now_human, 'Asia/Tokyo' AS timezone, 'env' AS timezone_source FROM kb_events")(
    lambda k: k.events.select("event_id", requests.time_columns(F.col("ts").cast("timestamp"), "Asia/Tokyo", "env").alias("t")).select("event_id", "t.*")
)
query("flatten_book_pages", "SELECT book_id, page_id, name, chapter_id FROM kb_pages WHERE NOT deleted AND chapter_id IS NULL UNION ALL SELECT p.book_id, page_id, p.name, chapter_id FROM kb_pages p WHERE NOT deleted AND chapter_id IS NOT NULL")(lambda k: _flattened(k))


def _flattened(k: Knowledge):
    live = k.pages.filter("NOT deleted")
    page = F.struct(F.lit("page").alias("type"), F.col("page_id").alias("id"), F.col("name"))
    roots = live.filter("chapter_id IS NULL").select("book_id", F.to_json(page).alias("j"))
    chapters = live.filter("chapter_id IS NOT NULL").groupBy("book_id", "chapter_id").agg(F.collect_list(F.struct(F.col("page_id").alias("id"), F.col("name"))).alias("pages"))
    chapters = chapters.select("book_id", F.to_json(F.struct(F.lit("chapter").alias("type"), F.col("chapter_id").alias("id"), "pages")).alias("j"))
    contents = roots.unionByName(chapters).groupBy("book_id").agg(F.concat(F.lit('[{"type":"other","id":1},'), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("contents"))
    return contents.select("book_id", F.explode(ingest.parse_book_contents(F.col("contents"))).alias("p")).select("book_id", "p.*")


# --- documents, models, ingest: checked by unit tests; rows only here ------------------------------------------------

query("chunk_html")(lambda k: documents.chunk_pages(k.html))
query("split_overlap")(lambda k: docs(k).select("doc_id", F.explode(documents.split_column(F.col("text"))).alias("part")))
query("markdown_to_html")(lambda k: docs(k).select("doc_id", documents.markdown_column(F.col("text")).alias("html")))
query("replace_section_md", "SELECT page_id, '# ' || name || chr(10) || 'new *text*' || chr(10) || chr(10) || '# next' || chr(10) || chr(10) || 'y' AS body FROM kb_pages")(
    lambda k: k.pages.select("page_id", documents.replace_section(F.lit("markdown"), F.concat(F.lit("# "), "name", F.lit("\n\nold\n\n## sub\n\nx\n\n# next\n\ny\n")), F.concat(F.lit("## "), F.lower("name")), F.lit("new *text*")).alias("body"))
)
query("replace_section_html", "SELECT page_id, '<p>a</p><h2><i>' || name || '</i></h2>' || chr(10) || '<p>new <em>text</em></p>' || chr(10) || chr(10) || '<h2>Next</h2>z' AS body FROM kb_pages")(
    lambda k: k.pages.select("page_id", documents.replace_section(F.lit("wysiwyg"), F.concat(F.lit("<p>a</p><h2><i>"), "name", F.lit("</i></h2>old<h3>sub</h3>x<h2>Next</h2>z")), F.upper("name"), F.lit("new *text*")).alias("body"))
)
query("embed_texts")(lambda k: docs(k).select("doc_id", models.embed(F.col("text"), DIMS).alias("embedding")))
query("embed_texts_trained")(lambda k: docs(k).select("doc_id", models.embed(F.col("text"), DIMS, TrainedEmbedder.fit(docs(k), DIMS).maker(k.spark)).alias("embedding")))
query("blob_codec", "SELECT chunk_id, len(embedding)::INT AS dims, 4 * len(embedding)::INT AS n_bytes, true AS same FROM kb_chunks")(
    lambda k: k.chunks.select("chunk_id", F.size("embedding").alias("dims"), "embedding", vectors.pack(F.col("embedding")).alias("blob")).select("chunk_id", "dims", F.octet_length("blob").alias("n_bytes"), (vectors.unpack(F.col("blob")) == F.col("embedding")).alias("same"))
)
query("backend_copy", "SELECT chunk_id, page_id FROM kb_chunks")(lambda k: k.chunks.select("chunk_id", "page_id", vectors.pack(F.col("embedding")).alias("blob")).filter(F.size(vectors.unpack(F.col("blob"))) == 64).select("chunk_id", "page_id"))
query("rerank")(
    lambda k: models.rerank(
        vectors.vector_topk(k.chunks, query_vector(k), 40, THRESHOLD).join(k.pages, "page_id").select("chunk_id", F.col("chunk_id").alias("pos"), search.rerank_document(F.col("name"), F.col("slug"), F.lit("")).alias("doc")), "customer 000000022", "doc", LIMIT
    )
)
query("rerank_search_results")(lambda k: models.rerank(k.keyword_hits.filter(F.col("pos") < models.MAX_DOCUMENTS).join(k.pages, "page_id").select("pos", "page_id", text.strip_tags(F.concat(F.lit("<b>"), "name", F.lit("</b> "), "slug")).alias("doc")), "customer 000000037", "doc", 20))
query("embed_single_page")(lambda k: _ingested(k, k.html.filter("page_id = 8")))
query("embed_pipeline")(lambda k: _ingested(k, k.html.join(k.pages.filter(ingest.in_scope("all")).select("page_id"), "page_id", "left_semi")))


def _ingested(k: Knowledge, raw):
    job = ingest.embed_job(raw, k.books, k.chapters, k.shelves, k.pages, DIMS)
    return job.done.chunks.select("page_id", "chunk_index", "content_hash", F.size("embedding").alias("dims"))

query("alter_dim", "SELECT 64 AS dims, count(*) AS kept FROM kb_chunks WHERE NOT EXISTS (SELECT 1 FROM kb_chunks WHERE len(embedding) <> 64) UNION ALL SELECT 32, 0")(
    lambda k: altered_width(k.chunks, 64).agg(F.lit(64).alias("dims"), F.count("*").alias("kept")).unionByName(altered_width(k.chunks, 32).agg(F.lit(32).alias("dims"), F.count("*").alias("kept")))
)
query("scope_named", "SELECT chunk_id FROM kb_chunks WHERE page_id IN (SELECT page_id FROM kb_pages WHERE book_id IN (2, 5) OR page_id = 77)")(
    lambda k: (lambda s: tables.scoped(k.chunks, k.pages, books=s["books"], page_ids=s["pages"]).select("chunk_id"))(requests.named_scopes({"one": {"books": [5, 2]}, "two": {"pages": [77]}}, ["one", "gone", "two"])[0])
)
query("keyword_filters", "SELECT page_id FROM kb_pages WHERE contains(lower(name), '00001') AND book_id = 3")(
    lambda k: requests.keyword_filter(k.pages.select("page_id", F.when(F.col("book_id") == 3, "page").otherwise("chapter").alias("type"), "name", F.lit("").alias("text"), F.lit("u").alias("created_by"), F.create_map(F.lit("book"), F.col("book_id").cast("string")).alias("tags")), "{type:page} {in_name:00001} [book=3] {created_by:me}", "u").select("page_id")
)
