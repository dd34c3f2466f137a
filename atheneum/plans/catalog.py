"""The registered queries: each applies one operator to the derived tables, beside the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acl, graph, jobs, requests, search, tables, tree, vectors
from ..sources.staging import numbered, pool, settled
from ..sources.views import Knowledge, oracle

Build = Callable[[Knowledge], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Registers a query under ``name``; without SQL only its rows are checked."""

    def add(build: Build) -> Build:
        QUERIES[name] = lambda spark, folder: build(Knowledge(spark, folder))
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return build

    return add


THRESHOLD, LIMIT, ROLES = 0.10, 10, [1, 2]


def query_vector(k: Knowledge) -> list[float]:
    """The vector searched with: that of chunk 0."""
    row = k.chunks.filter("chunk_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM kb_chunks WHERE chunk_id = 0)"
HITS = f"""hits AS (SELECT chunk_id, page_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}) AS score FROM kb_chunks
  WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}) >= {THRESHOLD} ORDER BY score DESC, chunk_id LIMIT %d)"""

# --- scans and look-ups --------------------------------------------------------------------------------------------

query("scan_shelves", "SELECT shelf_id, name, slug, deleted FROM kb_shelves")(lambda k: k.shelves.select("shelf_id", "name", "slug", "deleted"))
query("scan_books", "SELECT book_id, name, slug, shelf_id, deleted FROM kb_books")(lambda k: k.books)
query("scan_chunks", "SELECT chunk_id, page_id, round(embedding[1]::DOUBLE, 6) AS first_x, len(embedding)::INT AS dims FROM kb_chunks")(
    lambda k: k.chunks.select("chunk_id", "page_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_x"), F.size("embedding").alias("dims"))
)
query("scan_delta", "SELECT page_id, CAST(epoch_us(updated_at) AS BIGINT) AS updated_us FROM kb_page_updates WHERE updated_at > TIMESTAMP '2024-01-10 00:00:00' ORDER BY updated_at, page_id LIMIT 250")(
    lambda k: tables.delta(k.page_updates, "2024-01-10 00:00:00").select("page_id", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))
)
query("scan_by_ids", "SELECT chunk_id, page_id, name, book_id FROM kb_chunks JOIN kb_pages USING (page_id) WHERE chunk_id IN (0, 7, 119, 120, 341, 999999)")(
    lambda k: k.chunks.filter(F.col("chunk_id").isin(0, 7, 119, 120, 341, 999999)).join(k.pages, "page_id").select("chunk_id", "page_id", "name", "book_id")
)
query("point_lookup", "SELECT page_id, name, book_id FROM kb_pages WHERE slug = 'customer-000000007' ORDER BY page_id LIMIT 1")(
    lambda k: tables.window_of(tables.by_id(k.pages, "slug", "customer-000000007"), ["page_id"], 1).select("page_id", "name", "book_id")
)
query(
    "point_lookup_index",
    "SELECT 'shelf' AS kind, shelf_id AS id, name FROM kb_shelves WHERE shelf_id = 2 UNION ALL SELECT 'book', book_id, name FROM kb_books WHERE book_id = 11 UNION ALL SELECT 'chapter', chapter_id, name FROM kb_chapters WHERE chapter_id = 17 UNION ALL SELECT 'page', page_id, name FROM kb_pages WHERE page_id = 52",
)(
    lambda k: tables.index_lookup(k.shelves, k.books, k.chapters, k.pages, {"shelf": 2, "book": 11, "chapter": 17, "page": 52})
)

# --- changes -------------------------------------------------------------------------------------------------------

_NEW_PAGES = "SELECT page_id + 1490 AS page_id, book_id, chapter_id, concat('new ', name) AS name, slug, deleted, acl_computed_at, acl_default_open FROM kb_pages WHERE page_id < 20"


def new_pages(k: Knowledge) -> DataFrame:
    return k.pages.filter("page_id < 20").withColumns({"name": F.concat(F.lit("new "), "name"), "page_id": F.col("page_id") + 1490})


query("sink_upsert_page", f"WITH n AS ({_NEW_PAGES}) SELECT page_id, name, slug FROM (SELECT * FROM kb_pages WHERE page_id NOT IN (SELECT page_id FROM n) UNION ALL SELECT * FROM n)")(
    lambda k: tables.upsert(k.pages, new_pages(k), ["page_id"]).select("page_id", "name", "slug")
)


@query(
    "sink_upsert_index_page",
    """SELECT 'index' AS side, page_id, CASE WHEN page_id % 4 = 1 THEN 'newest ' || name ELSE name END AS content, CASE WHEN page_id % 4 = 1 THEN 500 ELSE 1 END AS stamped FROM kb_pages
 UNION ALL SELECT 'cache', page_id, CASE WHEN page_id % 4 = 1 THEN 'text 2' ELSE 'old' END, CASE WHEN page_id % 4 = 1 THEN 500 ELSE 1 END FROM kb_pages WHERE page_id % 4 = 1 OR page_id % 3 = 0""",
)
def _(k):
    index = k.pages.select("page_id", "name", F.lit(1).cast("long").alias("indexed_at"))
    cache = k.pages.filter("page_id % 3 = 0").select("page_id", F.lit("old").alias("markdown"), F.lit(1).cast("long").alias("cached_at"))
    # Two versions of each page come at once; the later one counts.
    one = k.pages.filter("page_id % 4 = 1").select("page_id", "name")
    new = [one.select("page_id", F.concat(F.lit(w), "name").alias("name"), F.lit(f"text {i}").alias("markdown"), F.lit(i).alias("page_updated_at")) for i, w in ((1, "newer "), (2, "newest "))]
    rows, cached = tables.upsert_index_pages(index, cache, new[0].unionByName(new[1]), 500)
    out = rows.select(F.lit("index").alias("side"), "page_id", F.col("name").alias("content"), F.col("indexed_at").cast("int").alias("stamped"))
    return out.unionByName(cached.select(F.lit("cache").alias("side"), "page_id", F.col("markdown").alias("content"), F.col("cached_at").cast("int").alias("stamped")))


query("sink_replace_chunks", "SELECT chunk_id, page_id, chunk_index FROM kb_chunks WHERE page_id <> 5 UNION ALL SELECT 900000 + chunk_id, 5, chunk_index + 1 FROM kb_chunks WHERE page_id = 6")(
    lambda k: tables.replace_group(
        k.chunks.select("chunk_id", "page_id", "chunk_index"),
        k.chunks.filter("page_id = 6").select((F.col("chunk_id") + 900000).alias("chunk_id"), F.lit(5).cast("long").alias("page_id"), (F.col("chunk_index") + 1).alias("chunk_index")),
        k.pages.filter("page_id = 5"),
        ["page_id"],
    )
)
query(
    "sink_replace_links",
    "SELECT source_page_id, target_page_id, link_type FROM kb_relationships WHERE NOT (source_page_id < 10 AND link_type = 'link') UNION SELECT page_id, page_id + 1, 'link' FROM kb_pages WHERE page_id < 10",
)(
    lambda k: tables.replace_group(
        k.relationships,
        k.pages.filter("page_id < 10").select(F.col("page_id").alias("source_page_id"), (F.col("page_id") + 1).alias("target_page_id"), F.lit("link").alias("link_type")),
        k.pages.filter("page_id < 10").select(F.col("page_id").alias("source_page_id")),
        ["source_page_id"],
        F.col("link_type") == "link",
    )
)


@query(
    "sink_delete_page",
    "SELECT 'pages' AS kind, count(*) AS n FROM kb_pages WHERE page_id % 10 <> 3 UNION ALL SELECT 'chunks', count(*) FROM kb_chunks WHERE page_id % 10 <> 3 UNION ALL SELECT 'edges', count(*) FROM kb_relationships WHERE source_page_id % 10 <> 3 AND target_page_id % 10 <> 3",
)
def _(k):
    kept = tables.delete_pages(k.pages, k.chunks, k.relationships, k.pages.filter("page_id % 10 = 3").select("page_id"))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in zip(("pages", "chunks", "edges"), kept, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


query("sink_clear_all", "SELECT 'pages' AS kind, count(*) AS rows_before, 0::BIGINT AS rows_after, 'page_id' AS first_column FROM kb_pages UNION ALL SELECT 'chunks', count(*), 0, 'chunk_id' FROM kb_chunks UNION ALL SELECT 'edges', count(*), 0, 'source_page_id' FROM kb_relationships")(
    lambda k: reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count("*").alias("rows_before")).join(F.broadcast(tables.cleared(df).agg(F.count("*").alias("rows_after")))).select(F.lit(kind).alias("kind"), "rows_before", "rows_after", F.lit(tables.cleared(df).columns[0]).alias("first_column"))
            for kind, df in (("pages", k.pages), ("chunks", k.chunks), ("edges", k.relationships))
        ],
    )
)
for _kind in ("shelf", "book", "chapter"):
    _table, _id = {"shelf": ("shelves", "shelf_id"), "book": ("books", "book_id"), "chapter": ("chapters", "chapter_id")}[_kind]
    query(f"sink_upsert_{_kind}", f"SELECT {_id}, CASE WHEN {_id} % 4 = 1 THEN concat('renamed ', name) ELSE name END AS name FROM kb_{_table}")(
        lambda k, t=_table, i=_id: tables.upsert(getattr(k, t), getattr(k, t).filter(F.col(i) % 4 == 1).withColumn("name", F.concat(F.lit("renamed "), "name")), [i]).select(i, "name")
    )
    query(f"sink_soft_delete_{_kind}", f"SELECT {_id}, deleted OR {_id} IN (1, 2, 3) AS deleted FROM kb_{_table}")(lambda k, t=_table, i=_id: tables.soft_delete(getattr(k, t), i, [1, 2, 3]).select(i, "deleted"))
query("sink_soft_delete_page", "SELECT page_id, deleted OR page_id IN (1, 2, 3) AS deleted FROM kb_pages")(lambda k: tables.soft_delete(k.pages, "page_id", [1, 2, 3]).select("page_id", "deleted"))

# --- filters and listings ------------------------------------------------------------------------------------------

query("filter_scope_union", "SELECT chunk_id, page_id FROM kb_chunks WHERE page_id IN (SELECT page_id FROM kb_pages WHERE book_id IN (3, 4) OR chapter_id IN (41, 62) OR page_id IN (9, 11))")(
    lambda k: tables.scoped(k.chunks, k.pages, books=[3, 4], chapters=[41, 62], page_ids=[9, 11]).select("chunk_id", "page_id")
)
query("scope_expand_shelves", "SELECT book_id FROM kb_books WHERE NOT deleted AND shelf_id IN (1, 3)")(lambda k: tables.books_of_shelves(k.books, [1, 3]))
query("scope_merge", "SELECT chunk_id FROM kb_chunks JOIN kb_pages USING (page_id) WHERE book_id IN (2, 3, 5) OR chapter_id = 41 OR page_id IN (7, 9)")(
    lambda k: (lambda s: tables.scoped(k.chunks, k.pages, s["books"], s["chapters"], s["pages"]).select("chunk_id"))(requests.merge_scopes({"books": [5, 2], "pages": [9]}, {}, {"books": [3, 5], "chapters": [41], "pages": [9, 7]}))
)
_KEYWORD = "kw AS (SELECT page_id, max(1.0::DOUBLE - pos::DOUBLE / total) AS keyword FROM (SELECT *, count(*) OVER () AS total FROM kb_keyword_hits) WHERE kind = 'page' AND page_id <> 0 GROUP BY page_id)"
query("rank_keyword_decay", f"WITH {_KEYWORD} SELECT page_id, round(keyword, 6) AS keyword FROM kw")(lambda k: search.keyword_decay(k.keyword_hits).select("page_id", F.round("keyword", 6).alias("keyword")))
query("filter_keyword_scope", f"WITH {_KEYWORD} SELECT page_id, round(keyword, 6) AS keyword FROM kw JOIN kb_pages USING (page_id) WHERE page_id IN (29, 60) OR book_id IN (1, 2, 3, 4, 5, 6, 7, 8)")(
    lambda k: search.keyword_scope(search.keyword_decay(k.keyword_hits), k.pages, [1, 2, 3, 4, 5, 6, 7, 8], [29, 60]).select("page_id", F.round("keyword", 6).alias("keyword"))
)
query("filter_threshold", f"SELECT chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}), 4) AS score FROM kb_chunks WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}) >= 0.2")(
    lambda k: k.chunks.select("chunk_id", vectors.query_cosine(F.col("embedding"), query_vector(k)).alias("s")).filter("s >= 0.2").select("chunk_id", F.round("s", 4).alias("score"))
)
query("filter_live", "SELECT page_id FROM kb_pages WHERE NOT deleted")(lambda k: tables.live(k.pages).select("page_id"))
_CACHE = "SELECT page_id, page_id % 3 <> 0 AS viewable, 1000 + page_id AS cached_at FROM kb_pages WHERE page_id % 4 <> 0"


def cache_table(k: Knowledge) -> DataFrame:
    return k.pages.filter("page_id % 4 <> 0").select("page_id", (F.col("page_id") % 3 != 0).alias("viewable"), (F.col("page_id") + 1000).alias("cached_at"))


for _name in ("filter_ttl", "perm_cache_get"):
    query(_name, f"SELECT * FROM ({_CACHE}) WHERE cached_at >= 1300")(lambda k: tables.fresh(cache_table(k), "cached_at", 1300))
query("perm_cache_evict", f"SELECT * FROM ({_CACHE}) WHERE cached_at >= 1700")(lambda k: tables.fresh(cache_table(k), "cached_at", 1700))
query("perm_cache_upsert", f"SELECT * FROM ({_CACHE}) WHERE page_id >= 40 UNION ALL SELECT page_id, true, 5000 FROM kb_pages WHERE page_id < 40")(
    lambda k: tables.upsert(cache_table(k), k.pages.filter("page_id < 40").select("page_id", F.lit(True).alias("viewable"), F.lit(5000).cast("long").alias("cached_at")), ["page_id"])
)
for _name, _table, _where, _order, _cols in (
    ("list_shelves", "shelves", "NOT deleted", "name, shelf_id", "shelf_id, name"),
    ("list_books_by_shelf", "books", "NOT deleted AND shelf_id = 1", "name, book_id", "book_id, name"),
    ("list_books_unshelved", "books", "NOT deleted AND shelf_id IS NULL", "name, book_id", "book_id, name"),
    ("list_chapters_by_book", "chapters", "NOT deleted AND book_id = 3", "name, chapter_id", "chapter_id, name"),
    ("list_pages_by_chapter", "pages", "NOT deleted AND chapter_id = 17", "name, page_id", "page_id, name"),
    ("list_pages_by_book_root", "pages", "NOT deleted AND book_id = 3 AND chapter_id IS NULL", "name, page_id", "page_id, name"),
):
    query(_name, f"SELECT row_number() OVER (ORDER BY {_order}) AS pos, {_cols} FROM kb_{_table} WHERE {_where}")(
        lambda k, t=_table, w=_where, o=_order, c=_cols: numbered(getattr(k, t).filter(w).select(*c.split(", ")), *o.split(", "))
    )
query("list_books_by_identity", "SELECT book_id, book_kind, name FROM (SELECT book_id, name, deleted, book_id % 4 AS identity, CASE WHEN book_id % 2 = 0 THEN 'identity' ELSE 'collage' END AS book_kind FROM kb_books) WHERE NOT deleted AND identity = 2 ORDER BY book_kind, name, book_id")(
    lambda k: k.books.withColumns({"identity": F.col("book_id") % 4, "book_kind": F.when(F.col("book_id") % 2 == 0, "identity").otherwise("collage")}).filter("NOT deleted AND identity = 2").orderBy("book_kind", "name", "book_id").select("book_id", "book_kind", "name")
)
query("find_page_by_key", "SELECT page_id, name FROM kb_pages WHERE NOT deleted AND book_id = 5 AND page_id % 3 = 1 AND page_id % 2 = 0 ORDER BY page_id LIMIT 1")(
    lambda k: tables.page_by_key(
        k.pages.withColumns({"identity_ouid": F.concat(F.lit("id"), "book_id"), "page_kind": F.when(F.col("page_id") % 3 == 1, "agent").otherwise("manifest"), "page_key": F.concat(F.lit("key "), F.col("page_id") % 2)}), "id5", "agent", "key 0"
    ).select("page_id", "name")
)
query("find_by_name_ci", "SELECT chapter_id, book_id, name FROM kb_chapters WHERE lower(name) = 'building'")(lambda k: tables.by_name_ci(k.chapters, "bUilDing").select("chapter_id", "book_id", "name"))

# --- joins and the graph -------------------------------------------------------------------------------------------

query("join_chunk_page", "SELECT chunk_id, page_id, name FROM kb_chunks JOIN kb_pages USING (page_id)")(lambda k: k.chunks.select("chunk_id", "page_id").join(k.pages.select("page_id", "name"), "page_id"))
query("hash_lookups", f"WITH {HITS % 40} SELECT h.chunk_id, h.page_id, round(h.score, 4) AS score, p.name, c.chunk_index FROM hits h JOIN kb_pages p USING (page_id) JOIN kb_chunks c USING (chunk_id)")(
    lambda k: vectors.vector_topk(k.chunks, query_vector(k), 40, THRESHOLD).join(k.pages.select("page_id", "name"), "page_id").join(k.chunks.select("chunk_id", "chunk_index"), "chunk_id").select("chunk_id", "page_id", F.round("score", 4).alias("score"), "name", "chunk_index")
)
_RANKED = "SELECT page_id, neighbour_id, link_type FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY neighbour_id, link_type) AS r FROM ({}) WHERE neighbour_id IN (SELECT page_id FROM kb_pages)) WHERE r <= 20"
LINKED_FROM = _RANKED.format("SELECT target_page_id AS page_id, source_page_id AS neighbour_id, link_type FROM kb_relationships")
LINKS_TO = _RANKED.format("SELECT source_page_id AS page_id, target_page_id AS neighbour_id, link_type FROM kb_relationships")
CO_LINKED = """SELECT page_id, neighbour_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY neighbour_id) AS r FROM (SELECT DISTINCT a.source_page_id AS page_id, b.source_page_id AS neighbour_id
  FROM kb_relationships a JOIN kb_relationships b ON a.target_page_id = b.target_page_id AND a.source_page_id <> b.source_page_id WHERE b.source_page_id IN (SELECT page_id FROM kb_pages))) WHERE r <= 10"""
SIBLINGS = """SELECT page_id, neighbour_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY neighbour_id) AS r FROM (
  SELECT a.page_id, b.page_id AS neighbour_id FROM kb_pages a JOIN kb_pages b ON a.chapter_id = b.chapter_id AND a.page_id <> b.page_id AND NOT b.deleted
  UNION ALL SELECT a.page_id, b.page_id FROM kb_pages a JOIN kb_pages b ON a.book_id = b.book_id AND a.page_id <> b.page_id AND NOT b.deleted
    WHERE NOT EXISTS (SELECT 1 FROM kb_pages c WHERE c.chapter_id = a.chapter_id AND c.page_id <> a.page_id AND NOT c.deleted))) WHERE r <= 20"""
BLANKET = f"SELECT page_id, 'linked_from' AS relation, neighbour_id FROM ({LINKED_FROM}) UNION ALL SELECT page_id, 'links_to', neighbour_id FROM ({LINKS_TO}) UNION ALL SELECT page_id, 'co_linked', neighbour_id FROM ({CO_LINKED}) UNION ALL SELECT page_id, 'sibling', neighbour_id FROM ({SIBLINGS})"
query("join_linked_from", LINKED_FROM)(lambda k: graph.linked_from(k.relationships, k.pages))
query("join_links_to", LINKS_TO)(lambda k: graph.links_to(k.relationships, k.pages))
query("join_co_linked", CO_LINKED)(lambda k: graph.co_linked(k.relationships, k.pages))
query("join_siblings", SIBLINGS)(lambda k: graph.siblings(k.pages))
query("markov_blanket", BLANKET)(lambda k: graph.blanket(k.relationships, k.pages))
query("union_neighbours", f"SELECT page_id, neighbour_id, count(*) AS n FROM ({BLANKET}) GROUP BY page_id, neighbour_id")(
    lambda k: graph.times_named(graph.blanket(k.relationships, k.pages, k.pages), k.pages.count())
)
query("topk_per_group", f"SELECT page_id, count(*) AS n, min(neighbour_id) AS first_id FROM ({SIBLINGS}) GROUP BY page_id")(lambda k: graph.siblings(k.pages).groupBy("page_id").agg(F.count("*").alias("n"), F.min("neighbour_id").alias("first_id")))
CENTROID = "cen AS (SELECT page_id, list(x ORDER BY kk) AS centroid FROM (SELECT page_id, kk, avg(x::DOUBLE) AS x FROM (SELECT page_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS kk FROM kb_chunks) GROUP BY page_id, kk) GROUP BY page_id)"
query("agg_centroid", f"WITH {CENTROID} SELECT page_id, len(centroid)::INT AS dims, round(list_sum(centroid), 6) AS total, round(centroid[3], 6) AS third FROM cen")(
    lambda k: vectors.centroids(k.chunks).select("page_id", F.size("centroid").alias("dims"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col("centroid")[2], 6).alias("third"))
)
query(
    "join_similar_pages",
    f"WITH {CENTROID}, s AS (SELECT a.page_id, b.page_id AS similar_id, list_cosine_similarity(a.centroid, b.centroid) AS score FROM cen a JOIN cen b ON a.page_id <> b.page_id), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, similar_id) AS r FROM s WHERE score >= 0.2) SELECT page_id, similar_id, round(score, 4) AS score FROM r WHERE r <= 5",
)(lambda k: vectors.similar_pages(vectors.centroids(k.chunks), 5, 0.2).select("page_id", "similar_id", F.round("score", 4).alias("score")))
query("semi_role_match", "SELECT page_id, EXISTS (SELECT 1 FROM kb_page_view_acl a WHERE a.page_id = p.page_id AND role_id IN (1, 2)) AS matched FROM kb_pages p")(
    lambda k: k.pages.join(k.page_view_acl.filter(F.col("role_id").isin(ROLES)).select("page_id").distinct().withColumn("m", F.lit(True)), "page_id", "left").select("page_id", F.coalesce("m", F.lit(False)).alias("matched"))
)
query("agg_chapters_by_book", "SELECT book_id, string_agg(name, ',' ORDER BY name) AS chapters FROM kb_chapters GROUP BY book_id")(lambda k: k.chapters.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("chapters")))
query("agg_page_best_chunk", f"WITH {HITS % 40} SELECT page_id, round(max(score), 4) AS vector, arg_max(chunk_id, score) AS best_chunk, count(*)::INT AS n FROM hits GROUP BY page_id")(
    lambda k: search.best_chunks(vectors.vector_topk(k.chunks, query_vector(k), 40, THRESHOLD)).select("page_id", F.round("vector", 4).alias("vector"), "best_chunk", F.size("chunks").alias("n"))
)
query("agg_counts", "SELECT (SELECT count(*) FROM kb_pages) AS total_pages, (SELECT count(*) FROM kb_chunks) AS total_chunks, max(id) AS latest_job, arg_max(status, id) AS latest_status FROM kb_jobs")(lambda k: jobs.embed_status(k.pages, k.chunks, k.jobs))
query("embed_status", "SELECT (SELECT count(*) FROM kb_pages) AS total_pages, (SELECT count(*) FROM kb_chunks) AS total_chunks, max(id) AS latest_job, arg_max(status, id) AS latest_status FROM kb_jobs")(lambda k: jobs.embed_status(k.pages, k.chunks, k.jobs))
query("latest_per_key", "SELECT page_id, event_id, event, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM (SELECT item_id AS page_id, event_id, event, ts, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) AS r FROM kb_events) WHERE r = 1")(
    lambda k: tables.latest(k.events.select(F.col("item_id").alias("page_id"), "ts", "event_id", "event"), ["page_id"], "ts", "event_id").select("page_id", "event_id", "event", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
)

# --- search --------------------------------------------------------------------------------------------------------

query("cosine", "SELECT a.chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM kb_chunks a JOIN kb_chunks b ON b.chunk_id = a.chunk_id + 1")(
    lambda k: k.chunks.alias("a").join(k.chunks.alias("b"), F.col("b.chunk_id") == F.col("a.chunk_id") + 1).select(F.col("a.chunk_id").alias("chunk_id"), F.round(vectors.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("score"))
)
query("vector_topk", f"WITH {HITS % 20} SELECT chunk_id, page_id, round(score, 4) AS score FROM hits")(lambda k: vectors.vector_topk(k.chunks, query_vector(k), 20, THRESHOLD).select("chunk_id", "page_id", F.round("score", 4).alias("score")))
_PAGES = "pv AS (SELECT page_id, max(score) AS vector FROM hits GROUP BY page_id)"
query("trim_pool", f"WITH {HITS % 40}, {_PAGES} SELECT page_id, round(vector, 4) AS vector FROM pv ORDER BY pv.vector DESC, page_id LIMIT 12")(
    lambda k: search.trim_pool(search.best_chunks(vectors.vector_topk(k.chunks, query_vector(k), 40, THRESHOLD)), 12).select("page_id", F.round("vector", 4).alias("vector"))
)
query("trim_pool_by_blend", f"WITH {HITS % 40}, {_PAGES}, {_KEYWORD} SELECT page_id, round(0.6 * vector + 0.4 * coalesce(keyword, 0), 4) AS blend FROM pv LEFT JOIN kw USING (page_id) ORDER BY 0.6 * vector + 0.4 * coalesce(keyword, 0) DESC, page_id LIMIT 12")(
    lambda k: search.trim_pool(
        search.best_chunks(vectors.vector_topk(k.chunks, query_vector(k), 40, THRESHOLD)).join(search.keyword_decay(k.keyword_hits), "page_id", "left").withColumn("b", 0.6 * F.col("vector") + 0.4 * F.coalesce("keyword", F.lit(0.0))), 12, F.col("b")
    ).select("page_id", F.round("b", 4).alias("blend"))
)
query("recent_pages", "SELECT page_id FROM kb_pages LEFT JOIN kb_page_updates USING (page_id) WHERE book_id = 3 ORDER BY updated_at DESC NULLS LAST, page_id LIMIT 15")(
    lambda k: tables.recent(tables.by_id(k.pages, "book_id", 3), k.page_updates, 15).select("page_id")
)
query("paged_list", "SELECT page_id, name FROM kb_pages ORDER BY name, page_id LIMIT 20 OFFSET 40")(lambda k: tables.window_of(k.pages, ["name", "page_id"], 20, 40).select("page_id", "name"))
query("blend_standard", f"WITH {HITS % 40}, {_PAGES}, {_KEYWORD}, m AS (SELECT page_id, coalesce(vector, 0) AS v, coalesce(keyword, 0) AS kk FROM pv FULL JOIN kw USING (page_id)) SELECT page_id, round(CASE WHEN v > 0 AND kk > 0 THEN 0.7 * v + 0.2 * kk + 0.05 ELSE v + 0.05 END, 4) AS score FROM m")(
    lambda k: search.merged_scores(search.best_chunks(vectors.vector_topk(k.chunks, query_vector(k), 40, THRESHOLD)), search.keyword_decay(k.keyword_hits)).select("page_id", F.round(search.standard_blend(F.col("vector"), F.col("keyword"), F.lit(0.05)), 4).alias("score"))
)
query("filter_keyword_only", f"WITH {HITS % 40}, {_PAGES}, {_KEYWORD} SELECT page_id FROM pv")(
    lambda k: search.keyword_only_dropped(search.merged_scores(search.best_chunks(vectors.vector_topk(k.chunks, query_vector(k), 40, THRESHOLD)), search.keyword_decay(k.keyword_hits))).select("page_id")
)
_VERDICT = "verdict AS (SELECT p.page_id, CASE WHEN acl_computed_at IS NULL THEN 'uncomputed' WHEN acl_default_open THEN 'default_open' WHEN EXISTS (SELECT 1 FROM kb_page_view_acl a WHERE a.page_id = p.page_id AND role_id IN (1, 2)) THEN 'allow' ELSE 'deny' END AS verdict FROM kb_pages p)"
_SCORED = f"""scored AS (SELECT page_id, coalesce(vector, 0) AS vector, coalesce(keyword, 0) AS keyword FROM pv FULL JOIN kw USING (page_id) WHERE page_id NOT IN (SELECT page_id FROM verdict WHERE verdict = 'deny')),
 nb AS ({BLANKET}), sw AS (SELECT s.page_id, coalesce(sum((n.neighbour_id IN (SELECT page_id FROM scored))::INT), 0) AS strong,
  coalesce(sum((n.neighbour_id NOT IN (SELECT page_id FROM scored) AND n.neighbour_id IN (SELECT page_id FROM hits))::INT), 0) AS weak FROM scored s LEFT JOIN nb n USING (page_id) GROUP BY s.page_id),
 bl AS (SELECT page_id, strong, weak, least(0.05 * strong, 0.15) + least(0.02 * weak, 0.06) AS blanket FROM sw)"""
_HYBRID = f"{HITS % 20}, {_PAGES}, {_KEYWORD}, {_VERDICT}, {_SCORED}"


def _scored(k: Knowledge) -> tuple[DataFrame, DataFrame]:
    hits = vectors.vector_topk(k.chunks, query_vector(k), 2 * LIMIT, THRESHOLD)
    return settled(search.visible(search.merged_scores(search.best_chunks(hits), search.keyword_decay(k.keyword_hits)), k.pages, k.page_view_acl, ROLES)), pool(hits, 2 * LIMIT)


query("agg_strong_weak", f"WITH {_HYBRID} SELECT page_id, strong::BIGINT AS strong, weak::BIGINT AS weak FROM bl WHERE strong + weak > 0")(
    lambda k: (lambda s, h: graph.strong_weak(graph.blanket(k.relationships, k.pages, s), s, h))(*_scored(k))
)
query("blanket_boost", f"WITH {_HYBRID} SELECT page_id, round(blanket::DOUBLE, 4) AS blanket FROM bl")(lambda k: (lambda s, h: search.boosts(k.relationships, k.pages, s, h).select("page_id", F.round("blanket", 4).alias("blanket")))(*_scored(k)))
query("intersect_allowed", f"WITH {HITS % 20}, {_PAGES}, {_VERDICT} SELECT page_id FROM pv WHERE page_id NOT IN (SELECT page_id FROM verdict WHERE verdict = 'deny')")(
    lambda k: search.visible(search.best_chunks(vectors.vector_topk(k.chunks, query_vector(k), 20, THRESHOLD)), k.pages, k.page_view_acl, ROLES).select("page_id")
)
def first_hits(sql: str, n: int) -> str:
    """A search takes the first hits of the keyword list; above, the list has no more."""
    return sql.replace("FROM kb_keyword_hits", f"FROM kb_keyword_hits WHERE pos < {n}")


_FINAL = f"""WITH {_HYBRID}, fin AS (SELECT page_id, vector, keyword, blanket, CASE WHEN vector > 0 AND keyword > 0 THEN 0.7 * vector + 0.2 * keyword + blanket ELSE vector + blanket END AS score
 FROM scored JOIN bl USING (page_id) WHERE vector > 0 OR keyword = 0 ORDER BY score DESC, page_id LIMIT 10)"""
query("hybrid_search", first_hits(f"{_FINAL} SELECT page_id, round(vector, 4) AS vector, round(keyword, 4) AS keyword, round(blanket::DOUBLE, 4) AS blanket, round(score, 4) AS score FROM fin", 20))(
    lambda k: search.hybrid_search(k.chunks, k.pages, k.relationships, k.page_view_acl, k.keyword_hits, query_vector(k), LIMIT, THRESHOLD, ROLES).select("page_id", *[F.round(c, 4).alias(c) for c in ("vector", "keyword", "blanket", "score")])
)
query("final_topn", f"WITH {HITS % 40}, {_PAGES}, {_KEYWORD} SELECT page_id, round(CASE WHEN coalesce(vector, 0) > 0 AND keyword > 0 THEN 0.7 * vector + 0.2 * keyword ELSE coalesce(vector, 0) END, 4) AS score FROM pv FULL JOIN kw USING (page_id) ORDER BY CASE WHEN coalesce(vector, 0) > 0 AND keyword > 0 THEN 0.7 * vector + 0.2 * keyword ELSE coalesce(vector, 0) END DESC, page_id LIMIT 25")(
    lambda k: search.final_top(
        search.merged_scores(search.best_chunks(vectors.vector_topk(k.chunks, query_vector(k), 40, THRESHOLD)), search.keyword_decay(k.keyword_hits)).withColumn("score", search.standard_blend(F.col("vector"), F.col("keyword"), F.lit(0.0))), 25
    ).select("page_id", F.round("score", 4).alias("score"))
)
def chunk_texts(k: Knowledge) -> DataFrame:
    return k.chunks.select("chunk_id", F.concat(F.lit("Part "), F.col("chunk_index") + 1).alias("heading_path"), F.concat(F.lit("text of "), "chunk_id").alias("content"))


# The JSON, taken apart again.
_SHOWN = f"""{_FINAL}, ch AS (SELECT h.*, chunk_index, row_number() OVER (PARTITION BY h.page_id ORDER BY h.score DESC, h.chunk_id) AS r, count(*) OVER (PARTITION BY h.page_id) AS n FROM hits h JOIN kb_chunks USING (chunk_id))
 SELECT f.page_id, p.name AS page_name, p.book_id, round(f.score, 3) AS score, round(vector, 3) AS vector, round(keyword, 3) AS keyword, round(blanket::DOUBLE, 3) AS blanket_boost, n::INT AS n_chunks, 'Part ' || (chunk_index + 1) AS heading_path, 'text of ' || chunk_id AS content,
  round(ch.score, 3) AS chunk_score, strftime(updated_at, '%Y-%m-%d') AS updated_at, coalesce((SELECT count(*) FROM nb WHERE nb.page_id = f.page_id AND relation = 'sibling'), 0)::INT AS n_siblings
 FROM fin f JOIN kb_pages p USING (page_id) JOIN ch ON ch.page_id = f.page_id AND r = 1 LEFT JOIN kb_page_updates u ON u.page_id = f.page_id"""


@query("project_result_json", first_hits(_SHOWN, 20))
def _(k):
    found = settled(search.hybrid_search(k.chunks, k.pages, k.relationships, k.page_view_acl, k.keyword_hits, query_vector(k), LIMIT, THRESHOLD, ROLES))
    updates = k.page_updates.select("page_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at"))
    rows = search.result_json(found, k.pages, chunk_texts(k), updates, graph.blanket(k.relationships, k.pages, found))
    one = "struct<heading_path: string, content: string, score: double>"
    near = "array<struct<page_id: bigint, name: string>>"
    kind = f"page_id bigint, page_name string, book_id bigint, score double, chunks array<{one}>, scoring struct<vector: double, keyword: double, blanket_boost: double>, updated_at string, blanket struct<siblings: {near}>"
    r = rows.select(F.from_json("result", kind).alias("r")).select("r.*")
    first = F.col("chunks")[0]
    return r.select(
        "page_id", "page_name", "book_id", "score", "scoring.vector", "scoring.keyword", "scoring.blanket_boost", F.size("chunks").alias("n_chunks"), first["heading_path"].alias("heading_path"), first["content"].alias("content"), first["score"].alias("chunk_score"),
        "updated_at", F.coalesce(F.size("blanket.siblings"), F.lit(0)).alias("n_siblings"),
    )


_SCOPED = first_hits(_FINAL, 20).replace("FROM kb_chunks\n  WHERE list_cosine", "FROM kb_chunks\n  WHERE page_id IN (SELECT page_id FROM kb_pages WHERE book_id < 12) AND list_cosine").replace("WHERE kind = 'page' AND page_id <> 0", "WHERE kind = 'page' AND page_id <> 0 AND page_id IN (SELECT page_id FROM kb_pages WHERE book_id < 12)")
query("hybrid_search_scoped", f"{_SCOPED} SELECT page_id, round(vector, 4) AS vector, round(keyword, 4) AS keyword, round(blanket::DOUBLE, 4) AS blanket, round(score, 4) AS score FROM fin")(
    lambda k: search.hybrid_search(k.chunks, k.pages, k.relationships, k.page_view_acl, k.keyword_hits, query_vector(k), LIMIT, THRESHOLD, ROLES, search.Scope(books=tuple(range(12)))).select("page_id", *[F.round(c, 4).alias(c) for c in ("vector", "keyword", "blanket", "score")])
)
_CASCADE = f"""WITH {HITS % 40}, {_PAGES}, {_KEYWORD}, {_VERDICT}, st1 AS (SELECT * FROM pv ORDER BY vector DESC, page_id LIMIT 40),
 st2 AS (SELECT page_id, vector, coalesce(keyword, 0) AS keyword FROM st1 LEFT JOIN kw USING (page_id) ORDER BY 0.6 * vector + 0.4 * coalesce(keyword, 0) DESC, page_id LIMIT 30),
 scored AS (SELECT * FROM st2 WHERE page_id NOT IN (SELECT page_id FROM verdict WHERE verdict = 'deny')), nb AS ({BLANKET}),
 sw AS (SELECT s.page_id, coalesce(sum((n.neighbour_id IN (SELECT page_id FROM scored))::INT), 0) AS strong,
  coalesce(sum((n.neighbour_id NOT IN (SELECT page_id FROM scored) AND n.neighbour_id IN (SELECT page_id FROM hits))::INT), 0) AS weak FROM scored s LEFT JOIN nb n USING (page_id) GROUP BY s.page_id)
 SELECT page_id, round(0.55 * vector + 0.25 * keyword + least(0.05 * strong, 0.15) + least(0.02 * weak, 0.06), 4) AS score FROM scored JOIN sw USING (page_id)
 ORDER BY 0.55 * vector + 0.25 * keyword + least(0.05 * strong, 0.15) + least(0.02 * weak, 0.06) DESC, page_id LIMIT 20"""
query("cascade_stages", first_hits(_CASCADE, 40))(
    lambda k: search.cascade_stages(k.chunks, k.pages, k.relationships, k.page_view_acl, k.keyword_hits, query_vector(k), LIMIT, THRESHOLD, ROLES)[2].select("page_id", F.round("score", 4).alias("score"))
)
# The reranker of the query counts how many of its words a document has: the page's name, or its number, is one of them or not.
_WORDS = "customer 000000000 000000007 000000022 text"
_RERANKED = """SELECT page_id, round(rerank, 4) AS rerank, round(score, 4) AS score FROM (SELECT page_id, score, (1 + (lower(name) LIKE '%000000000' OR lower(name) LIKE '%000000007' OR lower(name) LIKE '%000000022')::INT + (page_id % 2 = 0)::INT) / 5.0 AS rerank
 FROM ({}) AS third JOIN kb_pages USING (page_id)) ORDER BY rerank DESC, score DESC, page_id LIMIT 10"""
query("cascade_precision", (lambda stages: stages.replace("\n SELECT page_id, round(", ", third AS (SELECT page_id, (").replace(", 4) AS score FROM scored", ") AS score FROM scored") + ") " + _RERANKED.format("SELECT * FROM third"))(first_hits(_CASCADE, 40)))(
    lambda k: search.cascade(
        k.chunks, k.chunks.select("chunk_id", F.lit("").alias("heading"), F.when(F.col("page_id") % 2 == 0, "text").otherwise("none").alias("content")), k.pages, k.relationships, k.page_view_acl, k.keyword_hits, query_vector(k), _WORDS, LIMIT, THRESHOLD, ROLES
    ).select("page_id", F.round("rerank", 4).alias("rerank"), F.round("score", 4).alias("score"))
)
query(
    "keyword_search",
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM documents),
 r AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'idiot')) AS t0, len(list_filter(w, lambda x: x = 'scum')) AS t1, len(list_filter(w, lambda x: x = 'the')) AS t2 FROM t),
 s AS (SELECT count(*) AS n, avg(n) AS a, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1, sum((t2 > 0)::INT) AS d2 FROM r)
 SELECT doc_id, round(ln(1 + (s.n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * r.n / a)) + ln(1 + (s.n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * r.n / a))
  + ln(1 + (s.n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * r.n / a)), 4) AS score FROM r, s WHERE t0 + t1 + t2 > 0""",
)(lambda k: search.bm25(k.base("documents"), "the idiot scum").select("doc_id", F.round("score", 4).alias("score")))
query("rerank_doc", "SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN concat(name, chr(10), chr(10), 'text ', chunk_id) ELSE concat(name, ' — ', slug, chr(10), chr(10), 'text ', chunk_id) END AS doc FROM kb_chunks JOIN kb_pages USING (page_id)")(
    lambda k: k.chunks.join(k.pages, "page_id").select("chunk_id", search.rerank_document(F.col("name"), F.when(F.col("chunk_id") % 3 != 0, F.col("slug")), F.concat(F.lit("text "), F.col("chunk_id"))).alias("doc"))
)
query("trim_match", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS shown, length(text) > 200 AS truncated FROM documents")(
    lambda k: k.base("documents").select("doc_id", search.trim_match(F.col("text")).alias("m")).select("doc_id", F.col("m.text").alias("shown"), "m.truncated")
)

# --- permissions ---------------------------------------------------------------------------------------------------

query("acl_prefilter", f"WITH {_VERDICT} SELECT page_id, verdict FROM verdict")(lambda k: acl.prefilter(k.pages, k.page_view_acl, ROLES))
query("acl_list", "SELECT page_id FROM kb_pages WHERE acl_computed_at IS NOT NULL")(lambda k: acl.computed(k.pages))
query("acl_delete_page", "SELECT page_id, role_id FROM kb_page_view_acl WHERE page_id NOT IN (1, 2, 3)")(lambda k: acl.delete_page(k.page_view_acl, [1, 2, 3]))
query("acl_delete_role", "SELECT page_id, role_id FROM kb_page_view_acl WHERE role_id <> 2")(lambda k: acl.delete_role(k.page_view_acl, 2))
query("acl_upsert", "SELECT page_id, role_id FROM kb_page_view_acl WHERE page_id >= 30 UNION ALL SELECT page_id, 7 FROM kb_pages WHERE page_id < 30")(
    lambda k: acl.acl_upsert(k.page_view_acl, k.pages, k.pages.filter("page_id < 30").select("page_id", F.lit(7).cast("long").alias("role_id")), 99)[0]
)


def levels(k: Knowledge) -> DataFrame:
    """Made-up permissions: every fifth page, every third chapter and every second book has its own."""

    def own(df: DataFrame, kind: str, key: str, step: int) -> DataFrame:
        i = F.col(key)
        return df.select(F.lit(kind).alias("kind"), i.alias("level_id"), F.when(i % 2 == 0, i % step != 0).alias("inheriting"), F.array(i % 4, i % 4 + 4).alias("roles"))

    return own(k.pages, "page", "page_id", 10).unionByName(own(k.chapters, "chapter", "chapter_id", 6)).unionByName(own(k.books, "book", "book_id", 4))


_RESOLVE = """SELECT page_id, r IS NULL AS default_open, coalesce(r, '[1, 3]') AS roles FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN [page_id % 4, page_id % 4 + 4]::VARCHAR
 WHEN chapter_id % 6 = 0 THEN [chapter_id % 4, chapter_id % 4 + 4]::VARCHAR WHEN book_id % 4 = 0 THEN [book_id % 4, book_id % 4 + 4]::VARCHAR END AS r FROM kb_pages {})"""


def _everyone(k: Knowledge) -> DataFrame:
    return acl.role_context(k.spark.createDataFrame([(0, ["page-update"]), (1, ["content-export"]), (2, ["bookshelf-view-all"]), (3, ["book-view-all", "x"])], "role_id long, permissions array<string>"))


def _resolved(k: Knowledge, pages: DataFrame) -> DataFrame:
    return acl.resolve(pages, levels(k), _everyone(k)).select("page_id", "default_open", F.col("roles").cast("string").alias("roles"))


query("acl_resolve", _RESOLVE.format(""))(lambda k: _resolved(k, k.pages))
query("acl_reconcile_all", f"WITH r AS ({_RESOLVE.format('WHERE acl_computed_at IS NOT NULL')}) SELECT page_id, default_open, 99 AS computed_at, CASE WHEN default_open THEN '[]' ELSE roles END AS role_rows FROM r")(lambda k: _reconciled(k, acl.computed(k.pages)))


def _reconciled(k: Knowledge, wanted: DataFrame) -> DataFrame:
    rows, pages = acl.reconcile(k.page_view_acl, k.pages.join(wanted, "page_id", "left_semi"), levels(k), _everyone(k), 99)
    of = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("role_id")).cast("string").alias("role_rows"))
    return pages.join(of, "page_id", "left").select("page_id", F.col("acl_default_open").alias("default_open"), F.col("acl_computed_at").cast("int").alias("computed_at"), F.coalesce("role_rows", F.lit("[]")).alias("role_rows"))


query("acl_reconcile_page", _RESOLVE.format("WHERE page_id = 30"))(lambda k: _resolved(k, k.pages.filter("page_id = 30")))
query("acl_inheriting", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id % 10 <> 0 ELSE true END AS inheriting FROM kb_pages")(lambda k: levels(k).filter("kind = 'page'").select(F.col("level_id").alias("page_id"), acl.inheriting().alias("inheriting")))
query("acl_role_context", "SELECT role_id FROM (SELECT DISTINCT page_id % 7 AS role_id FROM kb_pages) WHERE role_id IN (1, 2, 3, 4)")(
    lambda k: acl.role_context(
        k.pages.select((F.col("page_id") % 7).alias("role_id")).distinct().withColumn(
            "permissions", F.element_at(F.array(*[F.array(F.lit("page-update"), F.lit(p)) for p in ("bookshelf-view-all", "page-view-all", "chapter-view-all", "book-view-all", "content-export", "page-view-own", "users-manage")]), (F.col("role_id") + 1).cast("int"))
        )
    )
)
# Every tenth caller could not be identified: that is no empty list of roles.
query("acl_caller_roles", "SELECT CAST(c_custkey AS BIGINT) AS caller, CASE WHEN c_custkey % 10 <> 9 THEN count(o_orderkey)::INT END AS n_roles, CASE WHEN c_custkey % 10 <> 9 THEN coalesce(min(o_orderkey), -1) END AS first_role FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey")(
    lambda k: acl.caller_roles(
        k.base("customer").select(F.col("c_custkey").cast("long").alias("caller"), (F.col("c_custkey") % 10 != 9).alias("identified")), k.base("orders").select(F.col("o_custkey").cast("long").alias("caller"), F.col("o_orderkey").alias("role_id"))
    ).select("caller", F.when(F.col("roles").isNotNull(), F.size("roles")).alias("n_roles"), F.when(F.col("roles").isNotNull(), F.coalesce(F.try_element_at("roles", F.lit(1)), F.lit(-1))).alias("first_role"))
)
query("acl_recompute_async", "SELECT page_id FROM kb_pages WHERE acl_computed_at IS NULL AND page_id % 3 <> 0 ORDER BY page_id LIMIT (SELECT greatest(0, 200 - count(*)) FROM kb_pages WHERE page_id % 3 = 0 AND page_id < 150)")(
    lambda k: acl.to_recompute(k.pages.filter("page_id % 3 <> 0"), k.pages.filter("page_id % 3 = 0 AND page_id < 150").select("page_id"))
)
query("coalesce_check", "SELECT event_id, coalesce(CASE WHEN item_id % 4 <> 3 THEN item_id % 2 = 0 END, false) AS ok FROM kb_events")(
    lambda k: acl.coalesced_check(k.events.select("event_id", (F.col("item_id") % 5).cast("string").alias("token"), F.col("item_id").alias("page_id")), lambda asked: asked.filter("page_id % 4 <> 3").withColumn("ok", F.col("page_id") % 2 == 0)).select("event_id", "ok")
)
query("agg_effective_roles", "SELECT book_id AS level_id, list_sort(list_filter([0, 1, 2, 3], lambda r: CASE WHEN r = book_id % 4 THEN book_id % 3 = 0 ELSE book_id % 2 = 0 END))::VARCHAR AS roles FROM kb_books")(
    lambda k: acl.effective_roles(
        k.books.select(F.col("book_id").alias("level_id"), (F.col("book_id") % 2 == 0).alias("fallback_view")),
        k.books.select(F.col("book_id").alias("level_id"), (F.col("book_id") % 4).alias("role_id"), (F.col("book_id") % 3 == 0).alias("view"), F.lit(2).alias("ord")).unionByName(k.books.select(F.col("book_id").alias("level_id"), (F.col("book_id") % 4).alias("role_id"), F.lit(True).alias("view"), F.lit(1).alias("ord"))),
        k.spark.range(4).select(F.col("id").alias("role_id")),
    ).select("level_id", F.col("roles").cast("string").alias("roles"))
)
query(
    "acl_filter_ladder",
    f"""WITH {_VERDICT}, l1 AS (SELECT page_id, page_id % 2 = 0 AS v FROM kb_pages WHERE page_id % 7 = 0 AND 1000 + page_id >= 1050), l2 AS (SELECT page_id, viewable AS v FROM ({_CACHE}) WHERE cached_at >= 1300 AND page_id % 5 = 0)
 SELECT p.page_id, coalesce(l1.v, l2.v, CASE verdict WHEN 'allow' THEN true WHEN 'deny' THEN false END, CASE WHEN p.page_id % 3 = 1 THEN p.page_id % 2 = 1 END, false) AS viewable,
 CASE WHEN l1.v IS NOT NULL THEN 'memory' WHEN l2.v IS NOT NULL THEN 'table' WHEN verdict IN ('allow', 'deny') THEN 'prefilter' ELSE 'check' END AS decided_by FROM kb_pages p LEFT JOIN l1 USING (page_id) LEFT JOIN l2 USING (page_id) JOIN verdict USING (page_id)""",
)(
    lambda k: acl.ladder(
        k.pages,
        k.pages.filter("page_id % 7 = 0").select("page_id", (F.col("page_id") % 2 == 0).alias("viewable"), (F.col("page_id") + 1000).alias("cached_at")),
        cache_table(k).filter("page_id % 5 = 0"),
        k.pages,
        k.page_view_acl,
        ROLES,
        k.pages.filter("page_id % 3 = 1").select("page_id", (F.col("page_id") % 2 == 1).alias("ok")),
        1050,
        1300,
    )
)

# --- the tree ------------------------------------------------------------------------------------------------------

TREE = """nodes AS (SELECT 'shelf' AS kind, shelf_id AS id, CAST(NULL AS VARCHAR) AS parent_kind, CAST(NULL AS BIGINT) AS parent_id, name FROM kb_shelves WHERE NOT deleted
 UNION ALL SELECT DISTINCT 'shelf', 0::BIGINT, NULL, NULL, 'Unshelved' FROM kb_books WHERE NOT deleted AND shelf_id IS NULL
 UNION ALL SELECT 'book', book_id, 'shelf', coalesce(shelf_id, 0), name FROM kb_books WHERE NOT deleted UNION ALL SELECT 'chapter', chapter_id, 'book', book_id, name FROM kb_chapters WHERE NOT deleted
 UNION ALL SELECT 'page', page_id, CASE WHEN chapter_id IS NULL THEN 'book' ELSE 'chapter' END, coalesce(chapter_id, book_id), name FROM kb_pages WHERE NOT deleted),
 tree AS (SELECT kind, id, parent_kind, parent_id, name, 0 AS level FROM nodes WHERE {root} UNION ALL SELECT n.kind, n.id, n.parent_kind, n.parent_id, n.name, t.level + 1 FROM nodes n JOIN (SELECT DISTINCT kind, id, level FROM tree) t ON n.parent_kind = t.kind AND n.parent_id = t.id WHERE t.level < {depth})"""
_TREE_COLUMNS = ["kind", "id", "parent_kind", "parent_id", "name", "level"]


def subtree(k: Knowledge, kind: str, id: int, depth: int | None = None) -> DataFrame:
    return tree.directory(tree.nodes(*tree.below(k.shelves, k.books, k.chapters, k.pages, kind, id)), kind, id, depth)


def nodes(k: Knowledge) -> DataFrame:
    # The fixture has a shelf 0 of its own, which shares its books with the made-up one.
    return tree.nodes(k.shelves, k.books, k.chapters, k.pages)


query("directory_tree", f"WITH RECURSIVE {TREE.format(root=chr(39).join(['kind = ', 'book', ' AND id = 7']), depth=3)} SELECT {', '.join(_TREE_COLUMNS)} FROM tree")(lambda k: subtree(k, "book", 7).select(*_TREE_COLUMNS))
query("directory_tree_depth", f"WITH RECURSIVE {TREE.format(root=chr(39).join(['kind = ', 'shelf', ' AND id = 2']), depth=2)} SELECT {', '.join(_TREE_COLUMNS)} FROM tree")(lambda k: subtree(k, "shelf", 2, 2).select(*_TREE_COLUMNS))
query("tree_collect_pages", f"WITH RECURSIVE {TREE.format(root=chr(39).join(['kind = ', 'book', ' AND id = 7']), depth=3)} SELECT id AS page_id FROM tree WHERE kind = 'page'")(lambda k: tree.pages_of(subtree(k, "book", 7)))
query(
    "tree_acl_prune",
    f"WITH RECURSIVE {TREE.format(root=chr(39).join(['kind = ', 'book', '']), depth=3)}, ok AS (SELECT * FROM tree WHERE kind = 'page' AND id % 40 = 1), c AS (SELECT * FROM tree t WHERE kind = 'chapter' AND (id IN (SELECT parent_id FROM ok WHERE parent_kind = 'chapter') OR id NOT IN (SELECT parent_id FROM tree WHERE parent_kind = 'chapter'))), b AS (SELECT * FROM tree t WHERE kind = 'book' AND (id IN (SELECT parent_id FROM ok WHERE parent_kind = 'book' UNION SELECT parent_id FROM c) OR id NOT IN (SELECT parent_id FROM tree WHERE parent_kind = 'book'))) SELECT kind, id FROM ok UNION ALL SELECT kind, id FROM c UNION ALL SELECT kind, id FROM b",
)(lambda k: tree.prune(nodes(k).filter("kind = 'book' OR in_book IS NOT NULL"), k.pages.filter("page_id % 40 = 1")).select("kind", "id"))


query("tree_to_json")(lambda k: tree.to_json(subtree(k, "shelf", 2)))
query(
    "outline_text",
    """WITH ch AS (SELECT book_id, string_agg('    Chapter: ' || name || ' (ID: ' || chapter_id || ')' || CASE WHEN chapter_id % 2 = 0 THEN ' — about ' || slug ELSE '' END || chr(10), '' ORDER BY name, chapter_id) AS lines FROM kb_chapters WHERE NOT deleted GROUP BY book_id),
 bo AS (SELECT shelf_id, string_agg('  Book: ' || name || ' (ID: ' || book_id || ')' || CASE WHEN book_id % 2 = 0 THEN ' — about ' || slug ELSE '' END || chr(10) || coalesce(lines, ''), '' ORDER BY name, book_id) AS lines FROM kb_books LEFT JOIN ch USING (book_id) WHERE NOT deleted AND shelf_id IS NOT NULL GROUP BY shelf_id)
 SELECT shelf_id, 'Shelf: ' || name || ' (ID: ' || shelf_id || ')' || CASE WHEN shelf_id % 2 = 0 THEN ' — about ' || slug ELSE '' END || chr(10) || coalesce(lines, '') || chr(10) AS outline FROM kb_shelves LEFT JOIN bo USING (shelf_id) WHERE NOT deleted""",
)(lambda k: tree.outline(*[df.withColumn("description", F.when(F.col(key) % 2 == 0, F.concat(F.lit("<p>about \n "), "slug", F.lit("</p>")))) for df, key in ((k.shelves, "shelf_id"), (k.books, "book_id"), (k.chapters, "chapter_id"))]))
query("union_unshelved", "SELECT shelf_id, name FROM kb_shelves WHERE NOT deleted UNION ALL SELECT DISTINCT 0::BIGINT, 'Unshelved' FROM kb_books WHERE NOT deleted AND shelf_id IS NULL")(lambda k: nodes(k).filter("kind = 'shelf'").select(F.col("id").alias("shelf_id"), "name"))
