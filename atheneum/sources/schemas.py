"""The tables' schemas. Tables are read and written with these, never inferred; a change of a schema is a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1
SCHEMAS = {
    "shelves": "shelf_id bigint, name string, slug string, shelf_kind string, indexed_at bigint, deleted boolean",
    "books": "book_id bigint, name string, slug string, shelf_id bigint, identity_ouid string, book_kind string, indexed_at bigint, deleted boolean",
    "chapters": "chapter_id bigint, book_id bigint, name string, slug string, identity_ouid string, chapter_kind string, archive_year int, indexed_at bigint, deleted boolean",
    "index_pages": "page_id bigint, book_id bigint, chapter_id bigint, name string, slug string, url string, page_created_at timestamp, page_updated_at timestamp, identity_ouid string, page_kind string, page_key string, archive_year int, indexed_at bigint, deleted boolean",
    "page_cache": "page_id bigint, markdown string, raw_markdown string, html string, cached_at bigint, page_updated_at timestamp",
    "pages": "page_id bigint, book_id bigint, chapter_id bigint, name string, slug string, content_hash string, embedded_at bigint, updated_at timestamp, acl_default_open boolean, acl_computed_at bigint",
    "chunks": "chunk_id bigint, page_id bigint, chunk_index int, heading_path string, content string, content_hash string, embedding array<float>",
    "relationships": "source_page_id bigint, target_page_id bigint, link_type string",
    "page_view_acl": "page_id bigint, role_id bigint",
    "permission_cache": "token_hash string, page_id bigint, viewable boolean, cached_at bigint",
    "jobs": "id bigint, scope string, kind string, status string, triggered_by string, started_at bigint, finished_at bigint, progress bigint, total bigint, error string, worker_id string, resolved_status string, prev_status string, resolved_at bigint, retry_of bigint",
    "meta": "key string, value string, version bigint",
}
KEYS = {"shelves": ["shelf_id"], "books": ["book_id"], "chapters": ["chapter_id"], "index_pages": ["page_id"], "pages": ["page_id"], "chunks": ["page_id", "chunk_index"], "relationships": ["source_page_id", "target_page_id", "link_type"], "page_view_acl": ["page_id", "role_id"], "permission_cache": ["token_hash", "page_id"], "jobs": ["id"]}


def init(store) -> None:
    """Publishes an empty snapshot of each table that has none; running it again changes nothing."""
    for name, schema in SCHEMAS.items():
        try:
            store.read(name)
        except LookupError:
            store.publish(name, store.spark.createDataFrame([], schema))
    store.set("schema_version", VERSION)


def altered_width(chunks: DataFrame, dims: int) -> DataFrame:
    """The chunks' next snapshot for vectors of ``dims`` components: all of them if each has that many, none otherwise, as they have to be made again."""
    return chunks if wrong_width(chunks, dims).isEmpty() else chunks.limit(0)


def wrong_width(chunks: DataFrame, dims: int) -> DataFrame:
    """Chunks whose vectors do not have ``dims`` components."""
    return chunks.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dims).select("chunk_id")
