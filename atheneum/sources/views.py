"""Knowledge-base tables derived from the base tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Base tables are written {name}; other views by their name.
VIEWS: dict[str, str] = {
    "kb_shelves": """SELECT CAST(r_regionkey AS BIGINT) AS shelf_id, r_name AS name, lower(replace(r_name, ' ', '-')) AS slug, 'unclassified' AS shelf_kind,
        CAST(1 AS BIGINT) AS indexed_at, false AS deleted FROM {region}""",
    "kb_books": """SELECT CAST(n_nationkey AS BIGINT) AS book_id, n_name AS name, lower(replace(n_name, '_', '-')) AS slug,
        CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS shelf_id, (n_nationkey % 12 = 11) AS deleted FROM {nation}""",
    "kb_pages": """SELECT CAST(c_custkey AS BIGINT) AS page_id, CAST(c_nationkey AS BIGINT) AS book_id,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) * 5 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
          WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END END AS chapter_id,
        c_name AS name, lower(replace(c_name, '#', '-')) AS slug, (c_custkey % 53 = 52) AS deleted,
        CASE WHEN c_custkey % 11 = 10 THEN NULL ELSE CAST(1 AS BIGINT) END AS acl_computed_at, (c_custkey % 5 = 0) AS acl_default_open FROM {customer}""",
    "kb_chapters": """SELECT DISTINCT CAST(c_nationkey AS BIGINT) * 5 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
        WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS chapter_id, CAST(c_nationkey AS BIGINT) AS book_id, c_mktsegment AS name, lower(c_mktsegment) AS slug, false AS deleted FROM {customer}""",
    # Three vectors a page, as far as they go.
    "kb_chunks": """SELECT CAST(vec_id AS BIGINT) AS chunk_id, CAST(floor(vec_id / 3) AS BIGINT) % (SELECT count(*) FROM {customer}) AS page_id,
        CAST(vec_id % 3 AS BIGINT) + 3 * CAST(floor(vec_id / (3 * (SELECT count(*) FROM {customer}))) AS BIGINT) AS chunk_index, embedding FROM {embeddings}""",
    # Each order is a link and a job.
    "kb_relationships": """SELECT DISTINCT CAST(o_custkey AS BIGINT) AS source_page_id, CAST((o_orderkey * 31 + 7) % (SELECT count(*) FROM {customer}) AS BIGINT) AS target_page_id,
        CASE WHEN o_orderkey % 3 = 0 THEN 'similar' ELSE 'link' END AS link_type FROM {orders}""",
    "kb_page_view_acl": """SELECT page_id, page_id % 4 AS role_id FROM kb_pages WHERE NOT acl_default_open AND acl_computed_at IS NOT NULL""",
    "kb_jobs": """SELECT CAST(o_orderkey AS BIGINT) AS id, concat('book:', CAST(o_custkey % 25 AS VARCHAR(9))) AS scope,
        CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderpriority = '1-URGENT' THEN 'failed'
          WHEN o_orderpriority = '5-LOW' THEN 'cancelled' ELSE 'succeeded' END AS status,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey - 1 AS BIGINT) END AS retry_of,
        CAST(1000 + o_orderkey AS BIGINT) AS started_at, CASE WHEN o_orderkey % 5 = 0 THEN 'retried' END AS resolved_status,
        CASE WHEN o_orderkey % 2 = 0 THEN CAST(2000 + o_orderkey AS BIGINT) END AS resolved_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'w1' ELSE 'w2' END AS worker_id
        FROM {orders}""",
    # Ten events in a row are what happened to one job.
    "kb_job_events": """SELECT CAST(floor(event_id / 10) AS BIGINT) AS id, event_id AS seq,
        CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'claim' WHEN 'signup' THEN 'complete' WHEN 'error' THEN 'fail' ELSE CASE WHEN event_id % 3 = 0 THEN 'cancel' ELSE 'progress' END END AS kind,
        CASE WHEN event_type NOT IN ('click', 'signup', 'error') THEN CAST(event_id % 100 AS BIGINT) END AS progress,
        CASE WHEN event_type = 'error' OR event_type = 'signup' AND event_id % 4 = 1 THEN concat('error ', CAST(event_id % 7 AS VARCHAR(9))) END AS error, CAST(5000 + event_id AS BIGINT) AS happened FROM {events}""",
    "kb_events": """SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'page_update' WHEN 'click' THEN 'page_create' WHEN 'signup' THEN 'role_update'
        WHEN 'error' THEN 'page_delete' ELSE 'book_update' END AS event, CAST(user_id AS BIGINT) AS item_id FROM {events}""",
    # All kinds of events, with the book that a chapter's event names.
    "kb_webhooks": """SELECT event_id, CASE CAST(event_id % 16 AS INT) WHEN 0 THEN 'page_create' WHEN 1 THEN 'page_update' WHEN 2 THEN 'page_restore' WHEN 3 THEN 'page_move'
        WHEN 4 THEN 'page_delete' WHEN 5 THEN 'chapter_update' WHEN 6 THEN 'chapter_move' WHEN 7 THEN 'chapter_delete' WHEN 8 THEN 'book_update' WHEN 9 THEN 'book_delete'
        WHEN 10 THEN 'bookshelf_update' WHEN 11 THEN 'bookshelf_delete' WHEN 12 THEN 'role_update' WHEN 13 THEN 'role_delete' WHEN 14 THEN 'permissions_update' ELSE 'comment_create' END AS event,
        CASE WHEN event_id % 37 = 0 THEN NULL ELSE CAST(user_id % 140 AS BIGINT) END AS item_id,
        CASE WHEN event_id % 16 IN (5, 6, 7) AND event_id % 3 <> 0 THEN CAST(user_id % 25 AS BIGINT) END AS book_id FROM {events}""",
    "kb_page_updates": """SELECT CAST(user_id AS BIGINT) AS page_id, max(ts) AS updated_at FROM {events} GROUP BY CAST(user_id AS BIGINT)""",
    "kb_html": """SELECT CAST(page_id AS BIGINT) AS page_id, CASE WHEN page_id % 2 = 0 THEN concat(html, '<a href="/books/b/page/customer-000000001">x</a><a href="/link/7">y</a>') ELSE html END AS html FROM {pages}""",
    # What a keyword search gives back, of all types, in rank order: each page has a position by arithmetic, so that no task sorts all pages.
    "kb_keyword_hits": """SELECT page_id, CASE WHEN page_id % 6 = 5 THEN 'chapter' ELSE 'page' END AS kind, (page_id * 37 + 11) % (SELECT count(*) FROM {customer}) AS pos FROM kb_pages""",
}

def sql_of(view: str, table) -> str:
    """The view's SQL with ``table(name)`` for each base table."""
    return re.sub(r"\{(\w+)\}", lambda m: table(m[1]), VIEWS[view])


class Knowledge:
    """The derived tables over the Parquet files of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made, self._base = spark, folder, {}, {}

    def base(self, name: str) -> DataFrame:
        """A base table; its files are listed and its schema is read once."""
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._base[name]

    def __getattr__(self, name: str) -> DataFrame:
        view = f"kb_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        if view not in self._made:
            names = set(re.findall(r"kb_\w+", VIEWS[view]))
            frames = {n: getattr(self, n[3:]) for n in names}
            text = sql_of(view, lambda t: f"{{{t}}}")
            tables = {t: self.base(t) for t in set(re.findall(r"\{(\w+)\}", text))}
            for n in names:
                text = re.sub(rf"\b{n}\b", f"{{{n}}}", text)
            self._made[view] = self.spark.sql(text.replace("VARCHAR(9)", "STRING"), **frames, **tables)
        return self._made[view]


def oracle(sql: str) -> str:
    """DuckDB's SQL with the views it names put before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in sorted(set(re.findall(r"\bkb_\w+", text)) & set(VIEWS)):
            if n not in need:
                add(VIEWS[n])
                need.append(n)

    add(sql)
    heads = [f"{n} AS ({sql_of(n, str)})" for n in need]
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join([*heads, rest[len('WITH RECURSIVE') :].strip()])}"
    if rest.upper().startswith("WITH "):
        return f"WITH {', '.join([*heads, rest[5:].strip()])}"
    return f"WITH {', '.join(heads)} {rest}" if heads else rest
