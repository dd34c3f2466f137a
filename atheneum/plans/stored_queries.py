"""Queries that go through stored structures: the text index, adjacency by bucket, tables that merge on read, the commit log.

A structure is built from the given tables in the shared folder, once a session and folder of tables; queries that change one build their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import jobs, search
from ..operators.adjacency import Adjacency
from ..operators.graph import strong_weak
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources.log import SnapshotLog
from ..sources.merge import MergeTable
from ..sources.ordered import OrderedTable
from ..sources.staging import scratch
from ..sources.views import Knowledge
from . import catalog
from .catalog import ORACLE, QUERIES, query

#: Buckets of the tables here, which are small.
BUCKETS = 16
_BUILT: dict[tuple, object] = {}


def same_as(name: str, other: str) -> Callable:
    """Registers a query whose result is that of another, with the SQL of that one."""

    def add(build: Callable[[Knowledge], DataFrame]) -> None:
        QUERIES[name] = lambda spark, folder: build(Knowledge(spark, folder))
        ORACLE[name] = ORACLE[other]

    return add


def kept(k: Knowledge, name: str, make: Callable[[SnapshotLog], object]):
    """The structure of this name over these tables, made at its first use in the session."""
    at = (k.spark.sparkContext.applicationId, k.folder, name)
    if at not in _BUILT:
        _BUILT[at] = make(SnapshotLog(k.spark, scratch(k.spark, name)))
    return _BUILT[at]


# --- the text index ------------------------------------------------------------------------------------------------


def _index(k: Knowledge, log: SnapshotLog) -> TextIndex:
    index = TextIndex(log, buckets=BUCKETS)
    index.build(k.base("documents"))
    return index


def text_index(k: Knowledge) -> TextIndex:
    return kept(k, "text-index", lambda log: _index(k, log))


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '')"


def _ranked(documents: str) -> str:
    """BM25 of two words over documents, as (doc_id, raw)."""
    return f"""t AS (SELECT doc_id, {_WORDS} AS w FROM {documents}), r AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'idiot')) AS t0, len(list_filter(w, lambda x: x = 'that')) AS t1 FROM t),
 s AS (SELECT count(*) AS n, avg(n) AS a, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1 FROM r),
 q AS (SELECT doc_id, ln(1 + (s.n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * r.n / a)) + ln(1 + (s.n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * r.n / a)) AS raw FROM r, s WHERE t0 + t1 > 0)"""


query("keyword_index_search", f"WITH {_ranked('documents')} SELECT doc_id, round(raw, 4) AS score FROM q")(lambda k: text_index(k).search("that idiot").select("doc_id", F.round("score", 4).alias("score")))
query("keyword_index_top", f"WITH {_ranked('documents')} SELECT doc_id, round(raw, 4) AS score FROM q ORDER BY round(raw, 9) DESC, doc_id LIMIT 25")(lambda k: text_index(k).top("That IDIOT", 25)[0].select("doc_id", F.round("score", 4).alias("score")))
query("keyword_index_phrase", f"WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, times::INT AS times FROM (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS times FROM t) WHERE times > 0")(
    lambda k: text_index(k).phrase("of the")
)
_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'that idiot, that idiot again' ELSE text END AS text FROM documents WHERE doc_id % 50 <> 1)"


@query("keyword_index_update", f"WITH {_ranked(_CHANGED)} SELECT doc_id, round(raw, 4) AS score FROM q")
def _(k):
    index = _index(k, SnapshotLog(k.spark, scratch(k.spark, "text-index")))
    docs = k.base("documents")
    index.update(docs.filter("doc_id % 50 = 0").select("doc_id", F.lit("that idiot, that idiot again").alias("text")), docs.filter("doc_id % 50 = 1"))
    return index.search("that idiot").select("doc_id", F.round("score", 4).alias("score"))


# --- adjacency by bucket -------------------------------------------------------------------------------------------


def _adjacency(k: Knowledge, log: SnapshotLog) -> Adjacency:
    found = Adjacency(log, buckets=BUCKETS)
    found.build(k.relationships)
    return found


def adjacency(k: Knowledge) -> Adjacency:
    return kept(k, "adjacency", lambda log: _adjacency(k, log))


@same_as("blanket_boost_by_bucket", "blanket_boost")
def _(k):
    scored, hits = catalog._scored(k)
    counts = strong_weak(adjacency(k).blanket(k.pages, scored), scored, hits)
    zero = F.lit(0)
    return scored.select("page_id").join(counts, "page_id", "left").select("page_id", F.round(search.boost(F.coalesce("strong", zero), F.coalesce("weak", zero)), 4).alias("blanket"))


@same_as("sink_replace_links_by_bucket", "sink_replace_links")
def _(k):
    edges = _adjacency(k, SnapshotLog(k.spark, scratch(k.spark, "adjacency")))
    ids = [r.page_id for r in k.pages.filter("page_id < 10").select("page_id").collect()]
    edges.replace_links(ids, k.pages.filter("page_id < 10").select(F.col("page_id").alias("source_page_id"), (F.col("page_id") + 1).alias("target_page_id"), F.lit("link").alias("link_type")))
    return edges.edges()


# --- tables that merge on read, and the commit log ------------------------------------------------------------------


@same_as("sink_upsert_page_merged", "sink_upsert_page")
def _(k):
    rows = k.pages.select("page_id", "name", "slug")
    table = MergeTable(SnapshotLog(k.spark, scratch(k.spark, "pages")), "pages", rows.schema, ["page_id"], buckets=BUCKETS)
    first = table.replaced(rows)
    table.log.transact(lambda _: first)
    table.upsert(catalog.new_pages(k).select("page_id", "name", "slug"))
    return table.read()


@same_as("sink_replace_chunks_merged", "sink_replace_chunks")
def _(k):
    rows = k.chunks.select("chunk_id", "page_id", "chunk_index")
    table = MergeTable(SnapshotLog(k.spark, scratch(k.spark, "chunks")), "chunks", rows.schema, ["page_id"], buckets=BUCKETS)
    first = table.replaced(rows)
    table.log.transact(lambda _: first)
    new = k.chunks.filter("page_id = 6").select((F.col("chunk_id") + 900000).alias("chunk_id"), F.lit(5).cast("long").alias("page_id"), (F.col("chunk_index") + 1).alias("chunk_index"))
    table.upsert(new, k.pages.filter("page_id = 5").select("page_id"))
    return table.read()


def queue(k: Knowledge) -> MergeTable:
    rows = k.jobs.select("id", "scope", "status", "started_at", "worker_id")
    table = MergeTable(SnapshotLog(k.spark, scratch(k.spark, "jobs")), "jobs", rows.schema, ["id"], buckets=BUCKETS)
    first = table.replaced(rows)
    table.log.transact(lambda _: first)
    return table


@query("job_take", "SELECT id, scope, CASE WHEN r <= 2 THEN 'running' ELSE status END AS status, CASE WHEN r <= 2 THEN 8999 + r ELSE started_at END AS started_at, CASE WHEN r <= 2 THEN 'w' || (7 + r) ELSE worker_id END AS worker_id FROM (SELECT *, CASE WHEN status = 'pending' THEN row_number() OVER (PARTITION BY status ORDER BY id) ELSE 9 END AS r FROM kb_jobs)")
def _(k):
    shared = queue(k)
    for i in (0, 1):
        jobs.take(shared, f"w{8 + i}", 9000 + i)
    return shared.read()


# --- ordered tables and the vector index ----------------------------------------------------------------------------


def _ordered(k: Knowledge, log: SnapshotLog) -> OrderedTable:
    rows = k.pages.select("page_id", "name")
    table = OrderedTable(log, "pages-by-name", rows.schema, ["name", "page_id"], file_rows=500)
    table.publish(rows)
    return table


query("paged_list_ordered", "SELECT page_id, name, pos FROM (SELECT page_id, name, row_number() OVER (ORDER BY name, page_id) AS pos FROM kb_pages) WHERE pos > 40 AND pos <= 60")(lambda k: kept(k, "ordered", lambda log: _ordered(k, log)).page(40, 20))


def _vector_index(k: Knowledge, log: SnapshotLog) -> VectorIndex:
    index = VectorIndex(log)
    index.build(k.chunks)
    return index


@same_as("vector_topk_indexed", "vector_topk")
def _(k):
    found, _ = kept(k, "vector-index", lambda log: _vector_index(k, log)).topk(catalog.query_vector(k), 20, catalog.THRESHOLD)
    return found.select("chunk_id", "page_id", F.round("score", 4).alias("score"))
