"""Queries for the job queue, event routing and walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest, jobs
from ..sources import paged, store
from ..sources.staging import scratch, settled
from ..sources.views import Knowledge
from ..streaming import events
from .catalog import query

_BLOCKS = "(status IN ('pending', 'running') OR (status = 'failed' AND resolved_status IS NULL))"
_REQUESTS = "SELECT 'book:' || book_id AS scope FROM kb_books UNION ALL SELECT 'page:' || book_id FROM kb_books"


def requests(k: Knowledge):
    return k.books.select(F.concat(F.lit("book:"), F.col("book_id")).alias("scope")).unionByName(k.books.select(F.concat(F.lit("page:"), F.col("book_id")).alias("scope")))


_DEDUP = f"WITH r AS ({_REQUESTS}), o AS (SELECT scope, max(id) AS open_id FROM kb_jobs WHERE {_BLOCKS} GROUP BY scope) SELECT scope, coalesce(open_id, (SELECT max(id) FROM kb_jobs) + sum((open_id IS NULL)::INT) OVER (ORDER BY scope))::BIGINT AS id, open_id IS NULL AS is_new FROM r LEFT JOIN o USING (scope)"
query("job_create_dedup", _DEDUP)(lambda k: jobs.create_dedup(k.jobs, requests(k)))
query("reembed", f"SELECT id, scope, status FROM kb_jobs UNION ALL SELECT max(id) + 1, 'all', 'pending' FROM kb_jobs")(lambda k: jobs.enqueue(jobs.enqueue(k.jobs, "all"), "all").select("id", "scope", "status"))
query("initial_walk", "SELECT 'first' AS walk, count(*) + 1 AS n_jobs, max(id) + 1 AS last_id FROM kb_jobs UNION ALL SELECT 'later', count(*), max(id) FROM kb_jobs")(
    lambda k: reduce(DataFrame.unionByName, [jobs.initial_walk(k.jobs, at).agg(F.lit(walk).alias("walk"), F.count("*").alias("n_jobs"), F.max("id").alias("last_id")) for walk, at in (("first", None), ("later", 5))])
)
query("acl_cron", "SELECT * FROM (VALUES (0, 0), (1, 1), (2, 0), (3, 1), (4, 0)) AS t(n, queued)")(
    lambda k: k.spark.createDataFrame([(i, jobs.acl_cron(k.jobs, *a).filter("scope = 'acl_reconcile'").count()) for i, a in enumerate([(1000, None, 1299), (1000, None, 1300), (1000, 2000, 88399), (1000, 2000, 88400), (1000, None, 99999, 0)])], "n int, queued int")
)
query("claim_next", "SELECT min(id) AS id FROM kb_jobs WHERE status = 'pending'")(lambda k: jobs.claim_next(k.jobs))
query("job_claim", "SELECT id, CASE WHEN id = n THEN 'running' ELSE status END AS status, CASE WHEN id = n THEN 9000 ELSE started_at END AS started_at, CASE WHEN id = n THEN 'w9' ELSE worker_id END AS worker_id FROM kb_jobs, (SELECT min(id) AS n FROM kb_jobs WHERE status = 'pending')")(
    lambda k: jobs.claim(k.jobs, "w9", 9000).select("id", "status", "started_at", "worker_id")
)
query("job_should_stop", "SELECT id, status <> 'running' AS should_stop FROM kb_jobs")(lambda k: jobs.should_stop(k.jobs))
query("job_expire", "SELECT id, CASE WHEN status = 'running' AND started_at < 1400 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND started_at < 1400 THEN 'timeout' END AS error FROM kb_jobs")(lambda k: jobs.expire(k.jobs, 1400).select("id", "status", "error"))
query("job_timeout_list", "SELECT id FROM kb_jobs WHERE status = 'running' AND started_at < 1400")(lambda k: jobs.overdue(k.jobs, 1400))
query("job_recover", "SELECT id, CASE WHEN status = 'running' AND coalesce(worker_id, 'w1') = 'w1' THEN 'failed' ELSE status END AS status FROM kb_jobs")(lambda k: jobs.recover(k.jobs, "w1").select("id", "status"))
query("job_failed_open", "SELECT id FROM kb_jobs WHERE status = 'failed' AND resolved_status IS NULL")(lambda k: k.jobs.filter(jobs.failed_open()).select("id"))
_SUCCESSOR = "SELECT id, EXISTS (SELECT 1 FROM kb_jobs b WHERE b.scope = a.scope AND b.id > a.id AND b.status <> 'failed') AS has_successor FROM kb_jobs a"
query("job_has_successor", _SUCCESSOR)(lambda k: jobs.has_successor(k.jobs))
_CHAIN = "c AS (SELECT id, retry_of, 1 AS n FROM kb_jobs UNION ALL SELECT c.id, j.retry_of, c.n + 1 FROM c JOIN kb_jobs j ON j.id = c.retry_of WHERE c.n < 1024), chains AS (SELECT id, max(n)::BIGINT AS chain FROM c GROUP BY id)"
query("agg_retry_chain_len", f"WITH RECURSIVE {_CHAIN} SELECT id, chain FROM chains")(lambda k: jobs.chain_lengths(k.jobs))
# Failed jobs are decided by id; the retry of one comes after all others of its scope, so it supersedes the later failures.
_DECIDED = f"""s AS ({_SUCCESSOR}), d0 AS (SELECT id, scope, CASE WHEN has_successor THEN 'superseded' WHEN chain >= 5 THEN 'gave_up' ELSE 'retried' END AS decision
 FROM kb_jobs JOIN s USING (id) JOIN chains USING (id) WHERE status = 'failed' AND resolved_status IS NULL),
 d AS (SELECT id, scope, CASE WHEN EXISTS (SELECT 1 FROM d0 e WHERE e.scope = d0.scope AND e.id < d0.id AND e.decision = 'retried') THEN 'superseded' ELSE decision END AS decision FROM d0)"""
query("job_reconcile", f"WITH RECURSIVE {_CHAIN}, {_DECIDED} SELECT id, scope, decision FROM d")(lambda k: jobs.reconcile(k.jobs))
query("job_retry", f"WITH RECURSIVE {_CHAIN}, {_DECIDED} SELECT (SELECT max(id) FROM kb_jobs) + row_number() OVER (ORDER BY id) AS id, scope, id AS retry_of FROM d WHERE decision = 'retried'")(lambda k: jobs.retries(jobs.reconcile(k.jobs), k.jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]).select("id", "scope", "retry_of"))
query("job_close", "SELECT id, CASE WHEN id % 7 = 0 THEN 'closed' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN status END AS prev_status, CASE WHEN id % 7 = 0 AND id % 2 = 0 THEN 'gave_up' ELSE resolved_status END AS resolved_status, resolved_at FROM kb_jobs")(
    lambda k: jobs.close(k.jobs, k.jobs.filter("id % 7 = 0").select("id", F.when(F.col("id") % 2 == 0, "gave_up").alias("resolved"))).select("id", "status", "prev_status", "resolved_status", "resolved_at")
)
query("job_archive", "SELECT id FROM kb_jobs WHERE status IN ('succeeded', 'cancelled') AND resolved_at <= 2500")(lambda k: jobs.archivable(k.jobs, 2500))
_LISTING = "SELECT 0 AS section, row_number() OVER (ORDER BY id)::INT AS pos, id, scope, status FROM kb_jobs WHERE status IN ('pending', 'running', 'failed') UNION ALL SELECT 1, row_number() OVER (ORDER BY id DESC)::INT, id, scope, status FROM (SELECT * FROM kb_jobs WHERE status IN ('succeeded', 'cancelled', 'closed') ORDER BY id DESC LIMIT 15)"
for _name in ("union_jobs_view", "job_lists"):
    query(_name, _LISTING)(lambda k: jobs.listing(k.jobs, 15))


# What happened to jobs, one row an event of the log: a folded job has had its first ending, whatever came later.
_LAST = """WITH e AS (SELECT *, min(CASE WHEN kind IN ('complete', 'fail', 'cancel') THEN seq END) OVER (PARTITION BY id) AS ending FROM kb_job_events), g AS (SELECT * FROM e WHERE ending IS NULL OR seq <= ending),
 f AS (SELECT id, coalesce(max(CASE WHEN seq = ending THEN CASE WHEN kind = 'complete' AND error IS NULL THEN 'succeeded' WHEN kind = 'cancel' THEN 'cancelled' ELSE 'failed' END END), CASE WHEN bool_or(kind = 'claim') THEN 'running' ELSE 'pending' END) AS status,
  coalesce(arg_max(progress, seq) FILTER (kind = 'progress'), 0)::BIGINT AS progress, max(error) FILTER (seq = ending AND kind <> 'cancel') AS error, max(happened) FILTER (seq = ending) AS finished_at FROM g GROUP BY id)"""
query("job_progress", f"{_LAST} SELECT id, status, progress FROM f")(lambda k: jobs.fold(k.job_events).select("id", "status", "progress"))
for _name, _status in (("job_complete", "succeeded"), ("job_fail", "failed"), ("job_cancel", "cancelled")):
    query(_name, f"{_LAST} SELECT id, error, finished_at, CASE WHEN status <> 'failed' THEN status END AS resolved_status, CASE WHEN status <> 'failed' THEN finished_at END AS resolved_at FROM f WHERE status = '{_status}'")(
        lambda k, status=_status: jobs.fold(k.job_events).filter(F.col("status") == status).select("id", "error", "finished_at", "resolved_status", "resolved_at")
    )
query("job_dispatch", "SELECT id, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 = 2 THEN 'all' ELSE 'book' END AS kind, CASE WHEN id % 4 < 2 THEN CAST(substr(scope, 6) AS BIGINT) END AS target, CASE WHEN id % 4 = 3 THEN 'unknown scope ' || 'x' || scope END AS error FROM kb_jobs")(
    lambda k: k.jobs.select("id", jobs.dispatch(F.when(F.col("id") % 4 == 3, F.concat(F.lit("x"), "scope")).when(F.col("id") % 4 == 2, "all").otherwise(F.col("scope"))).alias("d")).select("id", "d.kind", F.col("d.id").alias("target"), "d.error")
)
_EMBED = """WITH sb AS (SELECT shelf_id, book_id FROM kb_books WHERE NOT deleted AND shelf_id IS NOT NULL), e AS (SELECT w.*, c.book_id AS old_book FROM kb_webhooks w LEFT JOIN kb_chapters c ON w.event = 'chapter_move' AND c.chapter_id = w.item_id)
 SELECT event_id, 'page:' || item_id AS scope FROM e WHERE event IN ('page_create', 'page_update', 'page_restore', 'page_move') AND item_id IS NOT NULL
 UNION ALL SELECT event_id, 'delete:page:' || item_id FROM e WHERE event = 'page_delete' AND item_id IS NOT NULL
 UNION ALL SELECT event_id, 'book:' || book_id FROM e WHERE event IN ('chapter_update', 'chapter_delete', 'chapter_move') AND book_id IS NOT NULL
 UNION ALL SELECT event_id, CASE WHEN old_book IS NULL THEN 'all' ELSE 'book:' || old_book END FROM e WHERE event = 'chapter_move' AND item_id IS NOT NULL AND (old_book IS NULL OR book_id IS NULL OR old_book <> book_id)
 UNION ALL SELECT event_id, 'book:' || item_id FROM e WHERE event = 'book_update' AND item_id IS NOT NULL
 UNION ALL SELECT event_id, CASE WHEN sb.book_id IS NULL THEN 'all' ELSE 'book:' || sb.book_id END FROM e LEFT JOIN sb ON sb.shelf_id = e.item_id WHERE event IN ('bookshelf_update', 'bookshelf_delete')
 UNION ALL SELECT event_id, 'acl_reconcile' FROM e WHERE event IN ('role_update', 'permissions_update', 'role_delete') UNION ALL SELECT event_id, 'delete:role:' || item_id FROM e WHERE event = 'role_delete' AND item_id IS NOT NULL"""
query("route_event_embed", _EMBED)(lambda k: events.route_embed(k.webhooks, k.books, k.chapters))
query("route_event_index", """SELECT event_id, 'page:' || item_id AS scope FROM kb_webhooks WHERE event IN ('page_create', 'page_update', 'page_restore', 'page_move') AND item_id IS NOT NULL
 UNION ALL SELECT event_id, 'delete:' || CASE event WHEN 'page_delete' THEN 'page' WHEN 'chapter_delete' THEN 'chapter' WHEN 'book_delete' THEN 'book' ELSE 'shelf' END || ':' || item_id FROM kb_webhooks WHERE event IN ('page_delete', 'chapter_delete', 'book_delete', 'bookshelf_delete') AND item_id IS NOT NULL
 UNION ALL SELECT event_id, 'all' FROM kb_webhooks WHERE event IN ('chapter_update', 'chapter_move', 'chapter_delete', 'book_update', 'book_delete', 'bookshelf_update', 'bookshelf_delete')""")(lambda k: events.route_index(k.webhooks))
@query("delta_walk", """WITH u AS (SELECT page_id, CAST(epoch_us(updated_at) AS BIGINT) AS updated_us FROM kb_page_updates WHERE updated_at > TIMESTAMP '2024-01-05 00:00:00')
 SELECT page_id, updated_us, CASE WHEN page_id % 17 = 3 THEN 'page:' || page_id END AS retry FROM u""")
def _(k):
    """A walk over all updates since a time: pages that fail go to a queue of retries."""
    folder = scratch(k.spark, "delta-walk")
    listing_ = k.page_updates.select("page_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
    listing_.repartitionByRange("updated_at", "page_id").sortWithinPartitions("updated_at", "page_id").write.parquet(f"{folder}/listing")
    stream = events.updates_since(k.spark, "page_id bigint, updated_at timestamp_ntz", "2024-01-05T00:00:00", connector="atheneum.sources.delta:ParquetDelta", path=f"{folder}/listing".removeprefix("file://"))
    rows = F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us")
    failing = F.when(F.col("page_id") % 17 == 3, "no such page").alias("error")
    shown = lambda df, retry: df.select("page_id", rows, retry.alias("retry"))
    events.delta_walk(
        k.spark, stream, f"{folder}/checkpoint", lambda df: df.select("*", failing), lambda bad: shown(bad, F.concat(F.lit("page:"), "page_id")).write.mode("overwrite").parquet(f"{folder}/retries"),
        lambda good, number: shown(good, F.lit(None).cast("string")).write.mode("overwrite").parquet(f"{folder}/pages/batch={number}"),
    )
    read = lambda name: k.spark.read.schema("page_id bigint, updated_us bigint, retry string").parquet(f"{folder}/{name}")
    return read("pages/*").unionByName(read("retries"))


# Comments end the job of their page.
@query("job_create_stream", f"""WITH w AS ({_EMBED}), r AS (SELECT DISTINCT event_id, scope, false AS ends FROM w UNION ALL SELECT event_id, 'page:' || item_id, true FROM kb_webhooks WHERE event = 'comment_create' AND item_id IS NOT NULL),
 l AS (SELECT *, lag(ends) OVER (PARTITION BY scope ORDER BY event_id) AS before FROM r) SELECT scope, event_id FROM l WHERE NOT ends AND coalesce(before, true)""")
def _(k):
    """The jobs that the webhooks make as a stream, of several files in order."""
    folder, most = scratch(k.spark, "job-stream"), k.webhooks.agg(F.max("event_id")).first()[0]
    asked = events.route_embed(k.webhooks, k.books, k.chapters).distinct().withColumn("ends", F.lit(False))
    ended = k.webhooks.filter("event = 'comment_create' AND item_id IS NOT NULL").select("event_id", F.concat(F.lit("page:"), "item_id").alias("scope"), F.lit(True).alias("ends"))
    both = settled(asked.unionByName(ended))
    for part in range(3):
        both.filter(F.floor(F.col("event_id") * 3 / (most + 1)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    stream = events.new_jobs(events.files_since(k.spark, f"{folder}/events", both.schema, 1))
    query_ = stream.writeStream.format("parquet").option("path", f"{folder}/jobs").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return k.spark.read.schema("scope string, event_id bigint").parquet(f"{folder}/jobs")


_SHELF_BOOKS = "sb AS (SELECT book_id, shelf_id, 1 AS ord FROM kb_books WHERE shelf_id IS NOT NULL UNION ALL SELECT book_id, (shelf_id + 1) % 5, 2 FROM kb_books WHERE shelf_id IS NOT NULL AND book_id % 4 = 0)"


def shelf_books(k: Knowledge):
    on = k.books.filter("shelf_id IS NOT NULL")
    return on.select("book_id", "shelf_id", F.lit(1).alias("ord")).unionByName(on.filter("book_id % 4 = 0").select("book_id", ((F.col("shelf_id") + 1) % 5).alias("shelf_id"), F.lit(2).alias("ord")))




def listing(k: Knowledge) -> ingest.Listing:
    return ingest.Listing(k.shelves, shelf_books(k), k.books, k.chapters, k.pages)


query("full_walk", f"WITH {_SHELF_BOOKS} SELECT b.book_id, b.name, s.shelf_id, 'unclassified' AS book_kind FROM kb_books b LEFT JOIN (SELECT book_id, arg_max(shelf_id, ord) AS shelf_id FROM sb GROUP BY book_id) s USING (book_id)")(lambda k: ingest.full_walk(listing(k)).books.select("book_id", "name", "shelf_id", "book_kind"))
query("full_walk_chapters", "SELECT chapter_id, book_id, name, 'unclassified' AS chapter_kind FROM kb_chapters")(lambda k: ingest.full_walk(listing(k)).chapters.select("chapter_id", "book_id", "name", "chapter_kind"))
_OLD = "SELECT page_id, name, false AS deleted FROM kb_pages UNION ALL SELECT 1000000 + page_id, 'gone', {} FROM kb_pages WHERE page_id % 9 = 0"


def old_index(k: Knowledge) -> ingest.Index:
    """An index with outdated names and pages that are not listed any more."""
    new = ingest.classified(listing(k))
    lost = new.pages.filter("page_id % 9 = 0").withColumns({"page_id": F.col("page_id") + 1000000, "name": F.lit("gone")})
    return ingest.Index(new.shelves, new.books, new.chapters, new.pages.withColumn("name", F.lit("old")).unionByName(lost))


query("full_walk_pages", _OLD.format("false"))(lambda k: ingest.full_walk(listing(k), old_index(k)).pages.select("page_id", "name", "deleted"))
query("full_walk_tombstones", _OLD.format("true"))(lambda k: ingest.full_walk(listing(k), old_index(k), tombstones=True).pages.select("page_id", "name", "deleted"))
query("anti_orphan_books", f"WITH {_SHELF_BOOKS} SELECT book_id, name FROM kb_books WHERE book_id NOT IN (SELECT book_id FROM sb)")(lambda k: ingest.orphans(k.books.select("book_id", "name"), shelf_books(k)))
query("join_cascade_parent", "SELECT page_id, 'book:' || book_id AS scope FROM kb_pages WHERE book_id NOT IN (SELECT book_id FROM kb_books WHERE book_id % 6 <> 0)")(lambda k: ingest.missing_parents(k.pages, k.books.filter("book_id % 6 <> 0")))
# Every second page, every third chapter and every book but the fourth ones is looked up again; the index lacks each sixth book and shelf 1.
_KNOWN = "SELECT book_id FROM kb_books WHERE book_id % 6 <> 0"
query("reconcile_one", f"""WITH {_SHELF_BOOKS}, f AS (SELECT book_id, arg_min(shelf_id, ord) AS shelf_id FROM sb GROUP BY book_id)
 SELECT 'page' AS kind, page_id AS id, CASE WHEN page_id % 2 = 0 AND book_id IN ({_KNOWN}) THEN name ELSE 'old' END AS name FROM kb_pages
 UNION ALL SELECT 'chapter', chapter_id, CASE WHEN chapter_id % 3 = 0 AND book_id IN ({_KNOWN}) THEN name ELSE 'old' END FROM kb_chapters
 UNION ALL SELECT 'book', book_id, CASE WHEN book_id % 4 > 0 AND coalesce(f.shelf_id, 0) <> 1 THEN name || ' on ' || coalesce(f.shelf_id::VARCHAR, 'none') ELSE 'old on -1' END FROM kb_books LEFT JOIN f USING (book_id) WHERE book_id % 6 <> 0 OR book_id % 4 > 0 AND coalesce(f.shelf_id, 0) <> 1
 UNION ALL SELECT DISTINCT 'job', NULL, 'book:' || book_id FROM (SELECT book_id FROM kb_pages WHERE page_id % 2 = 0 UNION ALL SELECT book_id FROM kb_chapters WHERE chapter_id % 3 = 0) WHERE book_id NOT IN ({_KNOWN})
 UNION ALL SELECT DISTINCT 'job', NULL, 'shelf:1' FROM f WHERE book_id % 4 > 0 AND shelf_id = 1""")(lambda k: _looked_up(k))


def _looked_up(k: Knowledge):
    new, old = ingest.classified(listing(k)), F.lit("old")
    books = new.books.filter("book_id % 6 <> 0").withColumns({"name": old, "shelf_id": F.lit(-1).cast("long")})
    index = ingest.Index(new.shelves.filter("shelf_id <> 1"), books, new.chapters.withColumn("name", old), new.pages.withColumn("name", old))
    scope = lambda df, kind: df.select(F.concat(F.lit(f"{kind}:"), f"{kind}_id").alias("scope"))
    scopes = scope(k.pages.filter("page_id % 2 = 0"), "page").unionByName(scope(k.chapters.filter("chapter_id % 3 = 0"), "chapter")).unionByName(scope(k.books.filter("book_id % 4 > 0"), "book"))
    found, more = ingest.reconcile_some(scopes, listing(k), index)
    out = [found.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "name"), found.chapters.select(F.lit("chapter").alias("kind"), F.col("chapter_id").alias("id"), "name")]
    shelf = F.coalesce(F.col("shelf_id").cast("string"), F.lit("none"))
    out += [found.books.select(F.lit("book").alias("kind"), F.col("book_id").alias("id"), F.concat("name", F.lit(" on "), shelf).alias("name")), more.select(F.lit("job").alias("kind"), F.lit(None).cast("long").alias("id"), F.col("scope").alias("name"))]
    return reduce(DataFrame.unionByName, out)


# First what runs too long fails, then what was resolved 30 seconds ago is closed, then failed jobs are decided and closed; retries are added, nothing goes.
query("housekeeper", f"""WITH RECURSIVE {_CHAIN}, x AS (SELECT *, CASE WHEN status = 'running' AND started_at < 1400 THEN 'failed' ELSE status END AS now_status FROM kb_jobs),
 y AS (SELECT *, now_status IN ('succeeded', 'cancelled') AND coalesce(resolved_at <= 4970, false) AS archived, now_status = 'failed' AND resolved_status IS NULL AS open FROM x),
 ok AS (SELECT scope, max(id) AS last_ok FROM y WHERE now_status <> 'failed' GROUP BY scope),
 d0 AS (SELECT id, scope, CASE WHEN last_ok > id THEN 'superseded' WHEN chain >= 5 THEN 'gave_up' ELSE 'retried' END AS decision FROM y JOIN chains USING (id) LEFT JOIN ok USING (scope) WHERE open),
 fr AS (SELECT scope, min(id) AS first FROM d0 WHERE decision = 'retried' GROUP BY scope),
 d AS (SELECT id, scope, CASE WHEN id > first THEN 'superseded' ELSE decision END AS decision FROM d0 LEFT JOIN fr USING (scope))
 SELECT id, y.scope, CASE WHEN archived OR open THEN 'closed' ELSE now_status END AS status, CASE WHEN archived OR open THEN now_status END AS prev_status, coalesce(decision, resolved_status) AS resolved_status, resolved_at, retry_of
  FROM y LEFT JOIN d USING (id)
 UNION ALL SELECT (SELECT max(id) FROM kb_jobs) + row_number() OVER (ORDER BY id), scope, 'pending', NULL, NULL, NULL, id FROM d WHERE decision = 'retried'""")(
    lambda k: jobs.housekeep(k.jobs, 5000).select("id", "scope", "status", "prev_status", "resolved_status", "resolved_at", "retry_of")
)
# A job over all pages with a text, of which the index lacks some, that fail; it ends with the tenth failure in a row.
query("embed_outcome", """WITH r AS (SELECT CAST(page_id AS BIGINT) AS page_id, CAST(page_id AS BIGINT) % 40 < 12 AND page_id >= 20 AS bad FROM pages), e AS (SELECT *, row_number() OVER (ORDER BY page_id) AS pos FROM r),
 f AS (SELECT *, pos - row_number() OVER (ORDER BY pos) AS run FROM e WHERE bad), a AS (SELECT min(first) + 9 AS last FROM (SELECT run, min(pos) AS first, count(*) AS n FROM f GROUP BY run) WHERE n >= 10)
 SELECT count(*) AS done, sum(bad::INT)::BIGINT AS failures, true AS aborted, 'failed' AS status FROM e, a WHERE pos <= a.last""")(lambda k: _outcome(k))


def _outcome(k: Knowledge):
    """A job over all pages with a text, of which the index lacks some: these fail."""
    raw, lacking = k.html, (F.col("page_id") % 40 < 12) & (F.col("page_id") >= 20)
    known = k.html.filter(~lacking).select("page_id", F.lit(1).cast("long").alias("book_id"), F.lit(None).cast("long").alias("chapter_id"), F.concat(F.lit("page "), "page_id").alias("name"), F.concat(F.lit("p"), "page_id").alias("slug"))
    job = ingest.embed_job(raw, k.books, k.chapters, k.shelves, known, 8, window=60)
    return job.results.agg(F.count("*").alias("done"), F.count("error").alias("failures"), F.lit(job.aborted).alias("aborted"), F.lit(job.status).alias("status"))


# The index lacks each thirty-first page; their retries are queued, but for those that are waiting already.
query("embed_retries", """WITH r AS (SELECT CAST(page_id AS BIGINT) AS page_id FROM pages WHERE page_id % 31 = 7 AND page_id < 250), n AS (SELECT 'page:' || page_id AS scope FROM r WHERE page_id % 2 = 1)
 SELECT scope, 500 + row_number() OVER (ORDER BY scope) AS id, true AS is_new FROM n UNION ALL SELECT 'page:' || page_id, page_id, false FROM r WHERE page_id % 2 = 0""")(lambda k: _retries(k))


def _retries(k: Knowledge):
    lacking = (F.col("page_id") % 31 == 7) & (F.col("page_id") < 250)
    known = k.html.filter(~lacking).select("page_id", F.lit(1).cast("long").alias("book_id"), F.lit(None).cast("long").alias("chapter_id"), F.concat(F.lit("page "), "page_id").alias("name"), F.concat(F.lit("p"), "page_id").alias("slug"))
    waiting = k.html.filter(lacking & (F.col("page_id") % 2 == 0)).select(F.col("page_id").alias("id"), F.concat(F.lit("page:"), "page_id").alias("scope"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("resolved_status"))
    last = k.spark.createDataFrame([(500, "all", "succeeded", None)], waiting.schema)
    return ingest.retries_of(ingest.embed_job(k.html, k.books, k.chapters, k.shelves, known, 8), waiting.unionByName(last))


@query("scan_pages_paged", "SELECT page_id, url FROM pages")
def _(k):
    k.spark.dataSource.register(paged.PagedListing)
    reader = k.spark.read.format("paged_listing").schema("page_id bigint, url string")
    # Pages of 500 are asked for; like a server that gives fewer, the connector gives at most 400.
    return reader.options(connector="atheneum.sources.paged:parquet_pages", path=f"{k.folder}/pages.parquet", columns="page_id,url", page_size="500", most="400").load()


query("kv_get", "SELECT 'k' || page_id % 7 AS key, arg_max(name, page_id) AS value FROM kb_pages GROUP BY page_id % 7")(
    lambda k: store.kv_latest(k.pages.select(F.concat(F.lit("k"), F.col("page_id") % 7).alias("key"), F.col("name").alias("value"), F.col("page_id").alias("version")))
)
