"""The job queue as tables: decisions are columns over all jobs at once, changes are new rows of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.merge import MergeTable
from ..sources.staging import numbered, settled

ACTIVE, OPEN_ENDED, TERMINAL = ("pending", "running"), ("pending", "running", "failed"), ("succeeded", "cancelled", "closed")
MAX_RETRIES, MAX_CHAIN = 5, 1024
#: Seconds a job may run, and an ended one stays.
TIMEOUT, KEEP = 3600, 30
DAY, FIRST_AFTER = 86_400, 300


def failed_open() -> Column:
    return (F.col("status") == "failed") & F.col("resolved_status").isNull()


def blocks_new() -> Column:
    """Whether a job keeps another of its scope from being made."""
    return F.col("status").isin(*ACTIVE) | failed_open()


def create_dedup(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """(scope, id, is_new): for each requested scope the newest job that is still to be done, or a new id after the largest there is."""
    open_ = jobs.filter(blocks_new()).groupBy("scope").agg(F.max("id").alias("open_id"))
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = requests.select("scope").distinct().join(open_, "scope", "left")
    old = rows.filter("open_id IS NOT NULL").select("scope", F.col("open_id").alias("id"), F.lit(False).alias("is_new"))
    new = numbered(settled(rows.filter("open_id IS NULL").select("scope")), "scope").join(F.broadcast(top))
    return old.unionByName(new.select("scope", (F.col("top") + F.col("pos")).alias("id"), F.lit(True).alias("is_new")))


def claim_next(jobs: DataFrame) -> DataFrame:
    """(id) of the pending job that is next, null if there is none."""
    return jobs.filter("status = 'pending'").agg(F.min("id").alias("id"))


def claim(jobs: DataFrame, worker: str, now: int) -> DataFrame:
    """``jobs`` after a worker has taken the next pending one: it runs, since ``now``, for this worker. Without a pending job nothing changes. ``take`` does it to a queue that several workers share."""
    mine = F.coalesce(F.col("id") == F.col("_next"), F.lit(False))
    rows = jobs.join(F.broadcast(claim_next(jobs).withColumnRenamed("id", "_next")))
    values = {"status": F.lit("running"), "started_at": F.lit(now).cast("long"), "worker_id": F.lit(worker)}
    return rows.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in values.items()}).drop("_next")


def take(queue: MergeTable, worker: str, now: int) -> int | None:
    """Claims the next pending job of a shared queue and returns its id; None if there is none. The claim is one row, committed only if no one changed the queue since it was read, so each job is taken once."""
    taken: list[int] = []

    def change(jobs: DataFrame) -> DataFrame | None:
        taken.clear()
        first = claim_next(jobs).first().id
        if first is None:
            return None
        taken.append(first)
        mine = jobs.filter(F.col("id") == first)
        return mine.withColumns({"status": F.lit("running"), "started_at": F.lit(now).cast("long"), "worker_id": F.lit(worker)})

    return taken[0] if queue.update(change) is not None else None


def overdue(jobs: DataFrame, cutoff: int) -> DataFrame:
    """(id) of jobs that have run since before the cutoff."""
    return jobs.filter((F.col("status") == "running") & (F.col("started_at") < cutoff)).select("id")


def enqueue(jobs: DataFrame, scope: str) -> DataFrame:
    """``jobs`` and a pending one of this scope, unless one is still to be done."""
    made = create_dedup(jobs, jobs.sparkSession.createDataFrame([(scope,)], "scope string")).filter("is_new").select("id", "scope", F.lit("pending").alias("status"))
    return jobs.unionByName(made, allowMissingColumns=True)


def fold(events: DataFrame) -> DataFrame:
    """(id, status, progress, error, finished_at, resolved_status, resolved_at) after all events (id, seq, kind, progress, error, happened).

    Only pending and running jobs change, so the first ending stays, cancelling included. A job that succeeds or is cancelled is resolved by that; one that fails is open until
    the housekeeper decides what becomes of it."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "kind", "progress", "error", F.col("happened").cast("long").alias("happened"))))
    none = F.lit(None)
    start = F.struct(
        F.lit("pending").alias("status"), F.lit(0).cast("long").alias("progress"), none.cast("string").alias("error"), none.cast("long").alias("finished_at"),
        none.cast("string").alias("resolved_status"), none.cast("long").alias("resolved_at"),
    )

    def step(s: Column, e: Column) -> Column:
        going = s["status"].isin(*ACTIVE)
        ending = F.when(e["kind"] == "complete", F.when(e["error"].isNull(), "succeeded").otherwise("failed")).when(e["kind"] == "fail", "failed").when(e["kind"] == "cancel", "cancelled")
        status = F.coalesce(ending, F.when(e["kind"] == "claim", "running"))
        resolved = going & ending.isin("succeeded", "cancelled")
        return F.struct(
            F.when(going & status.isNotNull(), status).otherwise(s["status"]).alias("status"),
            F.when(going & (e["kind"] == "progress"), e["progress"]).otherwise(s["progress"]).alias("progress"),
            F.when(going & e["kind"].isin("complete", "fail"), e["error"]).otherwise(s["error"]).alias("error"),
            F.when(going & ending.isNotNull(), e["happened"]).otherwise(s["finished_at"]).alias("finished_at"),
            F.when(resolved, ending).otherwise(s["resolved_status"]).alias("resolved_status"),
            F.when(resolved, e["happened"]).otherwise(s["resolved_at"]).alias("resolved_at"),
        )

    return events.groupBy("id").agg(F.aggregate(steps, start, step).alias("s")).select("id", "s.*")


def should_stop(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", (F.col("status") != "running").alias("should_stop"))


def ended(jobs: DataFrame, which: Column, error: str, now: int | None) -> DataFrame:
    """Running jobs of ``which`` fail with this error; others stay."""
    hit = (F.col("status") == "running") & which
    old = lambda c, kind: F.col(c) if c in jobs.columns else F.lit(None).cast(kind)
    return jobs.withColumns(
        {"status": F.when(hit, "failed").otherwise(F.col("status")), "error": F.when(hit, F.lit(error)).otherwise(old("error", "string")), "finished_at": F.when(hit, F.lit(now).cast("long")).otherwise(old("finished_at", "long"))}
    )


def expire(jobs: DataFrame, cutoff: int, now: int | None = None) -> DataFrame:
    return ended(jobs, F.col("started_at") < cutoff, "timeout", now)


def recover(jobs: DataFrame, worker: str, now: int | None = None) -> DataFrame:
    """What this worker, or none, left running fails; for when the worker starts."""
    return ended(jobs, F.col("worker_id").isNull() | (F.col("worker_id") == worker), "worker_restart", now)


def has_successor(jobs: DataFrame) -> DataFrame:
    """(id, has_successor): whether a later job of the scope has not failed. One maximum a scope, no pairs."""
    last = jobs.filter("status <> 'failed'").groupBy("scope").agg(F.max("id").alias("last_ok"))
    return jobs.select("id", "scope").join(last, "scope", "left").select("id", F.coalesce(F.col("last_ok") > F.col("id"), F.lit(False)).alias("has_successor"))


def chain_lengths(jobs: DataFrame, most: int = MAX_CHAIN) -> DataFrame:
    """(id, chain): jobs on the way along ``retry_of`` to the first, the job included. Steps double, so a chain of 1024 takes ten joins, each of settled rows."""
    at = settled(jobs.select("id", F.col("retry_of").alias("jump"), F.lit(1).cast("long").alias("chain")))
    steps = 1
    while steps < most and not at.filter("jump IS NOT NULL").isEmpty():
        nxt = at.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("chain").alias("chain2"))
        at = settled(at.join(nxt, "jump", "left").select("id", F.col("jump2").alias("jump"), F.least(F.lit(most), F.col("chain") + F.coalesce("chain2", F.lit(0))).alias("chain")))
        steps *= 2
    return at.select("id", "chain")


def reconcile(jobs: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """(id, scope, decision) of each failed job that is still open: superseded, gave_up or retried.

    Jobs are decided by id, and the retry of one is a successor of all later failures of its scope: of these only the first is retried."""
    rows = jobs.filter(failed_open()).select("id", "scope").join(has_successor(jobs), "id").join(chain_lengths(jobs), "id")
    rows = rows.select("id", "scope", F.when(F.col("has_successor"), "superseded").when(F.col("chain") >= max_retries, "gave_up").otherwise("retried").alias("decision"))
    rows = settled(rows)
    first = rows.filter("decision = 'retried'").groupBy("scope").agg(F.min("id").alias("first"))
    return rows.join(first, "scope", "left").select("id", "scope", F.when(F.col("id") > F.col("first"), "superseded").otherwise(F.col("decision")).alias("decision"))


def retries(decisions: DataFrame, top: int) -> DataFrame:
    """New pending jobs (id, scope, status, retry_of) for those to be retried."""
    rows = numbered(settled(decisions.filter("decision = 'retried'").select(F.col("id").alias("retry_of"), "scope")), "retry_of")
    return rows.select((F.lit(top) + F.col("pos")).cast("long").alias("id"), "scope", F.lit("pending").alias("status"), "retry_of")


def housekeep(jobs: DataFrame, now: int, timeout: int = TIMEOUT, keep: int = KEEP, max_retries: int = MAX_RETRIES) -> DataFrame:
    """``jobs`` after one round of housekeeping: what runs too long fails; ended jobs that were resolved ``keep`` seconds ago or before are closed; failed ones are closed as superseded,
    given up or retried, which adds jobs. Nothing is dropped: closed jobs still count as successors and as links of their chains. What a worker left running is
    another matter (``recover``), once, when it starts."""
    for column, kind in (("error", "string"), ("prev_status", "string"), ("finished_at", "long")):
        if column not in jobs.columns:
            jobs = jobs.withColumn(column, F.lit(None).cast(kind))
    swept = expire(jobs, now - timeout, now)
    swept = settled(close(swept, archivable(swept, now - keep)))
    decided = settled(reconcile(swept, max_retries))
    top = swept.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return close(swept, decided.select("id", F.col("decision").alias("resolved"))).unionByName(retries(decided, top), allowMissingColumns=True)


def close(jobs: DataFrame, which: DataFrame) -> DataFrame:
    """``jobs`` with those of ``which`` (id, and maybe ``resolved``) closed: the status before is kept, and so is how they were resolved unless it is given. When they were resolved stays."""
    gone = which.select("id", F.col("resolved") if "resolved" in which.columns else F.lit(None).cast("string").alias("resolved"), F.lit(True).alias("_close")).dropDuplicates(["id"])
    rows = jobs.join(gone, "id", "left")
    hit = F.col("_close").isNotNull() & (F.col("status") != "closed")
    before = F.col("prev_status") if "prev_status" in jobs.columns else F.lit(None).cast("string")
    rows = rows.withColumns(
        {
            "prev_status": F.when(hit, F.col("status")).otherwise(before),
            "resolved_status": F.when(hit, F.coalesce("resolved", "resolved_status")).otherwise(F.col("resolved_status")),
            "status": F.when(hit, "closed").otherwise(F.col("status")),
        }
    )
    return rows.select(*dict.fromkeys([*jobs.columns, "prev_status"]))


def archivable(jobs: DataFrame, cutoff: int) -> DataFrame:
    return jobs.filter(F.col("status").isin("succeeded", "cancelled") & (F.col("resolved_at") <= cutoff)).select("id")


def listing(jobs: DataFrame, recent: int) -> DataFrame:
    """(section, pos, id, scope, status): all that is going on by id, then the most recent ends, newest first."""
    going = numbered(jobs.filter(F.col("status").isin(*OPEN_ENDED)).select("id", "scope", "status"), "id").withColumn("section", F.lit(0))
    done = jobs.filter(F.col("status").isin(*TERMINAL)).orderBy(F.desc("id")).limit(recent)
    done = numbered(done.select("id", "scope", "status"), "id", descending=True).withColumn("section", F.lit(1))
    return going.unionByName(done).select("section", F.col("pos").cast("int").alias("pos"), "id", "scope", "status")


def dispatch(scope: Column) -> Column:
    """(kind, id, error) of a scope."""
    kind, number = F.split_part(scope, F.lit(":"), F.lit(1)), F.split_part(scope, F.lit(":"), F.lit(2)).try_cast("bigint")
    ok = scope.isin("all", "delta") | (kind.isin("page", "chapter", "book", "shelf") & number.isNotNull())
    return F.struct(F.when(ok, kind).alias("kind"), F.when(ok, number).alias("id"), F.when(~ok, F.concat(F.lit("unknown scope "), scope)).alias("error"))


def embed_status(pages: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("total_pages")).join(chunks.agg(F.count("*").alias("total_chunks"))).join(jobs.agg(F.max("id").alias("latest_job"), F.max_by("status", "id").alias("latest_status")))


def initial_walk(jobs: DataFrame, last_full_walk: int | None) -> DataFrame:
    """``jobs`` with one for everything, if there has been no full walk yet."""
    return jobs if last_full_walk is not None else enqueue(jobs, "all")


def acl_cron(jobs: DataFrame, started: int, last: int | None, now: int, every: int = DAY, first: int = FIRST_AFTER) -> DataFrame:
    """``jobs`` with one that reconciles all permissions, if one is due: ``first`` seconds after the start, then ``every`` so many; never with 0."""
    due = every > 0 and now >= (started + first if last is None else last + every)
    return enqueue(jobs, "acl_reconcile") if due else jobs
