"""Who may see which page: permissions are resolved for all pages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The permissions whose holders see every page.
VIEW_ALL = ("page-view-all", "chapter-view-all", "book-view-all", "content-export")
#: Roles are few; more than this many are an error, as they are sent to all executors.
MAX_ROLES = 10_000


def effective_roles(levels: DataFrame, entries: DataFrame, roles: DataFrame) -> DataFrame:
    """(level_id, roles): for each level (level_id, fallback_view) the roles that may see it; explicit entries (level_id, role_id, view, ord) override the fallback, the last one wins."""
    explicit = entries.groupBy("level_id", "role_id").agg(F.max_by("view", "ord").alias("view"))
    known = sorted(r[0] for r in roles.select("role_id").distinct().limit(MAX_ROLES + 1).collect())
    if len(known) > MAX_ROLES:
        raise ValueError(f"more than {MAX_ROLES} roles")
    own = explicit.groupBy("level_id").agg(F.map_from_entries(F.collect_list(F.struct("role_id", "view"))).alias("own"))
    every = F.array(*[F.lit(r) for r in known]).cast("array<bigint>")
    may = lambda r: F.coalesce(F.try_element_at("own", r.cast(explicit.schema["role_id"].dataType)), F.col("fallback_view"))
    return levels.join(own, "level_id", "left").select("level_id", F.filter(every, may).alias("roles"))


def inheriting(flag: str = "inheriting"):
    """A level without the flag inherits."""
    return F.coalesce(F.col(flag), F.lit(True))


def role_context(roles: DataFrame) -> DataFrame:
    """Roles (role_id, permissions) that see every page."""
    return roles.filter(F.arrays_overlap("permissions", F.array(*map(F.lit, VIEW_ALL)))).select("role_id")


def resolve(pages: DataFrame, levels: DataFrame, view_all: DataFrame) -> DataFrame:
    """(page_id, default_open, roles): the first of page, chapter and book that does not inherit decides; if all do, the page is open to the roles that see everything.

    ``levels`` is (kind, level_id, inheriting, roles); a level that is missing counts as inheriting.
    """

    def level(kind: str, key: str) -> DataFrame:
        return levels.filter(F.col("kind") == kind).select(F.col("level_id").alias(key), F.when(~inheriting(), F.col("roles")).alias(f"{kind}_roles"))

    rows = pages.select("page_id", "chapter_id", "book_id")
    for kind, key in (("page", "page_id"), ("chapter", "chapter_id"), ("book", "book_id")):
        rows = rows.join(level(kind, key), key, "left")
    everyone = view_all.agg(F.array_sort(F.collect_set("role_id")).alias("all_roles"))
    decided = F.coalesce("page_roles", "chapter_roles", "book_roles")
    return rows.withColumn("decided", decided).join(F.broadcast(everyone)).select("page_id", F.col("decided").isNull().alias("default_open"), F.coalesce("decided", "all_roles").alias("roles"))


def acl_upsert(acl: DataFrame, pages: DataFrame, new: DataFrame, stamp: int) -> tuple[DataFrame, DataFrame]:
    """New role rows (page_id, role_id) replace those of their pages; the pages are stamped."""
    changed = new.select("page_id").distinct()
    rows = acl.join(changed, "page_id", "left_anti").unionByName(new.dropDuplicates())
    stamped = pages.join(changed.withColumn("_new", F.lit(True)), "page_id", "left").withColumn("acl_computed_at", F.when(F.col("_new"), F.lit(stamp).cast("long")).otherwise(F.col("acl_computed_at"))).drop("_new")
    return rows, stamped


def prefilter(pages: DataFrame, acl: DataFrame, roles: list[int]) -> DataFrame:
    """(page_id, verdict) of the pages: uncomputed, default_open, allow or deny. No roles match nothing."""
    matched = acl.filter(F.col("role_id").isin(list(roles))).select("page_id").distinct().withColumn("_ok", F.lit(True))
    rows = pages.join(matched, "page_id", "left")
    verdict = F.when(F.col("acl_computed_at").isNull(), "uncomputed").when(F.col("acl_default_open"), "default_open").when(F.col("_ok"), "allow").otherwise("deny")
    return rows.select("page_id", verdict.alias("verdict"))


def ladder(candidates: DataFrame, memory: DataFrame, table: DataFrame, pages: DataFrame, acl: DataFrame, roles: list[int] | None, accessible: DataFrame, memory_since: int, table_since: int) -> DataFrame:
    """(page_id, viewable, decided_by) of the candidates: fresh answers kept in memory, then in the table, then the prefilter, then the check itself.

    Without known roles (None) the prefilter is skipped; a page that the check doesn't know is denied.
    """
    l1 = memory.filter(F.col("cached_at") >= memory_since).select("page_id", F.col("viewable").alias("l1"))
    l2 = table.filter(F.col("cached_at") >= table_since).select("page_id", F.col("viewable").alias("l2"))
    rows = candidates.select("page_id").join(l1, "page_id", "left").join(l2, "page_id", "left")
    if roles is None:
        rows = rows.withColumn("l3", F.lit(None).cast("boolean"))
    else:
        sure = prefilter(pages, acl, roles).select("page_id", F.when(F.col("verdict") == "allow", True).when(F.col("verdict") == "deny", False).alias("l3"))
        rows = rows.join(sure, "page_id", "left")
    rows = rows.join(accessible.select("page_id", F.col("ok").alias("l4")), "page_id", "left")
    by = F.when(F.col("l1").isNotNull(), "memory").when(F.col("l2").isNotNull(), "table").when(F.col("l3").isNotNull(), "prefilter").otherwise("check")
    return rows.select("page_id", F.coalesce("l1", "l2", "l3", "l4", F.lit(False)).alias("viewable"), by.alias("decided_by"))


def delete_page(acl: DataFrame, pages: list[int]) -> DataFrame:
    return acl.filter(~F.col("page_id").isin(list(pages)))


def delete_role(acl: DataFrame, role: int) -> DataFrame:
    return acl.filter(F.col("role_id") != role)


def computed(pages: DataFrame) -> DataFrame:
    """(page_id) of the pages whose permissions have been worked out."""
    return pages.filter("acl_computed_at IS NOT NULL").select("page_id")


def reconcile(acl: DataFrame, pages: DataFrame, levels: DataFrame, view_all: DataFrame, stamp: int) -> tuple[DataFrame, DataFrame]:
    """(role rows, pages) after the permissions of all these pages were worked out again: their role rows are replaced, and the pages carry
    ``acl_default_open`` and the time."""
    found = resolve(pages, levels, view_all)
    rows = acl.join(found.select("page_id"), "page_id", "left_anti").unionByName(found.filter("NOT default_open").select("page_id", F.explode("roles").alias("role_id")))
    stamped = pages.drop("acl_default_open", "acl_computed_at").join(found.select("page_id", F.col("default_open").alias("acl_default_open")), "page_id")
    return rows, stamped.withColumn("acl_computed_at", F.lit(stamp).cast("long"))


def caller_roles(callers: DataFrame, granted: DataFrame) -> DataFrame:
    """(caller, roles): the distinct roles granted (caller, role_id) to each caller, an empty list for one without. A caller who could not be identified (``identified`` of ``callers`` is
    false) has null, which is no list of roles: nothing is decided by roles for such a caller."""
    roles = granted.groupBy("caller").agg(F.array_sort(F.collect_set("role_id")).alias("roles"))
    known = F.col("identified") if "identified" in callers.columns else F.lit(True)
    own = F.coalesce("roles", F.array().cast(roles.schema["roles"].dataType))
    return callers.join(roles, "caller", "left").select("caller", F.when(known, own).alias("roles"))


#: Pages worked out in the background at once; with as many under way, all are left to the next reconciliation.
IN_FLIGHT = 200


def to_recompute(pages: DataFrame, in_flight: DataFrame, most: int = IN_FLIGHT) -> DataFrame:
    """(page_id) of the pages without worked-out permissions that a background run takes on: not those under way (page_id) already, and the first ones that leave ``most`` under way."""
    room = max(0, most - in_flight.select("page_id").distinct().limit(most).count())
    return pages.filter("acl_computed_at IS NULL").select("page_id").distinct().join(in_flight, "page_id", "left_anti").orderBy("page_id").limit(room)


def coalesced_check(requests: DataFrame, check) -> DataFrame:
    """``requests`` (token, page_id, ...) with ``ok``: ``check`` gets each (token, page_id) once and gives (token, page_id, ok); what it gives no answer for, or none in time (null), is denied."""
    asked = check(requests.select("token", "page_id").distinct())
    return requests.join(asked.select("token", "page_id", "ok"), ["token", "page_id"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
