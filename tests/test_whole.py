"""The queries over whole tables: no row of a base table is missing. test_queries compares them with SQL."""

import pyarrow.parquet as pq

from atheneum.plans import registry
from atheneum.sources.views import Knowledge

FOLDER = "/root/testdata/sf0.001"


def ids(table, column):
    return set(pq.read_table(f"{FOLDER}/{table}.parquet", columns=[column])[column].to_pylist())


def found(spark, name, column):
    return {r[0] for r in registry.QUERIES[name](spark, FOLDER).select(column).collect()}


def test_views_have_all_rows(spark):
    k = Knowledge(spark, FOLDER)
    pages, orders = ids("customer", "c_custkey"), pq.read_table(f"{FOLDER}/orders.parquet", columns=["o_orderkey", "o_custkey"]).to_pylist()
    edges = {(o["o_custkey"], (o["o_orderkey"] * 31 + 7) % len(pages), "similar" if o["o_orderkey"] % 3 == 0 else "link") for o in orders}
    assert {tuple(r) for r in k.relationships.collect()} == edges and {e[1] for e in edges} == pages
    assert {r.id for r in k.jobs.collect()} == {o["o_orderkey"] for o in orders}
    hits = k.keyword_hits.collect()
    assert {r.page_id for r in hits} == pages and sorted(r.pos for r in hits) == list(range(len(pages)))
    chunks = k.chunks.select("chunk_id", "page_id", "chunk_index").collect()
    assert {r.chunk_id for r in chunks} == ids("embeddings", "vec_id") and {r.page_id for r in chunks} == pages
    assert len({(r.page_id, r.chunk_index) for r in chunks}) == len(chunks)


def test_graph_and_job_queries_have_all_rows(spark):
    orders = ids("orders", "o_orderkey")
    assert found(spark, "agg_retry_chain_len", "id") == found(spark, "job_expire", "id") == orders
    assert found(spark, "join_linked_from", "page_id") == ids("customer", "c_custkey")
    new = found(spark, "job_retry", "id")
    assert new and not new & orders


def test_operators_get_all_ids(spark):
    pages, books = ids("customer", "c_custkey"), ids("nation", "n_nationkey")
    assert found(spark, "union_neighbours", "page_id") == pages
    assert {r.id for r in registry.QUERIES["reconcile_one"](spark, FOLDER).collect() if r.kind == "page"} == pages
    assert found(spark, "acl_caller_roles", "caller") == pages
    granted = [o["o_custkey"] for o in pq.read_table(f"{FOLDER}/orders.parquet", columns=["o_custkey"]).to_pylist()]
    assert sum(r.n_roles or 0 for r in registry.QUERIES["acl_caller_roles"](spark, FOLDER).collect()) == sum(c % 10 != 9 for c in granted)
    assert max(found(spark, "find_by_name_ci", "book_id")) > 8 and found(spark, "format_search_text", "request") == pages
    assert {r.id for r in registry.QUERIES["format_success"](spark, FOLDER).collect() if r.kind == "page"} == pages and books
    assert {r.id for r in registry.QUERIES["tree_acl_prune"](spark, FOLDER).collect() if r.kind == "page"} == {i for i in pages if i % 40 == 1 and reached(i)}
    assert found(spark, "embed_pipeline", "page_id") == ids("pages", "page_id") & pages


def reached(page):
    """Whether neither the page nor its book is deleted."""
    book = {r["c_custkey"]: r["c_nationkey"] for r in pq.read_table(f"{FOLDER}/customer.parquet", columns=["c_custkey", "c_nationkey"]).to_pylist()}[page]
    return page % 53 != 52 and book % 12 != 11
