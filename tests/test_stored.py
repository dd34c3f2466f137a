"""Stored structures: the commit log under concurrent writers, tables that merge on read, adjacency by bucket, the text index."""

import re
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import numpy as np

from atheneum.operators import graph, ingest, jobs, models, search, tables, vectors
from atheneum.operators.adjacency import Adjacency
from atheneum.operators.text_index import TextIndex
from atheneum.operators.vector_index import VectorIndex
from atheneum.sources import merge, store
from atheneum.sources.log import SnapshotLog
from atheneum.sources.merge import MergeTable
from atheneum.sources.ordered import OrderedTable


@pytest.fixture
def log(spark, tmp_path):
    return SnapshotLog(spark, str(tmp_path / "log"))


def at_once(*work):
    errors = []

    def run(f):
        try:
            f()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors


def test_commits_are_made_once(log):
    assert log.state() == (0, {}) and log.commit(1, {"a": 1}) and not log.commit(1, {"a": 2}) and log.state() == (1, {"a": 1})
    at_once(*[lambda: [log.transact(lambda s: {"n": s.get("n", 0) + 1}) for _ in range(5)] for _ in range(4)])
    assert log.state()[1] == {"a": 1, "n": 20} and log.version() == 21
    log.transact(lambda s: {"a": None})
    assert log.state()[1] == {"n": 20} and log.state(1)[1] == {"a": 1}
    assert not [p for p in Path(log.root, "_log").iterdir() if not p.name.startswith("00") and not p.name.endswith(".crc")]


def test_two_workers_take_each_job_once(spark, log):
    rows = [(i, "pending" if i % 3 else "running", None, None) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "id long, status string, started_at long, worker_id string")
    queue, taken = MergeTable(log, "jobs", df.schema, ["id"], buckets=4), {"a": [], "b": []}
    first = queue.replaced(df)
    log.transact(lambda _: first)

    def work(name):
        while (found := jobs.take(queue, name, 5)) is not None:
            taken[name].append(found)

    at_once(lambda: work("a"), lambda: work("b"))
    assert sorted(taken["a"] + taken["b"]) == [i for i in range(1, 13) if i % 3]
    assert {r.id: r.worker_id for r in queue.read().filter("worker_id IS NOT NULL").collect()} == {i: n for n, ids in taken.items() for i in ids}


def test_tables_of_one_commit_always_agree(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"))
    kept.update(lambda s: {"row": spark.createDataFrame([(0,)], "n long"), "cache": spark.createDataFrame([(0,)], "n long")})
    seen = []

    def write():
        for _ in range(3):
            kept.update(lambda s: {t: s.read(t).select((F.col("n") + 1).alias("n")) for t in ("row", "cache")})

    def look():
        for _ in range(8):
            now = kept.snapshot()
            seen.append((now.read("row").first().n, now.read("cache").first().n))

    at_once(write, write, look)
    assert all(a == b for a, b in seen) and kept.read("row").first().n == kept.read("cache").first().n == 6  # no update is lost


def test_index_and_cache_are_published_together(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), "page_id long, name string, markdown string, page_updated_at int")
    kept.update(lambda s: {"index": spark.createDataFrame([], "page_id long, name string, indexed_at long"), "cache": spark.createDataFrame([], "page_id long, markdown string, cached_at long")})
    before = kept.snapshot()
    tables.publish_index_pages(kept, rows((1, "a", "A", 1), (1, "b", "B", 2), (2, "c", "C", 1)), 50)
    now = kept.snapshot()
    assert {r.page_id: (r.name, r.indexed_at) for r in now.read("index").collect()} == {1: ("b", 50), 2: ("c", 50)} and {r.page_id: r.markdown for r in now.read("cache").collect()} == {1: "B", 2: "C"}
    assert before.read("index").isEmpty() and before.read("cache").isEmpty()
    at_once(*[lambda i=i: tables.publish_index_pages(kept, rows((i, "n", "N", 1)), 60) for i in (3, 4)])
    assert {r.page_id for r in kept.read("index").collect()} == {r.page_id for r in kept.read("cache").collect()} == {1, 2, 3, 4}


def test_old_snapshots_are_removed(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"))
    for i in range(6):
        kept.publish("t", spark.range(i))
    assert kept.log.vacuum(2) == []  # all are young
    assert len(kept.log.vacuum(2, -60)) == 4 and kept.read("t").count() == 5 and kept.log.state(5)[0] == 5
    assert len([p for p in Path(kept.root, "t").iterdir() if p.is_dir()]) == 2 and len(list(Path(kept.root, "_log").glob("0*.json"))) == 2
    kept.publish("t", spark.range(9))
    assert kept.read("t").count() == 9


def bytes_under(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_a_change_writes_what_changes(spark, log):
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    table = MergeTable(log, "pages", rows.schema, ["id"], buckets=16)
    base = table.replaced(rows)
    log.transact(lambda _: base)
    before = bytes_under(log.root)
    table.upsert(spark.range(19_990, 20_010).select("id", F.lit("new").alias("text")), spark.range(10).withColumnRenamed("id", "id"))
    assert bytes_under(log.root) - before < before / 20
    want = {i: "new" if i >= 19_990 else None for i in range(10, 20_010)}
    got = {r.id: r.text for r in table.read().collect()}
    assert set(got) == set(want) and all(got[i] == "new" for i in range(19_990, 20_010)) and got[10] != "new"
    some = table.read([(19_995,)])
    assert some.filter("id = 19995").first().text == "new"
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan) and len(table.buckets_of([(19_995,)])) == 1
    opened = lambda buckets: table._files({base[merge.NAME + "pages"]["base"]["0"]: buckets}, table.schema).select(F.input_file_name()).distinct().count()
    assert opened(table.buckets_of([(19_995,)])) <= 2 < opened(list(range(16))) / 4


def test_deltas_and_compaction(spark, log):
    schema = spark.createDataFrame([], "page long, part int, text string").schema
    table = MergeTable(log, "chunks", schema, ["page"], buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    base = table.replaced(rows(*[(p, i, "a") for p in range(40) for i in range(2)]))
    log.transact(lambda _: base)
    table.upsert(rows((1, 0, "b"), (1, 1, "b"), (1, 2, "b"), (None, 0, "null key")))
    table.upsert(rows((2, 0, "c")), rows((1, 0, "")).select("page"))  # page 1 goes
    table.upsert(rows((1, 5, "d")))  # and comes back
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = plain(table.read())
    assert [x for x in want if x.startswith(("(1,", "(2,"))] == ["(1, 5, 'd')", "(2, 0, 'c')"] and len(want) == 38 * 2 + 2 + 1
    touched = table.compact(1)
    assert 0 < len(touched) < 8 and plain(table.read()) == want
    manifest = log.state()[1][merge.NAME + "chunks"]
    assert manifest["deltas"] == [] and len(set(manifest["base"].values())) == 2  # untouched buckets are where they were
    assert table.compact(1) == []
    lost = table.delta(rows((3, 9, "e")))
    table.upsert(rows((4, 0, "f")))
    log.transact(lambda s: table.added(s, lost))  # written before, committed after
    assert {r.text for r in table.read().filter("page IN (3, 4)").collect()} == {"e", "f"}


def test_adjacency_by_bucket(spark, log):
    edges = [(i % 50, (i * 7) % 60, "similar" if i % 5 == 0 else "link") for i in range(400)] + [(i, 3, "link") for i in range(200)]
    df = lambda rows: spark.createDataFrame(sorted(set(rows)), "source_page_id long, target_page_id long, link_type string")
    pages = spark.createDataFrame([(i, i % 5, None if i % 4 == 0 else i % 10, i % 13 == 0) for i in range(180)], "page_id long, book_id long, chapter_id long, deleted boolean")
    stored = Adjacency(log, buckets=16)
    stored.build(df(edges))
    plain = lambda found: sorted(map(tuple, found.select("page_id", "relation", "neighbour_id").collect()))
    ids = [1, 3, 7, 59, 179, 10_000]
    wanted = spark.createDataFrame([(i,) for i in ids], "page_id long")
    everyone = plain(graph.blanket(df(edges), pages))
    expected = [r for r in everyone if r[0] in ids]
    assert plain(stored.blanket(pages, ids)) == expected == plain(graph.blanket(df(edges), pages, wanted)) and len(expected) > 100
    stored.replace_links([1, 3], df([(1, 100, "link"), (3, 101, "link")]))
    kept = {e for e in edges if not (e[0] in (1, 3) and e[2] == "link")} | {(1, 100, "link"), (3, 101, "link")}
    both = lambda: (set(map(tuple, stored.edges().collect())), set(map(tuple, stored.into.read().select(*stored.edges().columns).collect())))
    assert both() == (kept, kept)
    stored.delete_pages([3, 7])
    left = {e for e in kept if not {e[0], e[1]} & {3, 7}}
    assert both() == (left, left)
    assert plain(stored.blanket(pages, ids)) == [r for r in plain(graph.blanket(df(left), pages)) if r[0] in ids]


def test_a_large_pool_is_joined_and_not_listed(spark, log, monkeypatch):
    edges = spark.createDataFrame(sorted({(i % 50, (i * 7) % 60, "link") for i in range(400)}), "source_page_id long, target_page_id long, link_type string")
    pages = spark.createDataFrame([(i, i % 5, None if i % 4 == 0 else i % 10, i % 13 == 0) for i in range(180)], "page_id long, book_id long, chapter_id long, deleted boolean")
    stored = Adjacency(log, buckets=16)
    stored.build(edges)
    wanted = spark.createDataFrame([(i,) for i in range(0, 120, 3)], "page_id long")
    plain = lambda found: sorted(map(tuple, found.select("page_id", "relation", "neighbour_id").collect()))
    expected = [r for r in plain(graph.blanket(edges, pages)) if r[0] < 120 and r[0] % 3 == 0]
    assert plain(stored.blanket(pages, wanted)) == expected and len(expected) > 100
    monkeypatch.setattr(graph, "MAX_POOL", 30)
    monkeypatch.setattr(graph, "blanket_of_edges", None)  # the way that takes ids
    assert plain(stored.blanket(pages, wanted)) == expected


TEXTS = [(i, " ".join(f"w{(i * 7 + j * j) % (3 + j)}" for j in range(i % 40))) for i in range(3000)] + [(5000, None), (5001, "..."), (5002, "Ünïque wörd-wörd w1 w2"), (5003, "w1 w2 W1 w2, w1w2")]


def test_text_index(spark, log):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(5)
    index = TextIndex(log, buckets=8)
    assert index.search("w1").isEmpty() and index.phrase("w1").isEmpty()
    index.build(docs)
    plain = lambda df: sorted((r[0], round(r[1], 8)) for r in df.collect())
    for words in ("w1", "w0 w5 w17", "wörd", "not there", "Ünïque w30"):
        assert plain(index.search(words)) == plain(search.bm25(docs, words))
    best = sorted(plain(search.bm25(docs, "wörd w2")), key=lambda x: (-x[1], x[0]))[:7]
    found, visited = index.top("w2 wörd", 7)
    assert [(r.doc_id, round(r.score, 8)) for r in found.collect()] == best and visited["scored"] <= visited["segments"]
    words = lambda t: [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
    for phrase in ("w1 w2", "w0 w1 w0", "wörd wörd", "w1"):
        p = words(phrase)
        want = {i: n for i, t in TEXTS if (n := sum(words(t)[j : j + len(p)] == p for j in range(len(words(t)))))}
        assert {r.doc_id: r.times for r in index.phrase(phrase).collect()} == want and want
    plan = index.rows_of(["w1"], index.generations())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_text_index_takes_changes_in(spark, log):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    index = TextIndex(log, buckets=8)
    index.build(docs)
    new = [(10, "w1 w1 fresh"), (11, None), (9000, "fresh fresh w2"), (5003, "w2")]
    index.update(spark.createDataFrame(new, "doc_id long, text string"), spark.createDataFrame([(20,), (777_777,)], "doc_id long"))
    index.update(spark.createDataFrame([(10, "w2 again")], "doc_id long, text string"))
    now = dict(TEXTS) | dict(new) | {10: "w2 again"}
    del now[20]
    live = spark.createDataFrame(list(now.items()), "doc_id long, text string")
    plain = lambda df: sorted((r[0], round(r[1], 8)) for r in df.collect())
    for words in ("w1 w2", "fresh", "again w1"):
        assert plain(index.search(words)) == plain(search.bm25(live, words))
    best = sorted(plain(search.bm25(live, "fresh w2")), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r.doc_id, round(r.score, 8)) for r in index.top("fresh w2", 5)[0].collect()] == best
    assert {r.doc_id for r in index.phrase("w2 again").collect()} == {10} and index.phrase("w1 fresh").isEmpty()


def test_top_k_skips_segments(spark, log):
    rows = spark.range(0, 20_000).select(F.col("id").alias("doc_id"), F.when((F.col("id") >= 7000) & (F.col("id") < 7100), "rare rare rare common").when(F.col("id") % 600 == 0, F.concat(F.lit("rare "), F.repeat(F.lit("common "), 60))).otherwise("common words here").alias("text"))
    index = TextIndex(log, buckets=8)
    index.build(rows)
    found, visited = index.top("rare", 10)
    assert [r.doc_id for r in found.collect()] == list(range(7000, 7010)) and visited["scored"] < visited["segments"] / 2


def test_an_offset_opens_one_file(spark, log):
    rows = spark.range(5_000).select(((F.col("id") * 7919) % 5_000).alias("k"), F.col("id").alias("v"))
    table = OrderedTable(log, "t", rows.schema, ["k"], file_rows=300)
    assert table.count() == 0 and table.page(0, 5).isEmpty()
    table.publish(rows)
    assert table.count() == 5_000
    for offset, limit in ((0, 10), (1_234, 20), (4_990, 50), (5_000, 5), (290, 2_000)):
        found = table.page(offset, limit)
        assert [(r.k, r.pos) for r in found.collect()] == [(i, i + 1) for i in range(offset, min(5_000, offset + limit))]
    assert len(table.page(1_234, 20).inputFiles()) <= 2
    table.publish(rows.limit(0))
    assert table.count() == 0


def clustered(n, dims=16, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (40, dims))
    return [(i, i // 2, (centres[i % 40] + r.normal(0, 0.08, dims)).astype(np.float32).tolist()) for i in range(n)]


def test_vector_index(spark, log):
    rows = clustered(8_000) + [(90_000, 1, None), (90_001, 1, [0.0] * 16), (90_002, 1, [1.0, 2.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, page_id long, embedding array<float>").repartition(4)
    index = VectorIndex(log)
    index.build(chunks)
    plain = lambda df: [(r.chunk_id, r.page_id, round(r.score, 9)) for r in df.collect()]
    for of, limit, threshold in ((5, 10, 0.2), (17, 300, 0.0), (3, 20, 0.999), (8, 9_000, -1.0)):
        query = rows[of][2]
        found, seen = index.topk(query, limit, threshold)
        assert plain(found) == plain(vectors.vector_topk(chunks, query, limit, threshold))
        if limit == 10:
            assert seen["scored"] < 0.3 * seen["vectors"] and seen["read"] < seen["cells"]
    assert plain(index.topk([0.0] * 16, 5, 0.1)[0]) == []
    VectorIndex(log).build(chunks.filter("chunk_id < 50"))  # a new width or content is a new build
    assert len(plain(index.topk(rows[5][2], 100, -1.0)[0])) == 50


def test_similar_pages_meet_only_in_near_cells(spark):
    rows = [(i, v) for i, _, v in clustered(1_500)] + [(5_000, [0.0] * 16)]
    pages = spark.createDataFrame(rows, "page_id long, centroid array<double>")
    placed, reach = vectors.near_cells(pages, 0.65, block=100)
    assert placed.count() == len(rows) and reach.agg(F.sum("pairs")).first()[0] < 0.3 * len(rows) ** 2
    m = np.array([v for _, v in rows])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    for threshold in (0.65, -0.5):
        scores = unit @ unit.T
        np.fill_diagonal(scores, -2)
        want = set()
        for i in range(len(rows)):
            best = np.lexsort((np.arange(len(rows)), -np.round(scores[i], 12)))[:5]
            want |= {(rows[i][0], rows[j][0]) for j in best if scores[i, j] >= threshold}
        assert {(r.page_id, r.similar_id) for r in vectors.similar_pages(pages, 5, threshold, block=100).collect()} == want


def test_centroids_of_ragged_and_missing_vectors(spark):
    rows = [(1, 1, [1.0, 2.0]), (2, 1, [3.0, 4.0]), (3, 2, [1.0]), (4, 2, [3.0, None, 5.0]), (5, 3, None), (6, 3, []), (7, None, [1.0, 1.0])] + [(10 + i, 9, [float(i), 1.0]) for i in range(500)]
    found = {r.page_id: (r.n_chunks, r.centroid) for r in vectors.centroids(spark.createDataFrame(rows, "chunk_id long, page_id long, embedding array<float>").repartition(5)).collect()}
    assert found == {1: (2, [2.0, 3.0]), 2: (2, [2.0, None, 5.0]), None: (1, [1.0, 1.0]), 9: (500, [249.5, 1.0])}


@pytest.fixture
def wiki(spark):
    pages = spark.createDataFrame([(i, 1, None, f"p{i}", f"p{i}") for i in range(60)], "page_id long, book_id long, chapter_id long, name string, slug string")
    books, chapters = spark.createDataFrame([(1, "b", 1)], "book_id long, name string, shelf_id long"), spark.createDataFrame([], "chapter_id long, name string")
    return books, chapters, spark.createDataFrame([(1, "s")], "shelf_id long, name string"), pages


def failing_on(bad):
    def make(dims):
        def embed(texts):
            if any(int(re.search(r"text (\d+)", t)[1]) in bad for t in texts):
                raise ValueError("bad text")
            return models.hashing_embedder(dims)(texts)

        return embed

    return make


def test_an_aborted_job_returns_nothing_after_the_abort(spark, wiki):
    raw = spark.createDataFrame([(i, f"<p>text {i}</p><a href='/link/3'>x</a>") for i in range(60)], "page_id long, html string")
    job = ingest.embed_job(raw, *wiki, 4, failing_on(set(range(15, 40)) | {2}), window=20)
    assert (job.status, job.aborted, job.stopped) == ("failed", True, False)  # failures 15 to 24 lie in two windows
    done = [i for i in range(15) if i != 2]
    assert sorted(r.page_id for r in job.results.collect()) == list(range(25)) and sorted(r.page_id for r in job.done.chunks.collect()) == sorted(r.page_id for r in job.done.pages.collect()) == done
    assert ingest.retries_of(job, spark.createDataFrame([], "id long, scope string, status string, resolved_status string")).isEmpty()


def test_a_job_stops_between_windows_and_queues_retries(spark, wiki):
    raw = spark.createDataFrame([(i, f"<p>text {i}</p>") for i in range(60)], "page_id long, html string")
    asked = []
    job = ingest.embed_job(raw, *wiki, 4, failing_on({4, 7}), window=20, should_stop=lambda: asked.append(1) or len(asked) > 2)
    assert (job.status, job.stopped) == ("cancelled", True) and sorted(r.page_id for r in job.results.collect()) == list(range(40))
    whole = ingest.embed_job(raw, *wiki, 4, failing_on({4, 7, 50}), window=20)
    queue = spark.createDataFrame([(9, "page:7", "pending", None), (3, "page:4", "succeeded", "succeeded")], "id long, scope string, status string, resolved_status string")
    assert whole.status == "succeeded"
    made = {r.scope: r.is_new for r in ingest.retries_of(whole, queue).collect()}
    assert made == {"page:7": False, "page:4": True, "page:50": True}
    none = ingest.embed_job(raw.limit(0), *wiki, 4)
    assert none.status == "succeeded" and none.done.chunks.isEmpty()


def test_windows_grow_with_the_job(spark, wiki):
    raw = spark.createDataFrame([(i, f"<p>text {i}</p>") for i in range(60)], "page_id long, html string").repartition(3)
    asked = []
    job = ingest.embed_job(raw, *wiki, 4, window=2, should_stop=lambda: asked.append(1))
    assert len(asked) == 6 and sorted(r.page_id for r in job.results.collect()) == list(range(60)) == sorted(r.page_id for r in job.done.chunks.collect())  # 2, 2, 4, 8, 16, 28
    job = ingest.embed_job(raw, *wiki, 4, failing_on(set(range(7, 17))), window=2)
    assert job.aborted and sorted(r.page_id for r in job.results.collect()) == list(range(17))


def test_tasks_that_pair_neighbours_grow_in_number(spark, monkeypatch):
    edges = spark.createDataFrame(sorted({(i % 50, (i * 7) % 60, "link") for i in range(400)}), "source_page_id long, target_page_id long, link_type string")
    pages = spark.createDataFrame([(i, i % 5, None if i % 4 == 0 else i % 10, i % 13 == 0) for i in range(180)], "page_id long, book_id long, chapter_id long, deleted boolean")
    found = graph.blanket(edges, pages)
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = plain(found.groupBy("page_id", "neighbour_id").agg(F.count("*").alias("n")))
    monkeypatch.setattr("atheneum.sources.staging.ROWS_A_TASK", 90)
    counted = graph.times_named(graph.blanket_of_many(edges, pages, pages), 180)
    assert plain(counted) == want and counted.rdd.getNumPartitions() == 14  # 180 pages with up to 70 neighbours, ten of them a row


def test_a_bucket_is_dealt_over_more_tasks_with_more_documents(spark, log, monkeypatch):
    monkeypatch.setattr("atheneum.operators.text_index.DOCS_A_SALT", 1_000)
    rows = spark.range(0, 16_000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("a word and another one of these few words here").alias("text"))
    index = TextIndex(log, buckets=2)
    index.build(rows)
    files = list(Path(log.root, index.generations()[0]["folder"], "postings").glob("bucket=*/*.parquet"))
    assert len(files) > 8 and index.search("word").count() == 16_000
