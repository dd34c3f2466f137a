import hashlib
from itertools import takewhile

import pytest
from pyspark.sql import functions as F

from atheneum.functions import answers, documents, text
from atheneum.operators import acl, graph, ingest, jobs, models, search, tables, tree, vectors
from atheneum.operators.trained_embedder import TrainedEmbedder
from atheneum.sources import paged, store
from atheneum.streaming import events


def test_chunks_nest_headings_and_skip_the_title():
    found = documents.chunk_html("<h1>Top</h1><p>aa</p><h2>Mid</h2><p>bb</p><h3>Deep</h3><p>" + "c" * 60 + "</p>")
    assert found[-1][1] == "Top > Mid > Deep"
    page = documents.chunk_html("<h1>My PAGE</h1><p>hello</p><h2>Part</h2><p>" + "x" * 60 + "</p>", "my page")
    assert [c[1] for c in page] == ["", "Part"]
    index, path, content, digest = page[1]
    assert (index, content) == (1, "Part\n\n" + "x" * 60) and digest == hashlib.sha256(content.encode()).hexdigest()


def test_chunks_merge_when_small_and_split_when_large():
    html = "<h2>A</h2>" + "y" * 600 + "".join(f"<h2>S{i}</h2>" + "z" * 40 for i in range(30))
    found = documents.chunk_html(html)
    assert len(found) >= 2 and all(c[1] == "A" for c in found)
    assert all(len(c[2].encode()) <= documents.LARGE + len("A\n\n") for c in found)
    assert len(documents.chunk_html("<p>" + "word " * 1200 + "</p>")) == 1  # no blank lines survive the white space
    assert documents.chunk_html(None) == [] and documents.chunk_html("<p> </p>") == []
    assert documents.chunk_html("<table><tr><td>cell</td><td>two</td></tr></table>")[0][2] == "cell two"
    assert "a b" == documents.chunk_html("<p>a<br/>b</p>")[0][2] and "ab" == documents.chunk_html("<p>a<br>b</p>")[0][2]


def test_split_carries_short_paragraphs_over():
    parts = documents.split_overlapping("\n\n".join(["a" * 500, "b" * 500, "c" * 100, "d" * 500]))
    assert parts == ["\n\n".join(["a" * 500, "b" * 500, "c" * 100]), "\n\n".join(["c" * 100, "d" * 500])]


def test_sections():
    body = "# One\nx\n## Two\ny\n# Three\nz"
    edit = documents.replace_section_markdown
    assert edit(body, "## Two", "new") == edit(body, "tWO", "new") == "# One\nx\n## Two\nnew\n\n# Three\nz"
    assert edit(body, "Three", "new") == "# One\nx\n## Two\ny\n# Three\nnew\n"
    assert edit("a\nx\n# b\ny\n", "a", "new") == "a\nnew\n"  # under a line that is no heading all goes
    assert edit("a\r\n# b \r\nx\r\n## c\r\n# d\r\n", "b", "new") == "a\n# b \nnew\n\n# d"
    assert edit(body, "Four", "new") is edit(None, "a", "b") is edit(body, None, "b") is None and edit("É\nx", "é", "n") is None
    edit = documents.replace_section_html
    assert edit("<h2 a='b'>A</h2>old<h3>B</h3>x<h2>C</h2>", "a", "new") == "<h2 a='b'>A</h2>\nnew\n<h2>C</h2>"
    assert edit("<h3> <i>A</i></h3>old", "## a", "new") == "<h3> <i>A</i></h3>\nnew\n" and edit("<h2>B</h2>", "a", "new") is edit(None, "a", "b") is None


def test_sections_by_editor(spark):
    rows = spark.createDataFrame([(1, "markdown", "# A\nold", "a"), (2, "", "<h1>A</h1>old", "a"), (3, "markdown", None, "a"), (4, "markdown", "x", "a")], "id int, editor string, body string, heading string")
    found = {r.id: r.body for r in rows.select("id", documents.replace_section(F.col("editor"), F.col("body"), F.col("heading"), F.lit("*new*")).alias("body")).collect()}
    assert found == {1: "# A\n*new*\n", 2: "<h1>A</h1>\n<p><em>new</em></p>\n\n", 3: None, 4: None}
    texts = column(spark, "a", None)
    assert of(texts, documents.split_column(F.col("s"))) == [["a"], []] and of(texts, documents.markdown_column(F.col("s"))) == ["<p>a</p>\n", ""]


def test_edits(spark):
    one = spark.range(1)
    lit = lambda *c: of(one, F.array(*c))[0]
    assert lit(text.append_text(F.lit("a\n\n"), F.lit("b")), text.append_text(F.lit("a \u00a0"), F.lit("b"), F.lit(""), F.lit("<p>b</p>"))) == ["a\n\nb", "a\n<p>b</p>"]
    insert = lambda body, anchor="b": text.insert_after_line(F.lit(body), F.lit(anchor), F.lit("c"))
    assert lit(insert("a\nb"), insert("a\n b \nd\n"), insert("a\r\nb\r\nd"), insert("a"), insert("")) == ["a\nb\nc\n", "a\n b \nc\nd", "a\nb\nc\nd", None, None]
    strip = lambda body, name="T t": text.strip_dup_title(F.lit(body), F.lit(name))
    found = lit(strip("#t T\n\nx "), strip("<h1>T t</h1>\n x"), strip("<h1>T t</h1>  x"), strip("## T t\nx"), strip("# T t u\nx"), strip("#", ""), strip(" <h1 a>É</h1>x", "é"))
    assert found == ["x", " x", "  x", "## T t\nx", "# T t u\nx", "", " <h1 a>É</h1>x"]
    valid = lambda *s: lit(*[text.valid_description(F.lit(x)) for x in s])
    assert valid("test suites for the parser", "none of the above here", "fixme write this later", "xxx what goes in here", "N/A for this shelf now", "short", "todos of the whole team") == [True, True, False, False, False, False, True]


def test_roles_that_see_everything(spark):
    roles = spark.createDataFrame(list(enumerate([["page-view-all"], ["chapter-view-all"], ["book-view-all"], ["content-export"], ["bookshelf-view-all"], [], None])), "role_id int, permissions array<string>")
    assert sorted(r.role_id for r in acl.role_context(roles).collect()) == [0, 1, 2, 3]


def test_popular_targets_are_not_joined_with_themselves(spark):
    edges = spark.range(3000).select(F.col("id").alias("source_page_id"), F.lit(5000).cast("long").alias("target_page_id"))
    pages = spark.range(2, 6000).select(F.col("id").alias("page_id"))
    found = graph.co_linked(edges, pages)
    near = {}
    for r in found.collect():
        near.setdefault(r.page_id, []).append(r.neighbour_id)
    assert len(near) == 3000 and sorted(near[0]) == list(range(2, 12)) and sorted(near[5]) == [2, 3, 4, 6, 7, 8, 9, 10, 11, 12]


def test_chains_do_not_grow_the_plan(spark):
    rows = [(i, i - 1 if i % 40 else None) for i in range(400)]
    found = jobs.chain_lengths(spark.createDataFrame(rows, "id long, retry_of long"))
    assert {r.id: r.chain for r in found.collect()} == {i: i % 40 + 1 for i, _ in rows}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3


def test_numbering(spark):
    from atheneum.sources.staging import numbered

    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), F.col("id").alias("y"))
    assert all(r.pos == r.x + 1 for r in numbered(rows, "x").collect()) and all(r.pos == 1000 - r.x for r in numbered(rows, "x", descending=True).collect())
    assert numbered(rows.limit(0), "x").count() == 0


def test_claim(spark):
    queue = spark.createDataFrame([(1, "succeeded", 1, "a"), (3, "pending", None, None), (2, "pending", None, None)], "id long, status string, started_at long, worker_id string")
    after = jobs.claim(queue, "w", 50)
    assert sorted(map(tuple, after.collect())) == [(1, "succeeded", 1, "a"), (2, "running", 50, "w"), (3, "pending", None, None)]
    assert [tuple(r) for r in jobs.claim(queue.filter("id = 1"), "w", 50).collect()] == [(1, "succeeded", 1, "a")]


def test_one_bad_page_fails_alone(spark):
    def picky(dims):
        def embed(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return models.hashing_embedder(dims)(texts)

        return embed

    pages = spark.createDataFrame([(i, 1, None, f"p{i}", f"p{i}") for i in range(5)], "page_id long, book_id long, chapter_id long, name string, slug string")
    books, chapters, shelves = spark.createDataFrame([(1, "b", 1)], "book_id long, name string, shelf_id long"), spark.createDataFrame([], "chapter_id long, name string"), spark.createDataFrame([(1, "s")], "shelf_id long, name string")
    raw = spark.createDataFrame([(0, "<p>good</p>"), (1, "<p>bad</p>"), (2, ""), (9, "<p>who</p>")], "page_id long, html string")
    done, results = ingest.attempt(raw, books, chapters, shelves, pages, 4, picky)
    assert {r.page_id: r.error for r in results.collect()} == {0: None, 1: "ValueError: bad text", 2: None, 9: "page not in the index"}
    assert [r.page_id for r in done.chunks.collect()] == [0] and sorted(r.page_id for r in done.pages.collect()) == [0, 2]
    assert sorted(r.scope for r in ingest.retry_scopes(results).collect()) == ["page:1", "page:9"]


def test_ten_failures_in_a_row_end_a_job(spark):
    rows = lambda bad: spark.range(100).select(F.col("id").alias("page_id"), F.when(bad, "e").alias("error"))
    apart, together = rows(F.col("id") % 11 == 0), rows(F.col("id").between(30, 45) | (F.col("id") == 3))
    assert tuple(ingest.outcome(apart).first()) == (100, 10, False, "failed") and ingest.aborted_after(apart) is None
    assert tuple(ingest.outcome(together).first()) == (40, 11, True, "failed") and ingest.aborted_after(together) == 39
    assert ingest.retry_scopes(together).count() == 0 and tuple(ingest.outcome(rows(F.col("id") < 9)).first()) == (100, 9, False, "succeeded")


def test_the_cascade_reranks_last(spark):
    vector = [1.0, 0.0]
    chunks = spark.createDataFrame([(i, i, [1.0, i / 10]) for i in range(6)], "chunk_id long, page_id long, embedding array<double>")
    pages = spark.createDataFrame([(i, 1, None, False, f"n{i}", 1, True) for i in range(6)], "page_id long, book_id long, chapter_id long, deleted boolean, name string, acl_computed_at long, acl_default_open boolean")
    edges, acls = spark.createDataFrame([], "source_page_id long, target_page_id long, link_type string"), spark.createDataFrame([], "page_id long, role_id long")
    hits = spark.createDataFrame([], "page_id long, kind string, pos long")
    texts = spark.createDataFrame([(4, "h", "red fox"), (2, "", "fox")], "chunk_id long, heading string, content string")
    found = search.cascade(chunks, texts, pages, edges, acls, hits, vector, "red fox", 3, 0.1)
    assert [(r.page_id, r.rerank) for r in found.collect()] == [(4, 1.0), (2, 0.5), (0, 0.0)]


def test_markdown():
    html = documents.markdown_to_html("# T\n\nA **b** `c<d` [x](/y)\n\n- [x] one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx < 1\n```\n")
    for part in ("<h1>T</h1>", "<strong>b</strong>", "<code>c&lt;d</code>", '<a href="/y">x</a>', "checked", "<td>2</td>", "x &lt; 1"):
        assert part in html


def column(spark, *values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"s {kind}")


def of(df, expression):
    return [r[0] for r in df.select(expression.alias("x")).collect()]


def test_text_columns(spark):
    df = column(spark, "a \t\n b c\n\nd", "<p>x<", "", None)
    assert of(df, text.normalize_ws(F.col("s"))) == ["a b c\nd", "<p>x<", "", None]
    assert of(df, text.strip_tags(F.col("s")))[1:] == ["x", "", None]
    links = column(spark, '<a href="/books/a/page/b">1</a><a href="https://h/link/42">2</a><a href="https://h/books/x">3</a>', None)
    assert of(links, text.extract_links(F.col("s"))) == [["/books/a/page/b", "/link/42"], None]
    years = column(spark, "Journal Archive - 2025", " Journal Archive-1899", "Journal Archive - 20255", None)
    assert of(years, text.archive_year(F.col("s"))) == [2025, None, None, None]
    assert of(column(spark, " 2024-13-40 ", "2024-1-01", None), text.iso_date(F.col("s"))) == ["2024-13-40", None, None]


def test_acl_prefilter(spark):
    pages = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 1, True), (5, None, False)], "page_id long, acl_computed_at long, acl_default_open boolean")
    rows = spark.createDataFrame([(1, 10), (2, 20)], "page_id long, role_id long")
    assert {r.page_id: r.verdict for r in acl.prefilter(pages, rows, [10]).collect()} == {1: "allow", 2: "deny", 3: "default_open", 5: "uncomputed"}
    assert {r.page_id: r.verdict for r in acl.prefilter(pages, rows, []).collect()}[1] == "deny"


def test_vectors(spark):
    chunks = spark.createDataFrame([(1, 10, [1.0, 0.0, 0.0]), (2, 20, [0.5, 0.5, 0.0]), (3, 30, [0.0, 1.0, 0.0]), (4, 40, [0.9, 0.1, 0.0]), (5, 50, [0.0, 0.0, 0.0])], "chunk_id long, page_id long, embedding array<float>")
    assert [r.chunk_id for r in vectors.vector_topk(chunks, [1.0, 0.0, 0.0], 10, 0.5).collect()] == [1, 4, 2]
    whole = [1.0, -2.5, 0.0, 3.1415927, 3.4028234663852886e38, -3.4028234663852886e38]
    back = spark.createDataFrame([(whole,), (None,)], "v array<float>").select(vectors.unpack(vectors.pack(F.col("v"))).alias("v")).collect()
    assert back[0][0] == pytest.approx(whole) and back[1][0] is None


def test_cascade_settings():
    assert search.Multipliers.of([8, 6, 4, 2]) == search.Multipliers(8, 6, 4, 2)
    assert search.Multipliers.of([1, 2, 3, 4]) == search.Multipliers.of([4, 3, 2, 0]) == search.Multipliers.of([]) == search.Multipliers(4, 3, 2, 1)
    assert (search.pool(10, 4), search.pool(0, 4), search.pool(5, 0)) == (40, 1, 5)
    assert search.parse_mode(None) == search.parse_mode("default") == "standard" and search.parse_mode("precision") == "precision"
    for bad in ("rerank", "x"):
        with pytest.raises(ValueError):
            search.parse_mode(bad)


def test_tree(spark):
    shelves = spark.createDataFrame([(100, "Personal", False)], "shelf_id long, name string, deleted boolean")
    books = spark.createDataFrame([(200, "Household", 100, False), (201, "Finance", 100, False), (202, "Drafts", None, False)], "book_id long, name string, shelf_id long, deleted boolean")
    chapters = spark.createDataFrame([(300, "Routines", 200, False)], "chapter_id long, name string, book_id long, deleted boolean")
    pages = spark.createDataFrame([(400, "Morning", 200, 300, False), (401, "Evening", 200, 300, True), (402, "Pinned Note", 200, None, False)], "page_id long, name string, book_id long, chapter_id long, deleted boolean")
    all_nodes = tree.nodes(shelves, books, chapters, pages).cache()
    ids = lambda df: {(r.kind, r.id) for r in df.collect()}
    whole = tree.directory(all_nodes)
    assert ids(whole.filter("level = 0")) == {("shelf", 100), ("shelf", 0)} and ("page", 401) not in ids(whole) and ("book", 202) in ids(whole)
    assert ids(tree.directory(all_nodes, depth=0)) == {("shelf", 100), ("shelf", 0)}
    assert ids(tree.directory(all_nodes, "book", 200, 1)) == {("book", 200), ("chapter", 300), ("page", 402)}
    for kind, id in (("shelf", 100), ("shelf", 0), ("book", 200), ("book", 202), ("chapter", 300)):
        some = tree.nodes(*tree.below(shelves, books, chapters, pages, kind, id))
        assert ids(tree.directory(some, kind, id)) == ids(tree.directory(all_nodes, kind, id))
    with pytest.raises(LookupError, match="book 9999"):
        tree.directory(all_nodes, "book", 9999)
    allowed = spark.createDataFrame([(402,)], "page_id long")
    once = tree.prune(tree.directory(all_nodes, "shelf", 100), allowed)
    assert ids(once) == {("shelf", 100), ("book", 200), ("book", 201), ("page", 402)} == ids(tree.prune(once, allowed))
    assert '"name":"Household","children":[{"kind":"chapter"' in tree.to_json(tree.directory(all_nodes, "shelf", 100)).first().tree
    assert tree.parse_scope({"book": "7"}) == ("book", 7) and tree.parse_scope({}) == ("all", None)
    for bad in ({"book": 1, "shelf": 2}, {"book": "x"}):
        with pytest.raises(ValueError):
            tree.parse_scope(bad)


def test_jobs(spark):
    log = [(1, 1, "claim", None, None, 10), (1, 2, "cancel", None, None, 11), (1, 3, "complete", None, None, 12), (2, 1, "claim", None, None, 20), (2, 2, "progress", 7, None, 21), (2, 3, "fail", None, "e", 22), (3, 1, "claim", None, None, 30), (3, 2, "complete", None, None, 31), (4, 1, "complete", None, "broke", 40)]
    rows = jobs.fold(spark.createDataFrame(log, "id long, seq int, kind string, progress long, error string, happened long")).collect()
    # What succeeds or is cancelled is resolved by that; what fails stays open.
    assert {r.id: tuple(r)[1:] for r in rows} == {
        1: ("cancelled", 0, None, 11, "cancelled", 11), 2: ("failed", 7, "e", 22, None, None), 3: ("succeeded", 0, None, 31, "succeeded", 31), 4: ("failed", 0, "broke", 40, None, None),
    }
    queue = spark.createDataFrame([(1, "a", "failed", None, None), (2, "a", "succeeded", None, None), (3, "b", "failed", None, None)] + [(10 + i, "c", "failed", 9 + i if i else None, None if i == 5 else "retried") for i in range(6)], "id long, scope string, status string, retry_of long, resolved_status string")
    assert {r.id: r.decision for r in jobs.reconcile(queue).collect()} == {1: "superseded", 3: "retried", 15: "gave_up"}
    made = {r.scope: (r.id, r.is_new) for r in jobs.create_dedup(queue, spark.createDataFrame([("b",), ("new",), ("a",)], "scope string")).collect()}
    assert made["b"] == (3, False) and made["a"] == (1, False) and made["new"][1] and made["new"][0] > 15


QUEUE = "id long, scope string, status string, retry_of long, started_at long, worker_id string, resolved_status string, resolved_at long"


def test_closing_keeps_or_overwrites_how_a_job_was_resolved(spark):
    queue = spark.createDataFrame([(1, "page:1", "succeeded", None, 1, "w", "succeeded", 5), (2, "page:2", "failed", None, 1, "w", None, None), (3, "page:3", "running", None, 1, "w", None, None)], QUEUE)
    closed = jobs.close(queue, spark.createDataFrame([(1, None), (2, "retried")], "id long, resolved string"))
    assert {r.id: (r.status, r.prev_status, r.resolved_status, r.resolved_at) for r in closed.collect()} == {1: ("closed", "succeeded", "succeeded", 5), 2: ("closed", "failed", "retried", None), 3: ("running", None, None, None)}
    again = jobs.close(closed, spark.createDataFrame([(1, "gave_up")], "id long, resolved string"))  # what is closed stays as it is
    assert {r.id: (r.prev_status, r.resolved_status) for r in again.collect()}[1] == ("succeeded", "succeeded")
    assert {r.id for r in jobs.archivable(queue, 5).collect()} == {1} and jobs.archivable(queue, 4).isEmpty()


def test_a_failed_job_with_a_successor_is_superseded_two_rounds_later(spark):
    queue = spark.createDataFrame([(1, "page:7", "running", None, 1000, "w2", None, None), (2, "page:7", "succeeded", None, 1000, "w2", "succeeded", 1100), (3, "page:8", "running", None, 4900, "w1", None, None)], QUEUE)
    one = jobs.settled(jobs.housekeep(queue, 4500))  # job 2 is closed, not lost; job 1 has not run too long yet
    assert {r.id: (r.status, r.prev_status) for r in one.collect()} == {1: ("running", None), 2: ("closed", "succeeded"), 3: ("running", None)}
    two = {r.id: (r.status, r.resolved_status, r.error) for r in jobs.housekeep(one, 4700).collect()}
    assert two == {1: ("closed", "superseded", "timeout"), 2: ("closed", "succeeded", None), 3: ("running", None, None)}  # the worker's own job goes on
    assert {r.id: r.status for r in jobs.recover(queue, "w1", 5).collect()}[3] == "failed"


def test_only_the_first_failure_of_a_scope_is_retried(spark):
    rows = [(i, "page:1", "failed", None, 1, "w", None, None) for i in (1, 2, 3)] + [(4, "page:2", "failed", None, 1, "w", None, None)]
    after = {r.id: (r.status, r.resolved_status, r.retry_of) for r in jobs.housekeep(spark.createDataFrame(rows, QUEUE), 50).collect()}
    assert after == {1: ("closed", "retried", None), 2: ("closed", "superseded", None), 3: ("closed", "superseded", None), 4: ("closed", "retried", None), 5: ("pending", None, 1), 6: ("pending", None, 4)}
    chain = [(i, "page:1", "closed" if i < 5 else "failed", i - 1 if i > 1 else None, 1, "w", "retried" if i < 5 else None, None) for i in range(1, 6)]
    last = [r for r in jobs.housekeep(spark.createDataFrame(chain, QUEUE), 50).collect() if r.id == 5]
    assert [(r.status, r.resolved_status) for r in last] == [("closed", "gave_up")]


def test_paged():
    assert list(paged.walk(lambda o: (list(range(o, min(o + 40, 100))), 100))) == list(range(100))
    assert list(paged.walk(lambda o: ([1, 2] if o == 0 else [], None))) == [1, 2]
    assert list(paged.walk(lambda o: ([], 5))) == [] and paged.next_offset(80, 20, 100) is None


def listing_of_25(options, offset, count):
    """A connector that gives at most 10 rows, and says how many there are if told to."""
    rows = [(i, f"page {i}") for i in range(offset, min(offset + min(count, 10), 25))]
    return rows, 25 if options.get("counts") == "yes" else None


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(paged.PagedListing)
    read = spark.read.format("paged_listing").option("connector", "tests.test_functions:listing_of_25").option("page_size", 20)
    for counts, parts in (("yes", 3), ("no", 1)):
        df = read.option("counts", counts).load()
        assert df.rdd.getNumPartitions() == parts and sorted(tuple(r) for r in df.collect()) == [(i, f"page {i}") for i in range(25)]
    spark.range(0).withColumn("name", F.lit("")).write.parquet(str(tmp_path / "none"))
    empty = spark.read.format("paged_listing").options(connector="atheneum.sources.paged:parquet_pages", path=str(tmp_path / "none"), columns="id,name").load()
    assert empty.count() == 0


def test_store(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    assert kept.read("t", "id long").count() == 0 and store.needs_initial_walk(kept)
    kept.publish("t", spark.range(3), ["id"])
    before = kept.read("t")
    kept.publish("t", kept.read("t").union(spark.range(3, 5)), ["id"])
    assert kept.read("t").count() == 5 and before.count() == 3
    with pytest.raises(ValueError):
        kept.publish("t", spark.range(2).union(spark.range(2)), ["id"])
    kept.set("last_full_walk_at", 5)
    assert kept.get("last_full_walk_at") == 5 and not store.needs_initial_walk(kept)
    wanted = {"chunk_version": 5, "embed_model": "m", "embed_dims": 64}

    def stopped():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.reindex_on_change(kept, wanted, stopped)
    assert store.needs_reindex(kept, wanted)  # what was stopped is done again
    assert store.reindex_on_change(kept, wanted, lambda: None) and not store.needs_reindex(kept, wanted) and store.needs_reindex(kept, wanted | {"embed_dims": 32})
    made = [kept.backup(str(tmp_path / "backups"), f"2024010{i}T000000", keep=2) for i in range(4)]
    left = sorted(p.name for p in (tmp_path / "backups").iterdir() if p.is_dir())
    assert left == ["backup-20240102T000000", "backup-20240103T000000"] and spark.read.parquet(f"{made[-1]}/t").count() == 5


def test_delta_walk_publishes_each_window_once(spark, tmp_path):
    source, kept, failed = tmp_path / "in", store.Store(spark, str(tmp_path / "out")), []
    rows = lambda a, b: spark.range(a, b).coalesce(1).write.mode("append").parquet(str(source))
    rows(0, 5)

    def publish(df, number):
        kept.publish("pages", tables.upsert(kept.read("pages", "id long"), df, ["id"]), ["id"], number)

    def walk():
        events.delta_walk(spark, events.files_since(spark, str(source), spark.range(1).schema), str(tmp_path / "cp"), lambda df: df.withColumn("error", F.when(F.col("id") == 3, "bad")), lambda df: failed.extend(r.id for r in df.collect()), publish)

    walk()
    rows(5, 8)
    walk()
    walk()
    assert sorted(r.id for r in kept.read("pages").collect()) == [0, 1, 2, 4, 5, 6, 7] and failed == [3]


def test_updates_stream_from_where_it_was(spark, tmp_path):
    def add(*rows):
        made = spark.createDataFrame([(i, at) for i, at in rows], "page_id long, at string").select("page_id", F.to_timestamp_ntz("at").alias("updated_at"))
        made.orderBy("updated_at", "page_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    seen, retried, broken = [], [], []

    def retry(df):
        ids = [r.page_id for r in df.collect()]
        if ids and broken:
            raise OSError("the queue is down")
        retried.extend(ids)

    def walk():
        stream = events.updates_since(spark, "page_id bigint, updated_at timestamp_ntz", "2024-01-01T00:00:00", connector="atheneum.sources.delta:ParquetDelta", path=str(tmp_path / "in"), window="2")
        events.delta_walk(spark, stream, str(tmp_path / "cp"), lambda df: df.withColumn("error", F.when(F.col("page_id") == 3, "bad")), retry, lambda df, n: seen.extend((n, r.page_id) for r in df.collect()))

    add((1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"), (3, "2024-01-02 00:00:00"), (4, "2024-01-03 00:00:00"), (5, "2024-01-03 00:00:00.5"))
    broken.append(1)
    with pytest.raises(Exception, match="queue is down"):
        walk()
    assert seen == retried == []  # nothing is taken in, nothing is passed
    broken.clear()
    walk()
    assert sorted(i for _, i in seen) == [2, 4, 5] and retried == [3]  # page 1 is not later than the start
    walk()
    add((6, "2024-01-03 00:00:00.5"), (2, "2024-02-01 00:00:00"), (7, "2023-01-01 00:00:00"))
    walk()
    assert sorted(i for _, i in seen) == [2, 2, 4, 5, 6] and retried == [3]  # later ones of the same time, and a page that changed again


def test_delta_windows_are_partitions():
    from atheneum.sources import delta

    class Keys:
        def __init__(self, options):
            self.keys = [(delta.EPOCH[0], i) for i in range(10)]

        def ends(self, after, count, upto=None):
            keys = [k for k in self.keys if k > after and (upto is None or k <= upto)]
            return [keys[min(i + count, len(keys)) - 1] for i in range(0, len(keys), count)]

    stream = delta._Stream({"window": "4", "connector": "x:y"}, ["a"])
    stream._connector = lambda: Keys(None)
    end = stream.latestOffset()
    assert [(w.after[1], w.upto[1]) for w in stream.partitions(stream.initialOffset(), end)] == [(-1, 3), (3, 7), (7, 9)]
    assert stream.latestOffset() == end and stream.partitions(end, end) == []


def test_paged_parquet_reads_only_what_is_asked_for(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for f in range(3):
        pq.write_table(pa.table({"id": list(range(f * 100, f * 100 + 100)), "name": ["x"] * 100}), str(tmp_path / f"{f}.parquet"), row_group_size=30)
    options = {"path": str(tmp_path), "columns": "id,name"}
    for offset, count in ((0, 10), (95, 10), (119, 150), (290, 50), (300, 5)):
        rows, total = paged.parquet_pages(options, offset, count)
        assert [r[0] for r in rows] == list(range(offset, min(300, offset + count))) and total == 300
    assert len(paged.parquet_pages(options | {"most": "7"}, 5, 20)[0]) == 7


def test_events_parse_and_route_as_a_stream(spark, tmp_path):
    payloads = ['{"event":"page_update","related_item":{"id":5}}', '{"event":"role_delete","related_item":{"id":2}}', '{"event":"x"}', "junk"]
    spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "event_id long, payload string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, payload string").parquet(str(tmp_path / "e")).select("event_id", events.parse(F.col("payload")).alias("p")).select("event_id", "p.*")
    books = spark.createDataFrame([], "book_id long, shelf_id long, deleted boolean")
    chapters = spark.createDataFrame([], "chapter_id long, book_id long")
    query = events.route_embed(stream, books, chapters).writeStream.format("memory").queryName("routed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.event_id, r.scope) for r in spark.table("routed").collect()} == {(0, "page:5"), (1, "delete:role:2"), (1, "acl_reconcile")}


def test_models(spark):
    docs = spark.createDataFrame([(0, "red fox"), (1, "blue fox runs"), (2, None)], "pos int, doc string")
    assert [r.pos for r in models.rerank(docs, "blue fox", "doc", 2).collect()] == [1, 0]
    with pytest.raises(ValueError):
        models.rerank(docs, " ", "doc", 2)
    assert [len(r[0]) for r in docs.select(models.embed(F.col("doc"), 8)).collect()] == [8, 8, 8]


def test_ingest_outcome(spark):
    results = spark.range(30).select(F.col("id").alias("page_id"), F.when(F.col("id") < 10, "e").alias("error"))
    assert ingest.outcome(results).first().status == "failed" and ingest.outcome(results.limit(0)).first().status == "succeeded"
    with pytest.raises(ValueError):
        ingest.in_scope("shelf:1")


def test_siblings_fall_back_to_the_book(spark):
    pages = spark.createDataFrame([(1, 1, 7, False), (2, 1, None, False), (3, 1, None, True), (4, 1, 8, False), (5, 1, 8, False)], "page_id long, book_id long, chapter_id long, deleted boolean")
    found = {}
    for r in graph.siblings(pages).collect():
        found.setdefault(r.page_id, set()).add(r.neighbour_id)
    assert found == {1: {2, 4, 5}, 2: {1, 4, 5}, 3: {1, 2, 4, 5}, 4: {5}, 5: {4}}


def test_rerank_takes_at_most_200_documents(spark):
    docs = spark.range(0, 200, 1, 7).select(F.col("id").alias("pos"), F.concat(F.lit("text "), F.col("id")).alias("doc"))
    assert [r.pos for r in models.rerank(docs, "text 199", "doc", 1).collect()] == [199]
    with pytest.raises(ValueError, match="200"):
        models.rerank(docs.unionByName(docs.limit(1)), "text 199", "doc", 1)


def test_search_texts(spark):
    rows = [(1, 0, "page", "Tea", 7, "/books/b/page/tea", "<p>Hot <b>tea</b></p>"), (1, 1, "book", "Pots", 8, None, ""), (1, 2, None, None, None, "https://x.org/y", "x" * 300)]
    results = spark.createDataFrame(rows, "request int, pos int, type string, name string, id long, url string, preview string")
    asked = spark.createDataFrame([(1, 40), (2, 0)], "request int, total int")
    found = {r.request: r.shown for r in answers.search_texts(asked, results, "https://kb.org/", total="total").collect()}
    assert found == {
        1: "Found 40 results:\n\n- [page] Tea (id: 7) — https://kb.org/books/b/page/tea\n  Preview: Hot tea\n\n- [book] Pots (id: 8)\n\n- [unknown]  (id: 0) — https://x.org/y\n  Preview: " + "x" * 200 + "\n",
        2: "No results found.",
    }


def test_success_texts(spark):
    row = spark.createDataFrame([(5, 2, "Tea", "tea", "about tea", "pots")], "id long, book long, name string, slug string, description string, book_slug string")
    c = F.col
    page = lambda **more: answers.page_success("Page created.", "https://kb.org", c("id"), c("book"), c("name"), c("slug"), **more)
    said = row.select(
        page(), page(editor=F.lit("markdown"), revision=F.lit(3), book_slug=c("book_slug")), page(url=F.lit("books/x")), answers.shelf_success("Done.", "https://kb.org", c("id"), c("name"), c("slug")),
        answers.book_success("Done.", "https://kb.org", c("id"), c("name"), c("slug"), c("description")), answers.chapter_success("Done.", "https://kb.org", c("id"), c("book"), c("name"), c("slug"), c("description"), c("book_slug")), answers.chapter_success("Done.", "https://kb.org", c("id"), c("book"), c("name"), c("slug")),
    ).first()
    last = "\nUse get_page(5) to verify content if needed."
    assert list(said) == [
        "Page created.\nPage ID: 5\nBook ID: 2\nName: Tea\nEditor: unknown\nSlug: tea\nRevision: 0" + last,
        "Page created.\nPage ID: 5\nBook ID: 2\nName: Tea\nEditor: markdown\nSlug: tea\nRevision: 3\nURL: https://kb.org/books/pots/page/tea" + last,
        "Page created.\nPage ID: 5\nBook ID: 2\nName: Tea\nEditor: unknown\nSlug: tea\nRevision: 0\nURL: https://kb.org/books/x" + last,
        "Done.\nShelf ID: 5\nName: Tea\nSlug: tea\nURL: https://kb.org/shelves/tea",
        "Done.\nBook ID: 5\nName: Tea\nSlug: tea\nDescription: about tea\nURL: https://kb.org/books/tea",
        "Done.\nChapter ID: 5\nBook ID: 2\nName: Tea\nSlug: tea\nDescription: about tea\nURL: https://kb.org/books/pots/chapter/tea",
        "Done.\nChapter ID: 5\nBook ID: 2\nName: Tea\nSlug: tea",
    ]


def test_outline(spark):
    shelves = spark.createDataFrame([(1, "Home", "All of <i>it</i>", False), (2, "Empty", None, False)], "shelf_id long, name string, description string, deleted boolean")
    books = spark.createDataFrame([(3, "Pots", 1, False, ""), (4, "Cups", 1, False, "for tea"), (5, "Lost", None, False, "")], "book_id long, name string, shelf_id long, deleted boolean, description string")
    chapters = spark.createDataFrame([(6, "Care", 3, False), (7, "Gone", 3, True)], "chapter_id long, name string, book_id long, deleted boolean")
    found = {r.shelf_id: r.outline for r in tree.outline(shelves, books, chapters).collect()}
    assert found == {1: "Shelf: Home (ID: 1) — All of it\n  Book: Cups (ID: 4) — for tea\n  Book: Pots (ID: 3)\n    Chapter: Care (ID: 6)\n\n", 2: "Shelf: Empty (ID: 2)\n\n"}


SEARCHED = {
    "chunks": ([(i, i, [1.0, i / 10]) for i in range(6)], "chunk_id long, page_id long, embedding array<double>"),
    "pages": ([(i, i % 2, None, False, f"n{i}", 1, i != 1) for i in range(6)], "page_id long, book_id long, chapter_id long, deleted boolean, name string, acl_computed_at long, acl_default_open boolean"),
    "edges": ([], "source_page_id long, target_page_id long, link_type string"), "acl": ([], "page_id long, role_id long"), "hits": ([(1, "page", 0), (4, "page", 1)], "page_id long, kind string, pos long"),
}


def test_hybrid_scope_fallback_and_rerank(spark):
    frames = {n: spark.createDataFrame(*x) for n, x in SEARCHED.items()}
    run = lambda frames=frames, **more: search.hybrid_search(frames["chunks"], frames["pages"], frames["edges"], frames["acl"], frames["hits"], [1.0, 0.0], 3, 0.5, [7], **more)
    assert 1 not in {r.page_id for r in run().collect()}  # denied
    assert {r.page_id for r in run(scope=search.Scope(books=(0,))).collect()} == {0, 2, 4} and {r.page_id for r in run(scope=search.Scope(pages=(1, 3))).collect()} == {3}
    found = run()
    texts = spark.createDataFrame([(r.best_chunk, "h", "fox" if r.page_id == 2 else "hen") for r in found.collect()], "chunk_id long, heading_path string, content string")
    after = search.reranked(found, texts, frames["pages"], "fox").collect()
    assert [r.page_id for r in after][0] == 2 and {r.page_id for r in after} == {r.page_id for r in found.collect()} and after[0].rerank == 1.0
    flat = frames | {"chunks": spark.createDataFrame([(9, 5, [0.0, 0.0])], SEARCHED["chunks"][1])}
    raw = search.hybrid_search(flat["chunks"], flat["pages"], flat["edges"], flat["acl"], flat["hits"], [1.0, 0.0], 3, 0.0, [7]).collect()
    assert [(r.page_id, r.vector, r.score, r.keyword) for r in raw] == [(5, 0.0, 0.0, 0.0)]  # only pages of the keywords were left, so the raw hits are shown


def test_results_as_json(spark):
    import json

    found = spark.createDataFrame([(1, 0.81239, 0.5, 0.05, 0.9, [(10, 0.5), (11, 0.81239)]), (2, 0.4, 0.0, 0.0, 0.4, [])], "page_id long, vector double, keyword double, blanket double, score double, chunks array<struct<chunk_id: long, score: double>>")
    pages = spark.createDataFrame([(1, "Tea", 3), (4, "Pot", 3)], "page_id long, name string, book_id long")
    texts = spark.createDataFrame([(10, "A > B", "ten"), (11, "A", "eleven")], "chunk_id long, heading_path string, content string")
    updates, near = spark.createDataFrame([(1, "2024-05-01")], "page_id long, updated_at string"), spark.createDataFrame([(1, "sibling", 4)], "page_id long, relation string, neighbour_id long")
    shown = {r.page_id: json.loads(r.result) for r in search.result_json(found, pages, texts, updates, near).collect()}
    assert shown[1] == {
        "page_id": 1, "page_name": "Tea", "book_id": 3, "score": 0.9, "updated_at": "2024-05-01", "scoring": {"vector": 0.812, "keyword": 0.5, "blanket_boost": 0.05},
        "chunks": [{"heading_path": "A", "content": "eleven", "score": 0.812}, {"heading_path": "A > B", "content": "ten", "score": 0.5}],
        "blanket": {"linked_from": [], "links_to": [], "co_linked": [], "siblings": [{"page_id": 4, "name": "Pot"}]},
    }
    assert shown[2] == {"page_id": 2, "page_name": "Unknown", "book_id": 0, "score": 0.4, "chunks": [], "scoring": {"vector": 0.4, "keyword": 0.0, "blanket_boost": 0.0}}
    again = search.result_json(found.withColumn("rerank", F.lit(0.33333)), pages, texts).filter("page_id = 1").first().result
    assert json.loads(again)["score"] == json.loads(again)["scoring"]["rerank"] == 0.333 and "updated_at" not in json.loads(again)


def test_scopes_multipliers_and_modes(spark):
    assert [search.pool(i, search.Multipliers().vector) for i in range(4)] == [1, 4, 8, 12]
    assert search.parse_mode(" Default ") == search.parse_mode(None) == "standard" and search.parse_mode("PRECISION") == "precision"
    for bad in ("rerank", "x"):
        with pytest.raises(ValueError):
            search.parse_mode(bad)
    roles = acl.caller_roles(spark.createDataFrame([(1, True), (2, True), (3, False)], "caller long, identified boolean"), spark.createDataFrame([(1, 5), (1, 5), (3, 6)], "caller long, role_id long"))
    assert {r.caller: r.roles for r in roles.collect()} == {1: [5], 2: [], 3: None}


def test_near_copies_are_nearest_to_the_trained_embedder(spark):
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
    model = TrainedEmbedder.fit(docs, 32)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    ids = [i for i in texts if shingles[i]]
    near = {i: {j for j in ids if j != i and 10 * len(shingles[i] & shingles[j]) >= 8 * len(shingles[i] | shingles[j])} for i in ids}
    vectors = {r.doc_id: np.array(r.e) for r in docs.select("doc_id", models.embed(F.col("text"), 32, model.maker(spark)).alias("e")).collect()}
    m = np.array([vectors[i] for i in ids])
    scores = m @ m.T
    np.fill_diagonal(scores, -1)
    asked = [k for k, i in enumerate(ids) if near[i]]
    assert len(asked) > 20 and all(ids[int(scores[k].argmax())] in near[ids[k]] for k in asked)
    again = TrainedEmbedder.of_table(model.table(spark))
    assert np.allclose(again(["the of and"]), model(["the of and"])) and not model([None, ""]).any()
    with pytest.raises(Exception, match="32 dimensions"):
        docs.select(models.embed(F.col("text"), 8, model.maker(spark))).collect()


def test_exploded_siblings_are_not_sent_to_all_executors(spark):
    from atheneum.plans import registry

    plan = registry.QUERIES["format_search_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    within = [x for i, line in enumerate(plan) if "BroadcastExchange" in line for x in takewhile(lambda x, line=line: depth(x) > depth(line), plan[i + 1 :])]
    assert within and not [x for x in within if "Generate explode" in x or "count(1)" in x]


def test_training_looks_words_up_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"tea{i % 7} pot cup{i % 5} Tea{i % 7}" if i % 11 else None) for i in range(60)], "doc_id long, text string")
    seen = tmp_path / "seen"

    @F.udf("string")
    def noted(text):
        with seen.open("a") as f:
            f.write("x")
        return text

    model = TrainedEmbedder.fit(docs.select(noted.asNondeterministic()("text").alias("text")), 4)
    assert len(seen.read_text()) == 60
    assert abs(float((model(["tea1 pot", None])[0] ** 2).sum()) - 1) < 1e-5 and not model([None]).any()
