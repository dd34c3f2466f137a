"""Retrieval: keyword ranks, blending, the one-pass hybrid search and the narrowing cascade."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import staging
from ..sources.staging import settled
from . import acl as acl_ops
from . import graph, models, tables, vectors

MAX_LIMIT, HYBRID_THRESHOLD, VECTOR_THRESHOLD = 100, 0.45, 0.50
MAX_RERANK = 200


@dataclass(frozen=True)
class Multipliers:
    """How many times the limit each stage of the cascade keeps."""

    vector: int = 4
    keyword: int = 3
    blanket: int = 2
    rerank: int = 1

    @classmethod
    def of(cls, values: list[int] | None = None, env: str = "CASCADE_MULTIPLIERS") -> Multipliers:
        """Given or from the environment (comma-separated); the defaults unless all are at least 1 and none is larger than the one before."""
        if values is None:
            try:
                values = [int(x) for x in os.environ.get(env, "").split(",") if x.strip()]
            except ValueError:
                values = []
        ok = len(values) == 4 and min(values) >= 1 and all(a >= b for a, b in zip(values, values[1:], strict=False))
        return cls(*values) if ok else cls()


def pool(limit: int, multiplier: int) -> int:
    return max(limit * multiplier, limit, 1)


def parse_mode(mode: str | None) -> str:
    name = (mode or "").strip().lower()
    if name in ("", "standard", "default"):
        return "standard"
    if name == "precision":
        return "precision"
    if name == "rerank":
        raise ValueError("mode 'rerank' is now an option: use rerank=True with mode 'standard', or mode 'precision'")
    raise ValueError(f"unknown search mode {mode!r}: use 'standard' or 'precision'")


def keyword_decay(hits: DataFrame) -> DataFrame:
    """(page_id, keyword): 1 - position / number of hits, over hits of all types (pos from 0); pages only, without id 0."""
    rows = hits.select("page_id", "kind", "pos").join(F.broadcast(hits.agg(F.count("*").alias("total"))))
    return rows.filter("kind = 'page' AND page_id <> 0").groupBy("page_id").agg(F.max(1.0 - F.col("pos") / F.col("total")).alias("keyword"))


def keyword_scope(keyword: DataFrame, pages: DataFrame, books: list[int], page_ids: list[int]) -> DataFrame:
    """Keyword rows of the pages or of pages in the books; all, where neither is given."""
    if not books and not page_ids:
        return keyword
    rows = keyword.join(pages.select("page_id", "book_id"), "page_id", "left")
    return rows.filter(F.col("page_id").isin(list(page_ids)) | F.coalesce(F.col("book_id").isin(list(books)), F.lit(False))).select(*keyword.columns)


def bm25(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of the documents with a word of the query. Documents are read and tokenised once: lengths and counts are settled before they are summed up and scored."""
    words = sorted(set(query.lower().split()))
    tokens = docs.select("doc_id", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("tokens"))

    def times(word: str) -> Column:
        return F.size(F.filter("tokens", lambda x: x == F.lit(word)))

    rows = settled(tokens.select("doc_id", F.size("tokens").alias("len"), *[times(w).alias(f"tf{i}") for i, w in enumerate(words)]))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(words))])

    def part(i: int) -> Column:
        idf = F.log(1.0 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}").cast("double")
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).otherwise(0.0)

    score = sum((part(i) for i in range(len(words))), F.lit(0.0))
    return rows.filter(sum((F.col(f"tf{i}") for i in range(len(words))), F.lit(0)) > 0).join(F.broadcast(stats)).select("doc_id", score.alias("score"))


def best_chunks(hits: DataFrame) -> DataFrame:
    """(page_id, vector, best_chunk, chunks): per page the best score, its chunk, and all chunks, best first."""
    one = F.struct(F.col("score"), (-F.col("chunk_id")).alias("neg"), F.col("chunk_id"))
    chunks = F.transform(F.sort_array(F.collect_list(one), asc=False), lambda s: F.struct(s["chunk_id"].alias("chunk_id"), s["score"].alias("score")))
    return hits.groupBy("page_id").agg(F.max("score").alias("vector"), F.max(one)["chunk_id"].alias("best_chunk"), chunks.alias("chunks"))


def standard_blend(vector: Column, keyword: Column, boost: Column) -> Column:
    return F.when((vector > 0) & (keyword > 0), 0.7 * vector + 0.2 * keyword + boost).otherwise(vector + boost)


def boost(strong: Column, weak: Column) -> Column:
    return F.least(0.05 * strong, F.lit(0.15)) + F.least(0.02 * weak, F.lit(0.06))


def boosts(edges: DataFrame, pages: DataFrame, scored: DataFrame, hits: DataFrame) -> DataFrame:
    """(page_id, blanket) of the scored pages."""
    counts = graph.strong_weak(graph.blanket(edges, pages, scored), scored, hits)
    rows = scored.select("page_id").join(counts, "page_id", "left")
    zero = F.lit(0)
    return rows.select("page_id", boost(F.coalesce("strong", zero), F.coalesce("weak", zero)).alias("blanket"))


def keyword_only_dropped(scored: DataFrame) -> DataFrame:
    return scored.filter("vector > 0 OR keyword = 0")


def visible(scored: DataFrame, pages: DataFrame, acl: DataFrame, roles: list[int] | None) -> DataFrame:
    """Without pages that the roles may not see; pages that are open by default or not computed stay."""
    if roles is None:
        return scored
    denied = acl_ops.prefilter(pages, acl, roles).filter("verdict = 'deny'").select("page_id")
    return scored.join(denied, "page_id", "left_anti")


def merged_scores(best: DataFrame, keyword: DataFrame) -> DataFrame:
    rows = best.join(keyword, "page_id", "full_outer")
    return rows.select("page_id", F.coalesce("vector", F.lit(0.0)).alias("vector"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"), "best_chunk", "chunks")


@dataclass(frozen=True)
class Scope:
    """Books and pages that a search is limited to; with neither it is not."""

    books: tuple[int, ...] = ()
    pages: tuple[int, ...] = ()


def hybrid_search(chunks: DataFrame, pages: DataFrame, edges: DataFrame, acl: DataFrame, keyword_hits: DataFrame, query: list[float], limit: int = 10, threshold: float = HYBRID_THRESHOLD, roles: list[int] | None = None, scope: Scope = Scope()) -> DataFrame:
    """(page_id, vector, keyword, blanket, score, best_chunk, chunks): vectors, keyword ranks and the link graph blended in one pass.

    Both signals fetch twice the limit, within the scope; permissions come before the graph; pages found by keywords alone count as neighbours but are not results. Where nothing is left
    although there were hits, the pages of the raw hits that may be seen are the results, by their vector scores.
    """
    limit = min(max(limit, 1), MAX_LIMIT)
    own = tables.scoped(chunks, pages, books=list(scope.books), page_ids=list(scope.pages))
    hits = staging.pool(vectors.vector_topk(own, query, 2 * limit, threshold), 2 * limit)
    first = staging.pool(keyword_hits.filter(F.col("pos") < 2 * limit).select("page_id", "kind", "pos"), 2 * limit)
    keyword = keyword_scope(keyword_decay(first), pages, list(scope.books), list(scope.pages))
    best = best_chunks(hits)
    scored = staging.pool(visible(merged_scores(best, keyword), pages, acl, roles), 4 * limit)
    found = keyword_only_dropped(scored)
    if found.isEmpty() and not hits.isEmpty():
        raw = visible(best, pages, acl, roles).withColumns({"keyword": F.lit(0.0), "blanket": F.lit(0.0), "score": F.col("vector")})
        return final_top(raw, limit).select("page_id", "vector", "keyword", "blanket", "score", "best_chunk", "chunks")
    out = found.join(boosts(edges, pages, scored, hits), "page_id").withColumn("score", standard_blend(F.col("vector"), F.col("keyword"), F.col("blanket")))
    return final_top(out, limit).select("page_id", "vector", "keyword", "blanket", "score", "best_chunk", "chunks")


def reranked(found: DataFrame, texts: DataFrame, pages: DataFrame, words: str, scorer=models.overlap_scorer) -> DataFrame:
    """The results of a search in the order of a reranker, which reads the best chunk of each; ``rerank`` is its score. No page comes in or goes out."""
    empty = F.lit("")
    rows = found.join(texts, F.col("best_chunk") == F.col("chunk_id"), "left").join(pages.select("page_id", "name"), "page_id", "left")
    doc = rerank_document(F.coalesce("name", empty), F.coalesce("heading_path", empty), F.coalesce("content", empty))
    docs = rows.select(*found.columns, F.struct(-F.col("score"), F.col("page_id")).alias("pos"), doc.alias("doc"))
    return models.rerank(docs, words, "doc", MAX_LIMIT, scorer).select(*found.columns, "rerank")


def final_top(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of the highest score, ties to the smaller page."""
    return scored.orderBy(F.desc("score"), "page_id").limit(n)


def trim_pool(scored: DataFrame, n: int, by: Column | None = None) -> DataFrame:
    return scored.orderBy(F.desc(F.col("vector") if by is None else by), "page_id").limit(n)


def cascade_stages(chunks: DataFrame, pages: DataFrame, edges: DataFrame, acl: DataFrame, keyword_hits: DataFrame, query: list[float], limit: int = 10, threshold: float = HYBRID_THRESHOLD, roles: list[int] | None = None, multipliers: Multipliers = Multipliers()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pools after vectors, keywords, and permissions with the graph; each narrower than the one before, none widening it."""
    limit = min(max(limit, 1), MAX_LIMIT)
    widest = max(pool(limit, multipliers.vector), 20)
    hits = staging.pool(vectors.vector_topk(chunks, query, pool(limit, multipliers.vector), threshold), widest)
    first = trim_pool(best_chunks(hits), pool(limit, multipliers.vector))
    keyword = keyword_decay(staging.pool(keyword_hits.filter(F.col("pos") < widest).select("page_id", "kind", "pos"), widest))
    second = first.join(keyword, "page_id", "left").withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))
    second = trim_pool(second, pool(limit, multipliers.keyword), 0.6 * F.col("vector") + 0.4 * F.col("keyword"))
    third = staging.pool(visible(second, pages, acl, roles), widest)
    third = third.join(boosts(edges, pages, third, hits), "page_id")
    third = third.withColumn("score", 0.55 * F.col("vector") + 0.25 * F.col("keyword") + F.col("blanket"))
    return first, second, trim_pool(third, pool(limit, multipliers.blanket), F.col("score"))


def cascade(chunks: DataFrame, texts: DataFrame, pages: DataFrame, edges: DataFrame, acl: DataFrame, keyword_hits: DataFrame, query: list[float], words: str, limit: int = 10, threshold: float = HYBRID_THRESHOLD, roles: list[int] | None = None, multipliers: Multipliers = Multipliers(), scorer=models.overlap_scorer) -> DataFrame:
    """(page_id, best_chunk, rerank, score): all four stages. The last reranks the best chunk of each page left, ``texts`` (chunk_id, heading, content), of the
    ``MAX_RERANK`` pages with the best vector scores; a chunk without a text counts as empty."""
    limit = min(max(limit, 1), MAX_LIMIT)
    third = cascade_stages(chunks, pages, edges, acl, keyword_hits, query, limit, threshold, roles, multipliers)[2]
    best = third.orderBy(F.desc("vector"), "page_id").limit(MAX_RERANK)
    rows = best.join(texts, F.col("best_chunk") == F.col("chunk_id"), "left").join(pages.select("page_id", "name"), "page_id", "left")
    empty = F.lit("")
    doc = rerank_document(F.coalesce("name", empty), F.coalesce("heading", empty), F.coalesce("content", empty))
    docs = rows.select("page_id", "best_chunk", "score", F.struct(-F.col("score"), F.col("page_id")).alias("pos"), doc.alias("doc"))
    return models.rerank(docs, words, "doc", pool(limit, multipliers.rerank), scorer).select("page_id", "best_chunk", "rerank", "score")


def rerank_document(page_name: Column, heading: Column, content: Column) -> Column:
    """What a reranker reads of a chunk."""
    with_heading = F.concat(page_name, F.lit(" — "), heading, F.lit("\n\n"), content)
    return F.when(F.coalesce(heading, F.lit("")) != "", with_heading).otherwise(F.concat(page_name, F.lit("\n\n"), content))


def trim_match(text: Column, most: int = 200) -> Column:
    """(text, truncated): at most so many characters, an ellipsis after a cut."""
    cut = F.length(text) > most
    return F.struct(F.when(cut, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text).alias("text"), cut.alias("truncated"))


def result_json(found: DataFrame, pages: DataFrame, texts: DataFrame, updates: DataFrame | None = None, blankets: DataFrame | None = None) -> DataFrame:
    """(page_id, result): the results as JSON. Scores have three decimals; the chunks that were hit carry heading and content (of ``texts``: chunk_id, heading_path, content), best first.

    A ``rerank`` of ``found`` goes into the scoring and is the score; ``updates`` (page_id, updated_at) and, in verbose answers, ``blankets`` (page_id, relation, neighbour_id) add their
    fields, which are left out where there is nothing."""
    three = lambda c: F.round(c, 3)
    hits = found.select("page_id", F.explode_outer("chunks").alias("c")).select("page_id", "c.chunk_id", F.col("c.score").alias("chunk_score")).join(texts, "chunk_id")
    one = F.struct((-F.col("chunk_score")).alias("o"), "chunk_id", F.struct("heading_path", "content", three(F.col("chunk_score")).alias("score")).alias("chunk"))
    chunks = hits.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["chunk"]).alias("of_chunks"))
    rows = found.join(pages.select("page_id", F.col("name").alias("page_name"), "book_id"), "page_id", "left").join(chunks, "page_id", "left")
    if updates is not None:
        rows = rows.join(updates.select("page_id", "updated_at"), "page_id", "left")
    reranked = "rerank" in found.columns
    scoring = F.struct(three(F.col("vector")).alias("vector"), three(F.col("keyword")).alias("keyword"), three(F.col("blanket")).alias("blanket_boost"), *([three(F.col("rerank")).alias("rerank")] if reranked else []))
    none = F.array().cast("array<struct<heading_path: string, content: string, score: double>>")
    fields = [
        F.col("page_id"), F.coalesce("page_name", F.lit("Unknown")).alias("page_name"), F.coalesce("book_id", F.lit(0).cast("long")).alias("book_id"), three(F.col("rerank" if reranked else "score")).alias("score"),
        F.coalesce("of_chunks", none).alias("chunks"), scoring.alias("scoring"),
    ]
    if updates is not None:
        fields.append(F.col("updated_at"))
    if blankets is not None:
        near = blankets.join(pages.select(F.col("page_id").alias("neighbour_id"), "name"), "neighbour_id")
        kinds = (("linked_from", "linked_from"), ("links_to", "links_to"), ("co_linked", "co_linked"), ("sibling", "siblings"))
        lists = [F.array_sort(F.collect_list(F.when(F.col("relation") == r, F.struct(F.col("neighbour_id").alias("page_id"), "name")))).alias(name) for r, name in kinds]
        rows = rows.join(near.groupBy("page_id").agg(F.struct(*lists).alias("blanket_pages")), "page_id", "left")
        fields.append(F.col("blanket_pages").alias("blanket"))
    return rows.select("page_id", F.to_json(F.struct(*fields)).alias("result"))
