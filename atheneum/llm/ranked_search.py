"""Ranked search of many queries over a corpus by windowed bucket scoring.

The queries' terms are the vocabulary. One pass over the texts cuts each task's documents into windows of at most ``WINDOW``, in the order of their ids, and writes a window as
one row: the documents' ids and lengths, and for each term of the vocabulary its postings (place in the window, occurrences). Counts over the windows give how many
documents hold each term. A second pass traverses the windows: a posting's share of a score does not depend on the query, so it is computed once; then for each query the shares of its
terms are added into an array of one cell a place, small enough for a core's cache, a bitset tells which places were met, and only these are read, compared with the query's
k-th score so far and pushed into its heap, then cleared. A window whose largest shares can't reach that score is passed over. A task hands on at most k documents a query.

Documents meet only in the final top k, so no document id, window or term is a hot key: windows are cut where documents lie, and two rows of one id have places of their own.
Queries are taken in blocks of about ``BLOCK_TERMS`` terms, one block for all but very many; each block reads the texts once.

Cases: texts are UTF-8; null texts, and texts without terms, are in no window and don't count as documents; queries without terms have no rows; rows of one query id are one query, with the terms of all;
a null query id is an id of its own; repeated documents are documents each; a null document id comes before others; equal scores go by ascending id;
documents with score 0 are left out; long texts are read whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, discard, scratch, slices, tidy, written

#: Documents in a window (a cell is 8 bytes: 64 KB), postings after which a window ends early, and terms of a block of queries.
WINDOW, WINDOW_POSTINGS, BLOCK_TERMS = 8_192, 2_000_000, 1_000_000
#: A second top-k step gathers the tasks' candidates of a query in so many groups first.
SALTS = 32
#: Bytes of a row group of windows, so that readers hold few windows at once.
ROW_GROUP = 16 << 20
#: ASCII letters and digits, the capitals lowered, and all bytes of other characters belong to terms; the rest parts them.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
WINDOW_SCHEMA = "n_docs long, n_terms long, docs binary, sizes binary, terms binary, starts binary, places binary, counts binary"
FOUND_SCHEMA = "item_id long, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term), each once."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [list(dict.fromkeys(terms_of(t.as_py() or b""))) for t in batch.column("text")]
            sizes = np.array([len(x) for x in found], np.int64)
            ids = batch.column("item_id").take(pa.array(np.repeat(np.arange(len(found)), sizes)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([t for x in found for t in x], pa.binary())], names=["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(distinct), "item_id long, term binary").distinct()


def window_row(ids: list[int], sizes: list[int], bags: list[Counter], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One window: its documents by id, their postings by term and place."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    lengths = np.array([len(b) for b in bags], np.int64)
    total = int(lengths.sum())
    term = np.fromiter((t for b in bags for t in b), np.int32, total)
    count = np.fromiter((n for b in bags for n in b.values()), np.uint32, total)
    at = np.repeat(place, lengths)
    by = np.lexsort((at, term))
    term = term[by]
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    arrays = (np.array(ids, np.int64)[order], np.array(sizes, np.int64)[order], term[starts], np.append(starts, total).astype(np.int32), at[by].astype(np.uint16), count[by])
    columns = [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WINDOW_SCHEMA.split(", ")])


def windows(docs: DataFrame, vocabulary: dict[bytes, int], path: str, id_col: str, text_col: str) -> DataFrame:
    """The corpus as windows of postings of the vocabulary, written to ``path``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # at most about BLOCK_TERMS terms

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        ids, sizes, bags, n_docs, n_terms, postings = [], [], [], 0, 0, 0
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                found = terms_of(text.as_py() or b"")
                if not found:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(found)
                bag = Counter(map(number, found))
                bag.pop(None, None)
                if bag:
                    ids.append(doc)
                    sizes.append(len(found))
                    bags.append(bag)
                    postings += len(bag)
                if len(ids) == WINDOW or postings >= WINDOW_POSTINGS:
                    yield window_row(ids, sizes, bags, n_docs, n_terms)
                    ids, sizes, bags, n_docs, n_terms, postings = [], [], [], 0, 0, 0
        if n_docs:
            yield window_row(ids, sizes, bags, n_docs, n_terms)

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    rows.mapInArrow(tidy(cut), WINDOW_SCHEMA).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(WINDOW_SCHEMA).parquet(path)


def term_weights(index: DataFrame, n_terms: int, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) of each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                held[np.frombuffer(terms, np.int32)] += np.diff(np.frombuffer(starts, np.int32))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "df"])

    weights = np.zeros(n_terms, np.int64)
    for term, df in index.select("terms", "starts").mapInArrow(tidy(count), "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # a row a term
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return weights


class Heaps:
    """The k best (score, document) of each query that one task has met."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]

    def least(self, item: int) -> int:
        """A score below this one is of no use to the query."""
        heap = self.heaps[item]
        return heap[0][0] if len(heap) == self.k else 1

    def push(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        if len(scores) > self.k:  # ties by id
            best = np.lexsort((docs, -scores))[: self.k]
            scores, docs = scores[best], docs[best]
        heap = self.heaps[item]
        for found in zip(scores.tolist(), (-docs.astype(object)).tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, found)
            elif found > heap[0]:
                heapq.heapreplace(heap, found)


class WindowScorer:
    """Scores windows for all queries of a block. ``queries``: the term numbers of each query."""

    def __init__(self, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.queries, self.weights, self.n_docs, self.n_terms = queries, weights, n_docs, n_terms
        self.heaps, self.cells, self.at = Heaps(len(queries), k), np.zeros(1 << 16, np.int64), np.full(len(weights), -1, np.int64)

    def visit(self, docs: np.ndarray, sizes: np.ndarray, terms: np.ndarray, starts: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        if not len(terms):
            return
        m = 50 + 50 * sizes * self.n_docs // self.n_terms
        counts, places = counts.astype(np.int64), places.astype(np.int64)
        lengths = np.diff(starts)
        shares = np.repeat(self.weights[terms], lengths) * (1_000_000_000 * counts // (1000 * counts + 20 * m[places]))
        most = np.maximum.reduceat(shares, starts[:-1])
        words = -(-len(docs) // 64)
        met = np.zeros(len(terms) * words, np.uint64)  # a bitset of places for each term
        np.bitwise_or.at(met, np.repeat(np.arange(len(terms)), lengths) * words + (places >> 6), np.uint64(1) << (places & 63).astype(np.uint64))
        met = met.reshape(len(terms), words)
        self.at[terms] = np.arange(len(terms))
        cells = self.cells
        for item, numbers in enumerate(self.queries):
            own = self.at[numbers]
            own = own[own >= 0]
            least = self.heaps.least(item)
            if not len(own) or most[own].sum() < least:
                continue
            for t in own.tolist():
                span = slice(starts[t], starts[t + 1])
                cells[places[span]] += shares[span]  # a term has a place once
            occupied = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(met[own], axis=0).view(np.uint8), bitorder="little"))
            scores = cells[occupied]
            cells[occupied] = 0
            good = scores >= least
            if good.any():
                self.heaps.push(item, scores[good], docs[occupied[good]])
        self.at[terms] = -1


def search_block(docs: DataFrame, queries: list[tuple[int | None, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, doc_id, score): of each query the k best of every task, a superset of the k best of all."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in queries for t in terms))}
    path = scratch(spark, "search-windows")
    index = windows(docs, vocabulary, path, id_col, text_col)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    numbers = [np.array([vocabulary[t] for t in terms], np.int64) for _, terms in queries]
    shared = spark.sparkContext.broadcast(([i for i, _ in queries], numbers, term_weights(index, len(vocabulary), n_docs)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, weights = shared.value
        scorer = WindowScorer(numbers, weights, n_docs, n_terms, k)
        kinds = (np.int64, np.int64, np.int32, np.int32, np.uint16, np.uint32)
        for batch in batches:
            for row in range(batch.num_rows):
                scorer.visit(*(np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in enumerate(kinds)))
        found = [(ids[i], None if -doc == NULL_ID else -doc, s) for i, heap in enumerate(scorer.heaps.heaps) for s, doc in heap]
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    out = written(index.drop("n_docs", "n_terms").mapInArrow(tidy(score), FOUND_SCHEMA), "search-found")
    discard(spark, path)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each query."""
    pairs = written(query_terms(items, item_col, item_text_col), "query-terms")
    blocks = -(-pairs.count() // BLOCK_TERMS)
    found = [docs.sparkSession.createDataFrame([], FOUND_SCHEMA)]
    for block in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        queries = [(r.item_id, [bytes(t) for t in r.terms]) for r in own.orderBy("item_id").collect()]  # one block's
        if queries:
            found.append(search_block(docs, queries, k, id_col, text_col))
    rows = reduce(DataFrame.unionAll, found).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*best))).filter(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
