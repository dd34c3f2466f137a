"""Vectors: cosine, exact top-k, centroids, similar pages, the packed form."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import settled

#: Vectors in a block of the pairwise join: two blocks are in memory at once.
BLOCK = 4_096
#: Vectors around which pages lie when all are compared with all.
PIVOTS = 64


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length or the two have different numbers of components."""
    below = norm(a) * norm(b)
    return F.when((below > 0) & (F.size(a) == F.size(b)), dot(a, b) / below).otherwise(0.0)


def query_cosine(v: Column, query: list[float]) -> Column:
    """Cosine with one query vector, whose length is computed once."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    below = norm(v) * F.lit(length)
    return F.when((below > 0) & (F.size(v) == len(query)), dot(v, q) / below).otherwise(0.0)


def vector_topk(chunks: DataFrame, query: list[float], limit: int, threshold: float) -> DataFrame:
    """The ``limit`` chunks of the highest cosine, at least ``threshold``; ties to the smaller id. ``chunks`` may be filtered before, so scopes reach the scan."""
    scored = chunks.select("chunk_id", "page_id", query_cosine(F.col("embedding"), query).alias("score")).filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "chunk_id").limit(limit)


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, n_chunks, sums, counts) of rows that lie by page, one for each page in a row of its rows."""
    page, n, sums, counts = None, 0, np.zeros(0), np.zeros(0, np.int64)
    done: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())))]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "n_chunks", "sums", "counts"])

    for batch in batches:
        whole = batch.schema.names == ["page_id", "embedding"]
        ids = batch.column("page_id").to_pylist()
        for i, p in enumerate(ids):
            if whole:
                values = batch.column("embedding")[i].values
                if values is None or not len(values):
                    continue
                known = values.is_valid().to_numpy(zero_copy_only=False)
                x, c, one = np.where(known, values.fill_null(0).to_numpy(zero_copy_only=False).astype(float), 0.0), known.astype(np.int64), 1
            else:
                x, c, one = np.array(batch.column("sums")[i].values), np.array(batch.column("counts")[i].values), batch.column("n_chunks")[i].as_py()
            if (p, True) != (page, n > 0):
                if n:
                    done.append((page, n, sums, counts))
                page, n, sums, counts = p, 0, np.zeros(len(x)), np.zeros(len(x), np.int64)
            if len(x) > len(sums):
                sums, counts = np.pad(sums, (0, len(x) - len(sums))), np.pad(counts, (0, len(x) - len(counts)))
            sums[: len(x)] += x
            counts[: len(x)] += c
            n += one
            if len(done) >= 1_000:
                yield flushed()
    if n:
        done.append((page, n, sums, counts))
    if done:
        yield flushed()


def _batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows of (page_id, embedding), a batch at once where its vectors are whole and of one length."""
    for batch in batches:
        column = batch.column("embedding")
        dims = np.diff(column.offsets.to_numpy())
        if not len(dims) or column.null_count or batch.column("page_id").null_count or dims.min() != dims.max() or not dims[0] or column.flatten().null_count:
            yield from _means(iter([batch]))
            continue
        m, ids = column.flatten().to_numpy().astype(float).reshape(len(dims), -1), batch.column("page_id").to_numpy()
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        sums, n = np.add.reduceat(m, starts), np.diff(starts, append=len(ids))
        offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * m.shape[1])
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (sums.ravel(), np.repeat(n, m.shape[1]))]
        yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(n), *lists], names=["page_id", "n_chunks", "sums", "counts"])


def centroids(chunks: DataFrame) -> DataFrame:
    """(page_id, n_chunks, centroid): element-wise means; missing components are passed over, and pages without a vector left out.

    Arrays are summed whole, first within each task, so that a page is shuffled as one row a task and batch at most, then together; no component is a row of its own."""
    schema = "page_id long, n_chunks long, sums array<double>, counts array<long>"
    parts = chunks.select(F.col("page_id").cast("long").alias("page_id"), "embedding").sortWithinPartitions("page_id").mapInArrow(_batch_sums, schema)
    whole = parts.repartition("page_id").sortWithinPartitions("page_id").mapInArrow(_means, schema)
    return whole.select("page_id", "n_chunks", F.zip_with("sums", "counts", lambda s, c: F.when(c > 0, s / c)).alias("centroid"))


def similar_pages(pages: DataFrame, k: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """(page_id, similar_id, score): the k pages nearest to each by cosine of their centroids, at least ``threshold``.

    Pages lie in cells around pivots, and cells that are too far apart for any pair to reach the threshold, by the triangle inequality on angles, never meet. The others meet
    in pairs of bounded blocks, each pair one task with two matrices; a block keeps k rows a page, and the blocks' best meet in a ranked window.
    """
    rows, reach = near_cells(pages, threshold, block)
    found = reach.select("cell", "part", "other", "other_part")
    left = rows.join(found, ["cell", "part"]).select(F.col("page_id").alias("a_id"), F.col("centroid").alias("a"), "cell", "part", "other", "other_part")
    right = rows.withColumnsRenamed({"cell": "other", "part": "other_part"}).join(found, ["other", "other_part"]).select(F.col("page_id").alias("b_id"), F.col("centroid").alias("b"), "cell", "part", "other", "other_part")

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        m = np.array(column.to_pylist(), float)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple = ([], [], [])
        if len(a) and len(b):
            a_ids, b_ids = a["a_id"].to_numpy(), b["b_id"].to_numpy()
            scores = unit(a["a"]) @ unit(b["b"]).T
            scores[a_ids[:, None] == b_ids[None, :]] = -2.0
            order = np.lexsort((np.broadcast_to(b_ids, scores.shape), -np.round(scores, 12)), axis=1)[:, :k]
            best = np.take_along_axis(scores, order, 1)
            keep = best >= threshold
            out = np.repeat(a_ids, keep.sum(axis=1)), b_ids[order][keep], best[keep]
        return pa.table({"page_id": pa.array(out[0], pa.int64()), "similar_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    cells = ["cell", "part", "other", "other_part"]
    scored = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(pair, "page_id long, similar_id long, score double")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(F.round("score", 12)), "similar_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def near_cells(pages: DataFrame, threshold: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``pages`` with ``cell`` and ``part``, and the pairs (cell, part, other, other_part, pairs) of parts that can hold a pair of pages at least ``threshold`` alike.

    Pivots are few, so their angles are compared on the driver; a part has at most about ``block`` pages."""
    from . import vector_index

    pages = settled(pages.select("page_id", "centroid"))
    pivots = vector_index.centres_of(pages, PIVOTS, "page_id", "centroid")
    rows = settled(vector_index.placed(pages, pivots, "page_id", "centroid"))
    cells = {r.cell: (r.radius, r.n) for r in rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}  # PIVOTS rows
    most = math.acos(min(1.0, max(-1.0, threshold))) + 1e-6
    angle = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    parts = {c: max(1, -(-n // block)) for c, (_, n) in cells.items()}
    reach = []
    for a, (ra, na) in cells.items():
        for b, (rb, nb) in cells.items():
            near = threshold <= 0 if min(a, b) < 0 else angle[a, b] - ra - rb <= most  # a vector without length is like none
            if near:
                reach += [(a, i, b, j, na * nb // (parts[a] * parts[b])) for i in range(parts[a]) for j in range(parts[b])]
    spread = F.create_map(*[F.lit(x) for c, n in parts.items() for x in (c, n)])[F.col("cell")] if parts else F.lit(1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id"), spread.cast("long")).cast("int")).drop("angle")
    return rows, pages.sparkSession.createDataFrame(reach, "cell int, part int, other int, other_part int, pairs long")


@F.pandas_udf(T.BinaryType())
def pack(vectors: pd.Series) -> pd.Series:
    """Components as little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack(blobs: pd.Series) -> pd.Series:
    """The components; bytes that make no whole float at the end are dropped."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))
