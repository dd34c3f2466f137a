"""Exact top-k by inner product with block-at-a-time pruning.

The candidates are cut into document-range blocks, each kept as one small matrix (the block's forward index) with each dimension's largest and smallest
value (the terms' maxima). For a query, a block's bound is the sum over dimensions of what the query could gain at most there. Blocks are visited in the order of
their bounds and scored through the matrix until the next bound falls below the query's k-th score.

So that ranges hold similar vectors and bounds are tight, documents are ordered first by the nearest of ``CENTRES`` of their own vectors (a bounded
sample, that of the smallest id hashes; it sets the order, never a result), then by id. Ranges of at most about ``GROUP`` vectors make a group, with the maxima of its blocks taken together. Two passes:

1. each query is answered within its home group, that of its nearest centre, which gives a k-th score to beat;
2. only groups whose bound reaches that score are visited: a group meets the queries it may matter to in batches of bounded size, in cells that start from the k-th
   scores of the first pass and skip blocks by the same rule. Groups without such queries, and queries without such groups, are not shuffled.

No task holds more than one group and one batch; the cells' k rows a query meet in a grouped top-k. Scores are exact integers. Where vectors point in all directions alike no bound
can skip anything, and all pairs of queries and groups are scored.

Cases: a vector that is null, empty, or holds a null or a non-finite component takes no part; rows repeated with the same id and the same vector count
once; equal scores go to the smaller id; a query with fewer than k candidates returns them all; a query's own id is
no candidate of it; vectors of different lengths are compared over no pair (they only meet those of their length); rows without an id take no part;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

#: Vectors in a block, in a group of blocks (one cell's candidates), and queries in a batch; centres that order the documents.
BLOCK, GROUP, BATCH, CENTRES = 256, 16_384, 2_048, 64
#: Bytes of groups' maxima that are sent to all executors at once; more are sent in turn.
MAX_BROADCAST_MAXIMA = 64 << 20
#: Below every score; its negative is still a long.
NO_SCORE = -(2**62)
SCHEMA = "query_id long, vec_id long, score long"


def scaled(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long"))


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, factor: int = 64) -> DataFrame:
    """(vec_id, ints), one row for each distinct pair of a usable row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("vec_id").isNotNull() & valid(F.col("v")))
    return rows.select("vec_id", scaled(F.col("v"), factor).alias("ints")).dropDuplicates(["vec_id", "ints"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which no sum of products can be rounded."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def cell_topk(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best (query id, id, score) of each query in one cell, and how many (query, block) pairs were scored. ``least``: scores below it are of no use to the query."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    kind = _exact_type(queries, rows)
    q, rows = queries.astype(kind), rows.astype(kind)
    starts = np.arange(0, len(ids), block)
    high = np.maximum.reduceat(rows, starts, axis=0) if kind is not object else np.array([rows[s : s + block].max(axis=0) for s in starts])
    low = np.minimum.reduceat(rows, starts, axis=0) if kind is not object else np.array([rows[s : s + block].min(axis=0) for s in starts])
    zero = kind(0) if kind is not object else 0
    bounds = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T
    visit = np.argsort(-bounds, axis=1, kind="stable")
    n = len(q)
    best_score = np.full((n, k), NO_SCORE)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    least = np.full(n, NO_SCORE) if least is None else least
    active, scored = np.arange(n), 0
    for step in range(len(starts)):
        at = visit[active, step]
        # A block whose bound only equals the k-th score can still hold a smaller id.
        going = bounds[active, at].astype(np.float64) >= np.maximum(best_score[active, -1], least[active])
        active, at = active[going], at[going]
        if not len(active):
            break
        scored += len(active)
        for b in np.unique(at):
            mine = active[at == b]
            span = slice(starts[b], starts[b] + block)
            got = (q[mine] @ rows[span].T).astype(np.int64)
            got_id = np.broadcast_to(ids[span], got.shape)
            got = np.where(got_id == query_ids[mine, None], NO_SCORE, got)
            score, cand = np.concatenate([best_score[mine], got], axis=1), np.concatenate([best_id[mine], got_id], axis=1)
            if score.shape[1] > 4 * k:  # ties at the border stay until the exact order below
                edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
                if int((score >= edge).sum(axis=1).max()) <= 4 * k:
                    top = np.argpartition(-score, 4 * k - 1, axis=1)[:, : 4 * k]
                    score, cand = np.take_along_axis(score, top, 1), np.take_along_axis(cand, top, 1)
            rank = np.lexsort((cand, -score), axis=1)[:, :k]
            best_score[mine], best_id[mine] = np.take_along_axis(score, rank, 1), np.take_along_axis(cand, rank, 1)
    found = (best_score > NO_SCORE) & (best_score >= least[:, None])
    return np.repeat(query_ids, found.sum(axis=1)), best_id[found], best_score[found], scored


def centres_of(candidates: DataFrame) -> dict[int, np.ndarray]:
    """By number of dimensions, the vectors of the sample, each of length 1."""
    out: dict[int, list] = {}
    for r in candidates.select("vec_id", "ints").orderBy(F.xxhash64("vec_id"), "vec_id", "ints").limit(CENTRES).collect():
        length = float(np.linalg.norm(np.array(r.ints, float)))
        if length > 0:
            out.setdefault(len(r.ints), []).append(np.array(r.ints, float) / length)
    return {d: np.array(v) for d, v in out.items()}


def near_centre(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` (vec_id, ints) with ``dims`` and ``near``, the number of the centre of the largest inner product (0 where there is none of that length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = batch.column("ints")
            dims = np.diff(ints.offsets.to_numpy())
            near = np.zeros(len(dims), np.int64)
            flat, begin = ints.values.to_numpy(zero_copy_only=False).astype(float), ints.offsets.to_numpy()[:-1]
            for d in np.unique(dims):
                if int(d) in centres:
                    at = np.flatnonzero(dims == d)
                    near[at] = (flat[begin[at][:, None] + np.arange(d)] @ centres[int(d)].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), ints, pa.array(dims.astype(np.int64)), pa.array(near)], names=["vec_id", "ints", "dims", "near"])

    return rows.select("vec_id", "ints").mapInArrow(tidy(run), "vec_id long, ints array<long>, dims long, near long")


def group_maxima(rows: DataFrame) -> DataFrame:
    """(dims, group, high, low) of rows (dims, group, ints): first in each batch, then together."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _maxima(pa.Table.from_batches([batch]), "ints", "ints").to_batches()[0] if batch.num_rows else pa.RecordBatch.from_pylist([], pa.schema(_MAXIMA))

    def _maxima(table: pa.Table, high: str, low: str) -> pa.Table:
        out = []
        for (d, g), at in _rows_by(table, "dims", "group"):
            out.append({"dims": d, "group": g, "high": _matrix(table[high].take(at)).max(axis=0).tolist(), "low": _matrix(table[low].take(at)).min(axis=0).tolist()})
        return pa.Table.from_pylist(out, pa.schema(_MAXIMA))

    schema = "dims long, group long, high array<long>, low array<long>"
    parts = rows.select("dims", "group", "ints").mapInArrow(tidy(part), schema)
    return parts.groupBy("dims", "group").applyInArrow(tidy(lambda table: _maxima(table, "high", "low")), schema)


_MAXIMA = [("dims", pa.int64()), ("group", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]


def _rows_by(table: pa.Table, *keys: str) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """The places of the rows of each combination of keys."""
    columns = [table[k].to_numpy() for k in keys]
    order = np.lexsort(columns[::-1])
    new = np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)]) if len(order) else np.zeros(0, bool)
    for places in np.split(order, np.flatnonzero(new)[1:]) if len(order) else ():
        yield tuple(int(c[places[0]]) for c in columns), places


def reached(queries: DataFrame, maxima: DataFrame) -> DataFrame:
    """(vec_id, group): for each of ``queries`` (vec_id, ints, dims, home, least) the groups of its dimensions, but its home, whose bound reaches its k-th score."""
    size = maxima.agg(F.sum(16 * F.col("dims"))).first()[0] or 0
    turns = max(1, -(-size // MAX_BROADCAST_MAXIMA))
    return reduce(DataFrame.unionAll, [_reached(queries, maxima.filter(F.pmod(F.xxhash64("group"), F.lit(turns)) == t)) for t in range(turns)])


def _reached(queries: DataFrame, maxima: DataFrame) -> DataFrame:
    table = maxima.toArrow()
    kept = {d: (table["group"].take(at).to_numpy(), _matrix(table["high"].take(at)).astype(float), _matrix(table["low"].take(at)).astype(float)) for (d,), at in _rows_by(table, "dims")}
    shared = queries.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for (d,), at in _rows_by(whole, "dims"):
                if d not in shared.value:
                    continue
                groups, high, low = shared.value[d]
                q = _matrix(whole["ints"].take(at)).astype(float)
                bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                # Sums of doubles may be rounded: what is within rounding of the score is visited.
                slack = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T * 1e-12
                going = (bounds + slack >= whole["least"].to_numpy()[at][:, None]) & (groups[None, :] != whole["home"].to_numpy()[at][:, None])
                i, j = np.nonzero(going)
                yield pa.RecordBatch.from_arrays([pa.array(whole["vec_id"].to_numpy()[at][i]), pa.array(groups[j])], names=["vec_id", "group"])

    return queries.select("vec_id", "ints", "dims", "home", "least").mapInArrow(tidy(run), "vec_id long, group long")


def grouped_rows(candidates: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, ints, dims, group) of the candidates, a group being a centre's documents or, where these are too many, a share of the ranges of their ids; and (vec_id, ints, dims, home) of the queries."""
    centres = centres_of(candidates)
    placed = near_centre(candidates, centres)
    cuts = placed.groupBy("dims", "near").agg(F.ceil(F.count("*") / GROUP).alias("cuts"))
    group = F.col("near") + CENTRES * F.pmod(F.xxhash64(F.floor(F.col("vec_id") / BLOCK)), F.coalesce("cuts", F.lit(1)))
    rows = placed.join(cuts, ["dims", "near"]).select("vec_id", "ints", "dims", group.alias("group"))
    return written(rows, "grouped"), written(near_centre(queries, centres).join(cuts, ["dims", "near"], "left").select("vec_id", "ints", "dims", group.alias("home")), "queries")


def scores(grouped: DataFrame, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each of ``pairs`` (vec_id, group) the k best of the group, at least ``least``, for that one of ``asked`` (vec_id, ints, dims, least).

    A group meets its queries in batches of bounded size; it is sent once for each, so not at all without queries."""

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        found = cell_topk(q["id"].to_numpy(), _matrix(q["ints"]), c["vec_id"].to_numpy(), _matrix(c["ints"]), k, least=q["least"].to_numpy())
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    keys = ["dims", "group", "batch"]
    batches = pairs.groupBy("group").agg(F.ceil(F.count("*") / BATCH).alias("batches"))
    batch = F.pmod(F.xxhash64("vec_id"), F.col("batches")).alias("batch")
    left = pairs.join(batches, "group").select("vec_id", "group", batch).join(asked, "vec_id").select(F.col("vec_id").alias("id"), "ints", "dims", "group", "batch", "least")
    right = grouped.join(batches, "group").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1))).drop("batches")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tidy(cell), SCHEMA)


def seeded(asked: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """``asked`` with ``least``, the k-th of the query's scores in ``first`` if there are so many. An id with several vectors has no such score, as it is not known whose they are."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = first.dropDuplicates().withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    several = asked.groupBy("vec_id").count().filter("count > 1").select("vec_id", F.lit(NO_SCORE).alias("none"))
    rows = asked.join(kth, "vec_id", "left").join(several, "vec_id", "left")
    return rows.withColumn("least", F.coalesce("none", "kth", F.lit(NO_SCORE))).drop("kth", "none")


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query; both sides as ``integer_rows`` gives them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    grouped, asked = grouped_rows(candidates, queries)
    home = asked.select("vec_id", F.col("home").alias("group")).distinct()
    first = written(scores(grouped, asked.withColumn("least", F.lit(NO_SCORE)), home, k), "home-scores")
    known = written(seeded(asked, first, k), "seeded")
    rest = scores(grouped, known, written(reached(known, written(group_maxima(grouped), "maxima")), "reached"), k)
    return first.unionByName(rest).dropDuplicates().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
