"""An exact vector index: cells around centres, each with its angular radius, read in the order of what they can hold at most.

By the triangle inequality on angles no vector of a cell is nearer to a query than the angle to the centre less the radius. Cells are read from the highest bound on until the k-th score
closes; cells below the threshold are not read at all. What is read is scored exactly, so the rows are those of a scan.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.log import SnapshotLog
from . import vectors

NAME = "vector-index:"
#: Cells at most, and vectors of the sample that their centres are chosen from.
CELLS, SAMPLE = 256, 4_096
#: Vectors of a cell for it to pay, about; slack for rounding in angles.
CELL_ROWS, SLACK = 128, 1e-6


def centres_of(chunks: DataFrame, most: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> np.ndarray:
    """At most so many of the vectors, each of length 1, far from one another: each the one of a bounded sample (``SAMPLE``, the smallest id hashes) that is farthest from those before it.

    They set the cells, never a result."""
    found = [r[0] for r in chunks.filter(F.size(vector_col) > 0).orderBy(F.xxhash64(id_col), id_col).select(vector_col).limit(SAMPLE).collect()]
    dims = len(found[0]) if found else 0
    m = np.array([v for v in found if len(v) == dims and None not in v], float).reshape(-1, dims)
    length = np.linalg.norm(m, axis=1)
    good = np.isfinite(length) & (length > 0)
    unit = m[good] / length[good, None]
    picked, near = [0] if len(unit) else [], unit @ unit[0] if len(unit) else np.zeros(0)
    while len(picked) < min(most, len(unit)) and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[picked[-1]])
    return unit[picked]


def placed(rows: DataFrame, centres: np.ndarray, id_col: str, vector_col: str) -> DataFrame:
    """``rows`` with ``cell``, the number of the nearest centre, and ``angle`` to it; -1 and pi where a vector has no length or another number of components."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            column = batch.column(vector_col)
            cell, angle = np.full(len(column), -1, np.int32), np.full(len(column), math.pi)
            whole = np.diff(column.offsets.to_numpy()) == (centres.shape[1] or -1)
            at = np.flatnonzero(whole & column.is_valid().to_numpy(zero_copy_only=False))
            if len(at) and len(centres):
                m = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
                length = np.linalg.norm(m, axis=1)
                good = np.isfinite(length) & (length > 0)
                cosine = np.clip(m[good] / length[good, None] @ centres.T, -1, 1)
                cell[at[good]], angle[at[good]] = cosine.argmax(axis=1), np.arccos(cosine.max(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    schema = rows.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)}).schema
    return rows.mapInArrow(run, schema)


class VectorIndex:
    def __init__(self, log: SnapshotLog, name: str = "chunks"):
        self.log, self.spark, self.name = log, log.spark, name

    def build(self, chunks: DataFrame) -> int:
        """The index of these chunks (chunk_id, page_id, embedding), whatever there was before: also what follows a change of width."""
        folder = f"{self.name}/{uuid.uuid4().hex}"
        centres = centres_of(chunks, max(1, min(CELLS, -(-chunks.count() // CELL_ROWS))))
        rows = placed(chunks.select("chunk_id", "page_id", "embedding"), centres, "chunk_id", "embedding")
        rows.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{self.log.root}/{folder}")
        entry = {"folder": folder, "centres": centres.tolist(), "schema": rows.drop("cell").schema.json()}
        cells = self._rows(entry).groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # CELLS rows at most
        entry["cells"] = [[r.cell, r.radius, r.n] for r in cells]
        return self.log.transact(lambda _: {NAME + self.name: entry})

    def _rows(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"])).add("cell", "integer")).parquet(f"{self.log.root}/{entry['folder']}")

    def topk(self, query: list[float], limit: int, threshold: float) -> tuple[DataFrame, dict[str, int]]:
        """As ``vectors.vector_topk``, and how many cells and vectors there are and were read."""
        entry = self.log.state()[1][NAME + self.name]
        centres, q = np.array(entry["centres"], float), np.array(query, float)
        length = float(np.linalg.norm(q))
        angles = np.arccos(np.clip(centres @ (q / length), -1, 1)) if length and centres.shape[-1:] == q.shape else None

        def bound(cell: int, radius: float) -> float:
            if cell < 0 or angles is None:
                return 0.0 if angles is not None else 1.0
            return math.cos(max(0.0, angles[cell] - radius - SLACK))

        cells = sorted(((bound(c, r), c, n) for c, r, n in entry["cells"]), reverse=True)
        rows, heads, seen = self._rows(entry), [], 0
        for b, c, n in cells:
            if seen >= limit or b < threshold:
                break
            heads.append(c)
            seen += n

        def scan(which: list[int]) -> DataFrame:
            return vectors.vector_topk(rows.filter(F.col("cell").isin(which)), query, limit, threshold)

        first = scan(heads).collect() if heads else []
        least = max(threshold, first[-1].score) if len(first) == limit else threshold
        more = [c for b, c, _ in cells if b >= least and c not in heads]
        found = self.spark.createDataFrame(first, "chunk_id long, page_id long, score double")
        if more:
            found = found.unionByName(scan(more))
        sizes = {c: n for _, c, n in cells}
        stats = {"cells": len(cells), "read": len(heads) + len(more), "vectors": sum(sizes.values()), "scored": sum(sizes[c] for c in [*heads, *more])}
        return found.orderBy(F.desc("score"), "chunk_id").limit(limit), stats
