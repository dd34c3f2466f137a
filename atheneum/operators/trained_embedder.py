"""An embedder trained on the corpus: the leading directions of hashed tf-idf, by a randomised singular value decomposition.

Words are hashed to ``SLOTS``; a text is the unit vector of its slots' (1 + ln tf) * idf. The decomposition looks at the corpus a few times: each task multiplies its texts with a narrow
matrix and back and gives one row a slot, which are summed by slot; words are looked up once, into a table of slots and counts; only matrices of ``SLOTS`` rows and a few dozen columns reach the driver, whatever the corpus. The model is a small table
(slot, idf, direction), loaded once a worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import settled

SLOTS, EXTRA, ROUNDS, SEED = 4_096, 8, 2, 7
#: Texts multiplied at once; words whose slots a worker remembers.
TEXTS = 256
KNOWN_WORDS = 200_000
_WORDS = re.compile(r"\w+")


class _Slots(dict):
    """The slot of each word; the first so many words of a worker are remembered."""

    def __missing__(self, word: str) -> int:
        slot = zlib.crc32(word.encode()) % SLOTS
        if len(self) < KNOWN_WORDS:
            self[word] = slot
        return slot


_SLOTS = _Slots()


def bags_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many slots each text has, these slots, and how often its words fall into each."""
    counted = [np.bincount(np.fromiter(map(_SLOTS.__getitem__, words), np.int64, len(words)), minlength=SLOTS) for words in (_WORDS.findall((t or "").lower()) for t in texts)]
    slots = [np.flatnonzero(c) for c in counted]
    sizes = np.fromiter(map(len, slots), np.int64, len(slots))
    return sizes, np.concatenate([*slots, np.zeros(0, np.int64)]), np.concatenate([*(c[s] for c, s in zip(counted, slots, strict=True)), np.zeros(0, np.int64)])


def matrix_of(sizes: np.ndarray, slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A row of ``SLOTS`` weights for each text, of length 1 unless it has no word."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weight = (1 + np.log(counts)) * idf[slots]
    length = np.sqrt(np.bincount(owner, weight**2, len(sizes)))
    out = np.zeros((len(sizes), SLOTS))
    out[owner, slots] = weight / np.maximum(length[owner], 1e-12)
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, looked up once for all rounds: (slots, counts)."""
    for batch in batches:
        sizes, slots, counts = bags_of(batch.column(0).to_pylist())
        ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (slots, counts)], names=["slots", "counts"])


def _summed(bags: DataFrame, part: Callable[[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray], None], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all texts of ``part``, a matrix: a row each of a task's sums is shuffled, and as many as the matrix has come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                slots, counts = (batch.column(i).slice(at, TEXTS) for i in (0, 1))
                part((np.diff(slots.offsets.to_numpy()), slots.flatten().to_numpy(), counts.flatten().to_numpy()), total)
        some = np.flatnonzero(total.any(axis=1))
        columns = [pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "sums"])

    sums = bags.mapInArrow(run, "row long, sums array<double>").select("row", F.posexplode("sums").alias("at", "x")).groupBy("row", "at").agg(F.sum("x").alias("x"))
    out = np.zeros(shape)
    for r in sums.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("cells")).collect():
        out[r.row] = [c.x for c in r.cells]
    return out


class TrainedEmbedder:
    def __init__(self, idf: np.ndarray, directions: np.ndarray):
        self.idf, self.directions = idf, directions

    @classmethod
    def fit(cls, docs: DataFrame, dims: int, text_col: str = "text") -> TrainedEmbedder:
        """From all texts of ``docs``. The random start is fixed, so the same corpus gives the same model to rounding."""
        context = docs.sparkSession.sparkContext
        bags = settled(docs.select(text_col).mapInArrow(_bags, "slots array<int>, counts array<int>"))

        def count(texts: tuple, total: np.ndarray) -> None:
            total[:, 0] += np.bincount(texts[1], minlength=SLOTS)

        df = _summed(bags, count, (SLOTS, 1))[:, 0]
        idf = np.log((1 + bags.count()) / (1 + df)) + 1e-3
        width = dims + EXTRA
        q = np.linalg.qr(np.random.default_rng(SEED).normal(size=(SLOTS, width)))[0]
        for _ in range(ROUNDS):
            shared = context.broadcast((idf, q))

            def back(texts: tuple, total: np.ndarray, shared=shared) -> None:
                idf, q = shared.value
                rows = matrix_of(*texts, idf)
                total += rows.T @ (rows @ q)

            q = np.linalg.qr(_summed(bags, back, (SLOTS, width)))[0]
        shared = context.broadcast((idf, q))

        def gram(texts: tuple, total: np.ndarray) -> None:
            idf, q = shared.value
            inner = matrix_of(*texts, idf) @ q
            total += inner.T @ inner

        _, vectors = np.linalg.eigh(_summed(bags, gram, (width, width)))
        return cls(idf, q @ vectors[:, ::-1][:, :dims])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        found = matrix_of(*bags_of(texts), self.idf) @ self.directions
        length = np.linalg.norm(found, axis=1, keepdims=True)
        return np.divide(found, length, out=np.zeros_like(found), where=length > 1e-12).astype(np.float32)

    def maker(self, spark) -> Callable[[int], Callable]:
        """For ``models.embed`` and ``ingest``: the model is broadcast, and made once per worker."""
        shared = spark.sparkContext.broadcast((self.idf, self.directions))

        def make(dims: int) -> Callable:
            if dims != shared.value[1].shape[1]:
                raise ValueError(f"the model has {shared.value[1].shape[1]} dimensions, not {dims}")
            return TrainedEmbedder(*shared.value)

        return make

    def table(self, spark) -> DataFrame:
        """(slot, idf, direction): the model, to be kept."""
        return spark.createDataFrame([(i, float(x), d.tolist()) for i, (x, d) in enumerate(zip(self.idf, self.directions, strict=True))], "slot int, idf double, direction array<double>")

    @classmethod
    def of_table(cls, rows: DataFrame) -> TrainedEmbedder:
        found = rows.orderBy("slot").collect()  # SLOTS rows
        return cls(np.array([r.idf for r in found]), np.array([r.direction for r in found]))
