"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their first four and five letters, hashed to 32 bits; beginnings that come again have further terms for each power of two that
their number reaches and each of ``SHARES`` that they are of all words, so that one chance word and a stem used throughout differ. The machine sums a weight for
each term present and, through low-rank factors, one for each pair of terms present, so that a pair can weigh what its
parts alone do not. The linear time form of the pair sum is used.

Training reads a bounded sample of labelled documents on the driver (``MAX_TOXIC`` and ``MAX_CLEAN``, those
of the smallest id hashes); clean documents together weigh at most ``CLEAN_WEIGHT`` times what the toxic ones do. It keeps the terms, ``TERMS`` at most, that tell the labels
apart beyond chance: of the terms kept a share of ``FALSE_TERMS`` at most is expected to differ by chance alone (Benjamini and Hochberg, on chi-squared tests), whatever the sample's size. Weights and factors are fitted by AdaGrad. Every document is scored over its whole text.

Cases: null and empty texts get the score of a text without known terms; repeated rows get equal scores; a label that is null or a document with both labels
is not learned from; of several texts of one id that of the smallest hash is learned from; with one label only, or none, every score is the share of toxic ones (0 if there is none); other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

MAX_TOXIC, MAX_CLEAN, TERMS, FACTORS, EPOCHS, MIN_DOCS = 2_000, 4_000, 4_096, 8, 40, 3
CLEAN_WEIGHT, FALSE_TERMS = 4.0, 0.01
#: Shares of a text's words, each as one in so many.
SHARES = (100, 50, 25)
_WORDS = re.compile(r"[^\W\d_]+")


def beyond_chance(gain: np.ndarray, tested: np.ndarray) -> np.ndarray:
    """Places of the tested terms, best first, whose chi-squared (one degree of freedom) holds at a false discovery rate of ``FALSE_TERMS``."""
    at = np.flatnonzero(tested)
    at = at[np.argsort(-gain[at], kind="stable")]
    p = np.array([math.erfc(math.sqrt(g / 2)) for g in gain[at]])
    holds = np.flatnonzero(p <= FALSE_TERMS * np.arange(1, len(p) + 1) / max(len(p), 1))
    return at[: holds[-1] + 1] if len(holds) else at[:0]


def terms_of(text: str | None) -> set[int]:
    """Hashes of the distinct terms."""
    words = _WORDS.findall((text or "").lower())
    counts = Counter(words)
    begins: Counter[str] = Counter()
    for w, n in counts.items():
        if len(w) > 4:
            begins[f"4{w[:4]}"] += n
            if len(w) > 5:
                begins[f"5{w[:5]}"] += n
    names = [*counts, *begins]
    for b, n in begins.items():
        if n > 1:
            names += [f"{k}x{b}" for k in range(1, n.bit_length())]
        names += [f"{s}r{b}" for s in SHARES if n * s >= len(words)]
    return {zlib.crc32(x.encode()) for x in names}


class FactorizationMachine:
    def __init__(self, terms: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.linear, self.factors = terms, bias, linear, factors
        self.slot = {int(t): i for i, t in enumerate(terms)}

    @staticmethod
    def raw(rows: list[np.ndarray], bias: float, linear: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Scores before the logistic function."""
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        first = np.bincount(owner, linear[flat], len(rows))
        sums = np.stack([np.bincount(owner, factors[flat, f], len(rows)) for f in range(factors.shape[1])], axis=1)
        squares = np.bincount(owner, (factors**2).sum(axis=1)[flat], len(rows))
        return bias + first + 0.5 * ((sums**2).sum(axis=1) - squares)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        get = self.slot.get
        rows = [np.array(sorted(s for s in map(get, terms_of(t)) if s is not None), np.int64) for t in texts]
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, self.bias, self.linear, self.factors), -30, 30)))

    @classmethod
    def train(cls, docs: list[tuple[str, int]], seed: int = 11) -> FactorizationMachine:
        y = np.array([label for _, label in docs], float)
        if not 0 < y.sum() < len(y):
            share = float(np.clip(y.mean(), 1e-9, 1 - 1e-9)) if len(y) else 1e-9
            return cls(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
        found = [np.sort(np.fromiter(terms_of(t), np.int64)) for t, _ in docs]
        every, n = np.unique(np.concatenate(found), return_counts=True)
        some, k = np.unique(np.concatenate([f for f, label in zip(found, y, strict=True) if label]), return_counts=True)
        toxic = np.zeros(len(every))
        toxic[np.searchsorted(every, some)] = k
        rate = y.mean()
        gain = (toxic - n * rate) ** 2 / (n * rate * (1 - rate))
        terms = np.sort(every[beyond_chance(gain, n >= MIN_DOCS)[:TERMS]])
        weight = np.where(y == 1, 1.0, min(1.0, CLEAN_WEIGHT * rate / (1 - rate)))
        weight /= weight.mean()
        rows = [np.searchsorted(terms, f[np.isin(f, terms)]) for f in found]
        rng = np.random.default_rng(seed)
        bias, linear, factors = 0.0, np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS))
        sum_b, sum_l, sum_f = 1e-6, np.full(len(terms), 1e-6), np.full((len(terms), FACTORS), 1e-6)
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 500)):
                own = [rows[i] for i in part]
                flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(r) for r in own])
                error = weight[part] * (y[part] - 1 / (1 + np.exp(-np.clip(cls.raw(own, bias, linear, factors), -30, 30))))
                sums = np.stack([np.bincount(owner, factors[flat, f], len(own)) for f in range(FACTORS)], axis=1)
                size = len(part)
                g = error.mean()
                sum_b += g * g
                bias += 0.1 * g / np.sqrt(sum_b)
                g_l = np.bincount(flat, error[owner], len(terms)) / size - 2e-5 * linear
                sum_l += g_l**2
                linear += 0.1 * g_l / np.sqrt(sum_l)
                pull = error[owner, None] * (sums[owner] - factors[flat])
                g_f = np.stack([np.bincount(flat, pull[:, f], len(terms)) for f in range(FACTORS)], axis=1) / size - 2e-4 * factors
                sum_f += g_f**2
                factors += 0.02 * g_f / np.sqrt(sum_f)
        return cls(terms, bias, linear, factors)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Trained on a bounded sample of the rows of ``labels`` where ``learn`` (on the id) holds; labels are looked up for these only."""
    known = labels.select(F.col(id_col), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1) & F.col(id_col).isNotNull() & learn)
    known = known.groupBy(id_col).agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    label = {}
    for value, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):  # the first of an order, which each task cuts before it sends its rows
        label |= dict.fromkeys((r[0] for r in known.filter(F.col("label") == value).orderBy(F.xxhash64(id_col), id_col).select(id_col).limit(most).collect()), value)
    # Of several texts of an id that of the smallest hash is learned from, wherever it lies.
    one = F.min(F.struct(F.xxhash64(text_col), F.col(text_col).alias("text")))["text"]
    rows = docs.filter(F.col(id_col).isin(list(label))).groupBy(id_col).agg(one).orderBy(id_col).collect() if label else []
    return FactorizationMachine.train([(r[1], int(label[r[0]])) for r in rows])


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.bias, model.linear, model.factors))  # TERMS rows at most
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(*shared.value)
        for batch in slices(batches):
            p = machine.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"`{id_col}` {kind}, score double, predicted int")
