"""What filters do to a corpus and to each other, from a packed bitmap index.

Each document gets one bit a filter (it fails it) and one a label (known good, known toxic). Within a partition the bits of a batch of documents are
packed into NumPy bitsets, one a filter, one a label and one a part of the corpus. For each subset of the filters the documents that pass all of it are an AND-NOT of
bitsets, and a popcount with the bitset of a part, and with that of a label, gives how many there are. A prefix of an order of filters is a subset, so these 2^filters counts
a part, summed over partitions, hold everything about every order: what a filter removes at its step, what an earlier one had removed already, what no other would have
removed, and the filter's Shapley value, its removals summed over all orders. Only counts leave a partition.

Filters look at one text (``TEXT_FILTERS``) but for the last, E, which fails a text that a smaller document id has too; it is settled by the texts' digests, of which only those
that occur under several ids are joined back.

Cases: a null text is empty; a null id comes before all others and has no label; rows repeated with one id count each and are no copies of each other; a document with several labels
has each that any of them gives; labels of unknown documents count nowhere; a null part is the empty string; an empty table gives an empty result; long texts are read whole; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, slices, tidy, written

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
#: Letters of the filters in the order of their bits; the labels' bits follow.
LETTERS = "ABCDE"
GOOD, TOXIC = 5, 6
SUBSETS = 1 << len(LETTERS)
#: Parts that a task counts before it hands their sums on.
MAX_PARTS = 5_000
COUNT_SCHEMA = "part string, subset int, kept long, good long, toxic long"
REPORT_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < MIN_WORDS


def few_distinct(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)


def many_capitals(text: bytes, words: list[bytes]) -> bool:
    codes = np.frombuffer(text, np.uint8)
    points = len(codes) - np.count_nonzero((codes & 0xC0) == 0x80)
    return 100 * np.count_nonzero((codes - 65) < 26) > MAX_CAPITAL_PERCENT * points


def holds_symbol(text: bytes, words: list[bytes]) -> bool:
    return any(s in text for s in SYMBOLS)


TEXT_FILTERS: tuple[Callable[[bytes, list[bytes]], bool], ...] = (few_words, few_distinct, many_capitals, holds_symbol)


def text_failures(text: bytes) -> int:
    """The bits of the filters that look at the text alone."""
    words = text.split()  # at ASCII white space
    return sum(f(text, words) << i for i, f in enumerate(TEXT_FILTERS))


def marks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc, part, digest, fails) for each row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.as_py() or b"" for t in batch.column("text")]
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            fails = pa.array([text_failures(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), pa.array(digests, pa.binary()), fails], names=["doc", "part", "digest", "fails"])

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).cast("binary").alias("text"),
    )
    return rows.mapInArrow(tidy(judge), "doc long, part string, digest binary, fails int")


def with_copies_and_labels(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(part, bits): the failures with that of the copies, and the labels. Only texts under several ids, and labelled documents, are joined; both joins are equi-joins that adaptive execution can split."""
    firsts = rows.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("digest", "first")
    known = labels.select(F.col(id_col).cast("long").alias("doc"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("doc IS NOT NULL AND (good OR toxic)")
    known = known.groupBy("doc").agg(F.max(F.coalesce("good", F.lit(False))).cast("int").alias("good"), F.max(F.coalesce("toxic", F.lit(False))).cast("int").alias("toxic"))
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).cast("int")
    bits = F.col("fails") + copy * (1 << len(TEXT_FILTERS)) + F.coalesce("good", F.lit(0)) * (1 << GOOD) + F.coalesce("toxic", F.lit(0)) * (1 << TOXIC)
    return rows.join(written(firsts, "first-copies"), "digest", "left").join(written(known, "labels"), "doc", "left").select("part", bits.cast("int").alias("bits"))


def prefix_counts(bits: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """For each part, subset of filters and (all, good, toxic): how many documents pass the subset. ``bits``: a byte a document; ``members``: a packed bitset a part."""
    planes = np.packbits(bits[None, :] >> np.arange(8, dtype=np.uint8)[:, None] & 1, axis=1)
    alive = np.empty((SUBSETS, planes.shape[1]), np.uint8)
    alive[0] = np.packbits(np.ones(len(bits), np.uint8))
    for subset in range(1, SUBSETS):
        lowest = (subset & -subset).bit_length() - 1
        alive[subset] = alive[subset & (subset - 1)] & ~planes[lowest]
    of_label = np.stack([np.full_like(planes[0], 255), planes[GOOD], planes[TOXIC]])
    return np.stack([np.bitwise_count(alive[:, None, :] & (of_label & m)[None, :, :]).sum(axis=2, dtype=np.int64) for m in members])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        table = np.stack(list(sums.values())).reshape(-1, 3)
        names = pa.array([p for p in sums for _ in range(SUBSETS)], pa.string())
        subsets = pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(sums)))
        return pa.RecordBatch.from_arrays([names, subsets, *(pa.array(table[:, i]) for i in range(3))], names=["part", "subset", "kept", "good", "toxic"])

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part").dictionary_encode()
        codes = parts.indices.to_numpy(zero_copy_only=False)
        found = prefix_counts(batch.column("bits").to_numpy().astype(np.uint8), [np.packbits(codes == i) for i in range(len(parts.dictionary))])
        for name, counts in zip(parts.dictionary.to_pylist(), found, strict=True):
            sums[name] = sums[name] + counts if name in sums else counts
        if len(sums) > MAX_PARTS:
            yield rows()
            sums.clear()
    if sums:
        yield rows()


ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: For each order and step the subset before it and its filter.
_FILTERS = np.array([[LETTERS.index(c) for c in o] for o in ORDERS])
_BEFORE = np.cumsum(1 << _FILTERS, axis=1) - (1 << _FILTERS)


def order_report(counts: np.ndarray) -> list[np.ndarray]:
    """The eight figures of each order and step, flat, from one part's (subset, kind) counts."""
    before, after = counts[_BEFORE], counts[_BEFORE | 1 << _FILTERS]
    lost = before - after
    alone, others = 1 << np.arange(len(LETTERS)), SUBSETS - 1 - (1 << np.arange(len(LETTERS)))
    failing = counts[0, 0] - counts[alone, 0]
    unique = counts[others, 0] - counts[SUBSETS - 1, 0]
    shapley = np.bincount(_FILTERS.ravel(), lost[:, :, 0].ravel(), len(LETTERS)) if lost.max(initial=0) < 2**40 else np.array([sum(map(int, lost[:, :, 0][_FILTERS == f])) for f in range(len(LETTERS))])
    figures = (after[:, :, 0], lost[:, :, 0], failing[_FILTERS] - lost[:, :, 0], unique[_FILTERS], lost[:, :, 1], lost[:, :, 2], shapley.astype(np.int64)[_FILTERS])
    return [x.ravel() for x in figures]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, steps = len(ORDERS), len(LETTERS)
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            counts = np.array([[c["kept"], c["good"], c["toxic"]] for c in cells], np.int64)
            columns = [pa.array([part] * n * steps, pa.string()), pa.array([o for o in ORDERS for _ in range(steps)], pa.string()), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), n))]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, order_report(counts))], names=[c.split()[0] for c in REPORT_SCHEMA.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the five filters, and step."""
    rows = written(marks(docs, id_col, text_col, part_col), "filter-marks")
    counts = with_copies_and_labels(rows, labels, id_col).mapInArrow(tidy(_count), COUNT_SCHEMA).groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")))
    cells = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("cells"))  # SUBSETS rows a part
    return cells.mapInArrow(tidy(_report), REPORT_SCHEMA)
