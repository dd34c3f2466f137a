"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. The rules are independent, so their order never changes the verdict, only
the work: on a bounded sample each rule's cost (CPU seconds a document) and selectivity (share rejected) are
measured, and the rules run in the order of rejections per second. A rule sees only what the rules before it let
through. The sample's size is ``SAMPLE_DOCS``; every document goes through the cascade.

The rules are of the kind published for web-scale filtering (Rae et al. 2021, table A1), as shares of words or lines;
their thresholds are looser, so that tables, lists and songs pass and only texts that are mostly junk are rejected.

Cases: a null text has no words; a text without words fails the base rules; long texts are read whole; repeated rows
get equal verdicts; an empty table gives an empty result; other columns are ignored or, in ``keep_good``, returned as they are.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

SAMPLE_DOCS, SAMPLE_FILES = 400, 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
_LETTERED = re.compile(rf"[^{SPACES}]*?[^\W\d_][^{SPACES}]*")
#: What may stand before a bullet and after an ellipsis.
BLANKS = " \t\n\f\r"


class Text:
    """A document and its words (runs without ASCII white space); what several rules need is computed once."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.encode().split()

    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that some window of three words covers that the text holds at least twice."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        counts, covered, end = Counter(windows), 0, 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    def n_lettered(self) -> int:
        """Words that hold a letter."""
        found = _LETTERED.findall(self.text)
        if self.text.isascii():
            return len(found)
        return sum(w[0].isalpha() or any(map(str.isalpha, w)) for w in found)  # the pattern also takes numerals that are no letters


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


#: Rejecting rules; a rule never sees labels, language or source.
RULES = (
    Rule("few_words", lambda t: len(t.words) < MIN_WORDS),
    Rule("repetition", lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * len(t.words)),
    Rule("word_length", lambda t: not 2 * len(t.words) <= t.word_chars() <= 20 * len(t.words)),
    Rule("symbols", lambda t: 5 * t.n_symbols() > len(t.words)),
    Rule("duplicate_lines", lambda t: 4 * t.n_dup_lines() > 3 * len(t.lines)),
    Rule("shouting", lambda t: 2 * sum(map(bytes.isupper, t.words)) > len(t.words)),
    Rule("few_letters", lambda t: 2 * t.n_lettered() < len(t.words)),
    Rule("ellipsis_lines", lambda t: 2 * sum(x.rstrip(BLANKS).endswith(("...", "…")) for x in t.lines) > len(t.lines)),
    Rule("bullet_lines", lambda t: 10 * sum(x.lstrip(BLANKS).startswith(("-", "*", "•")) for x in t.lines) > 9 * len(t.lines)),
)


def sample_texts(docs: DataFrame, text_col: str, most: int = SAMPLE_DOCS) -> list[str | None]:
    """At most so many texts from the first rows of at most ``SAMPLE_FILES`` files, which lie evenly among all files; nothing else is read.

    Rows that come from no files are taken from the first partitions."""
    texts = docs.select(F.col(text_col).alias("text"))
    files = sorted(docs.inputFiles())
    files = files[:: max(1, -(-len(files) // SAMPLE_FILES))]
    if len(files) > 1:
        try:
            rows = docs.select(F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("file"))
            parts = [rows.filter(F.col("file") == f).select("text").limit(-(-most // len(files))) for f in files]
            found = [r.text for r in reduce(DataFrame.unionAll, parts).collect()]
        except AnalysisException:  # the rows are not those of files any more
            found = []
        if found:
            return found[:most]
    return [r.text for r in texts.limit(most).collect()]


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) in the order to run them in: most rejections per second first.

    The sample is a bounded number of rows; it only sets the order.
    """
    sample = sample_texts(docs, text_col, sample_docs)
    found = []
    for rule in rules:
        began = time.thread_time()
        rejected = sum(rule.rejects(Text(t)) for t in sample)
        cost = (time.thread_time() - began) / max(len(sample), 1)
        found.append((rule.name, cost, rejected / max(len(sample), 1)))
    return sorted(found, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0]))


def first_rejection(texts: list[Text], order: list[Rule]) -> list[str | None]:
    """For each text the first rule, in this order, that rejects it; later rules only see what is left."""
    verdict: list[str | None] = [None] * len(texts)
    left = list(range(len(texts)))
    for rule in order:
        still = []
        for i in left:
            if rule.rejects(texts[i]):
                verdict[i] = rule.name
            else:
                still.append(i)
        left = still
    return verdict


def ordered(docs: DataFrame, text_col: str = "text") -> list[Rule]:
    by_name = {r.name: r for r in RULES}
    return [by_name[name] for name, _, _ in plan_cascade(docs, text_col=text_col)]


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base figures, base_failed, kept, rejected_by) for every row; ``rejected_by`` depends on the measured order."""
    names = [r.name for r in ordered(docs, text_col)]
    kind = docs.schema[id_col].dataType.simpleString()

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {r.name: r for r in RULES}
        for batch in slices(batches):
            texts = [Text(t) for t in batch.column("text").to_pylist()]
            verdict = first_rejection(texts, [by_name[n] for n in names])
            rows = [(len(t.words), t.word_chars(), t.n_symbols(), t.n_dup_lines(), t.n_repeat_words) for t in texts]
            base = [r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEAT_PERCENT * r[0] for r in rows]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *columns, pa.array(base, pa.bool_()), pa.array([v is None for v in verdict], pa.bool_()), pa.array(verdict, pa.string())],
                names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(figures), f"`{id_col}` {kind}, {BASE_SCHEMA}")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    names = [r.name for r in ordered(docs, text_col)]

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {r.name: r for r in RULES}
        for batch in slices(batches):
            verdict = first_rejection([Text(t) for t in batch.column(text_col).to_pylist()], [by_name[n] for n in names])
            yield batch.filter(pa.array([v is None for v in verdict], pa.bool_()))

    return docs.mapInArrow(tidy(good), docs.schema)
