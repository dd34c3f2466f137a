"""The main text of web pages: flat blocks, their figures and those of their neighbours, and a decision tree.

A page is cut into blocks at block-level tags (``html_blocks``). Each is described by its word count and link density, those of the block before and after it, those of the box it
stands in, and what its ancestors say they are. A decision tree, trained by MLlib on a small labelled table (``page_samples``, a fixed size), tells main text from menus, headers, footers,
sidebars, notices, adverts, forms and reader comments. The tree is a few hundred numbers; each page is classified where it lies, so nothing is shuffled.

Cases: a null page is empty; a page without main text gives an empty text; broken markup is read as browsers read it, and an unclosed comment, script or style ends the page; white space, the no-break
space included, becomes one space; long pages are read whole; repeated rows each get their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, tidy
from .html_blocks import FEATURES, Blocks
from .page_samples import COLUMNS, labelled_blocks

DEPTH, PAGES_AT_ONCE = 8, 64


class Tree(NamedTuple):
    """Nodes in arrays; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(x[inner, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.value[at]


def as_arrays(root) -> Tree:
    """The nodes of a fitted model."""
    rows: list[list[float]] = []

    def add(node) -> int:
        me = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            rows[me][:2] = split.featureIndex(), split.threshold()
            rows[me][2:4] = add(node.leftChild()), add(node.rightChild())
        return me

    add(root)
    feature, threshold, left, right, value = map(np.array, zip(*rows, strict=True))
    return Tree(feature.astype(int), threshold.astype(float), left.astype(int), right.astype(int), value > 0.5)


def fit(spark: SparkSession) -> Tree:
    """The tree of the labelled table."""
    table = spark.createDataFrame(labelled_blocks(), ", ".join(f"{c} double" for c in COLUMNS)).coalesce(1)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=DEPTH, maxBins=128, minInstancesPerNode=1, seed=1).fit(table)
    return as_arrays(model._java_obj.rootNode())


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The main text of each page; the blocks of all are classified at once."""
    blocks = [Blocks(page or "") for page in pages]
    kept = tree.predict(np.concatenate([b.features() for b in blocks])).tolist() if blocks else []
    ends = np.cumsum([0, *(len(b.texts) for b in blocks)]).tolist()
    return ["\n\n".join(t for t, k in zip(b.texts, kept[ends[i] : ends[i + 1]], strict=True) if k) for i, b in enumerate(blocks)]


def extract(pages: DataFrame, tree: Tree | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text, n_chars) of every page."""
    tree = tree or fit(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PAGES_AT_ONCE):
            texts = main_texts(batch.column("html").to_pylist(), tree)
            others = [batch.column(c) for c in (id_col, *keep)]
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, *keep, "text", "n_chars"])

    schema = pages.select(id_col, *keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return pages.select(id_col, *keep, F.col(html_col).alias("html")).mapInArrow(tidy(read), schema)
