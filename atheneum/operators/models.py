"""Embedding and reranking as pluggable functions over Arrow batches, with deterministic models that need no files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TEXTS, MAX_DOCUMENTS = 100, 200
_WORDS = re.compile(r"\w+")


def hashing_embedder(dims: int) -> Callable[[list[str]], np.ndarray]:
    """Signed hashed bag of words, scaled to length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in _WORDS.findall((t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1 if h >> 31 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return embed


def overlap_scorer(query: str, documents: list[str]) -> list[float]:
    """Share of the query's words that a document has."""
    words = set(_WORDS.findall(query.lower()))
    return [len(words & set(_WORDS.findall((d or "").lower()))) / max(len(words), 1) for d in documents]


def embed(text: Column, dims: int, make: Callable[[int], Callable] = hashing_embedder) -> Column:
    """The text's vector. The model is made once per Python worker and batch stream."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make(dims)
        for texts in batches:
            parts = [model(texts.iloc[i : i + MAX_TEXTS].tolist()) for i in range(0, len(texts), MAX_TEXTS)]
            yield pd.Series(list(np.concatenate(parts)) if parts else [], index=texts.index)

    return vectors(text)


def rerank(docs: DataFrame, query: str, text_col: str, top_k: int, scorer: Callable[[str, list[str]], list[float]] = overlap_scorer) -> DataFrame:
    """``docs`` (at most 200, as a pool before it bounds them; more are an error) with ``rerank``, best first, ties in the order of ``pos``."""
    if not query.strip():
        raise ValueError("reranking needs a query")
    if docs.limit(MAX_DOCUMENTS + 1).count() > MAX_DOCUMENTS:
        raise ValueError(f"reranking takes at most {MAX_DOCUMENTS} documents")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, texts.tolist()))

    return docs.withColumn("rerank", score(F.col(text_col))).orderBy(F.desc("rerank"), "pos").limit(top_k)


def try_embed(text: Column, dims: int, make: Callable[[int], Callable] = hashing_embedder) -> Column:
    """(embedding, error) of each text: where a batch fails its texts are embedded one by one, so that one bad text fails alone."""

    def attempt(model: Callable, texts: list) -> list[tuple]:
        try:
            return [(v.tolist(), None) for v in model(texts)]
        except Exception as e:
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [attempt(model, [t])[0] for t in texts]

    @F.pandas_udf("embedding array<float>, error string")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make(dims)
        for texts in batches:
            rows = [r for i in range(0, len(texts), MAX_TEXTS) for r in attempt(model, texts.iloc[i : i + MAX_TEXTS].tolist())]
            yield pd.DataFrame({"embedding": [r[0] for r in rows], "error": [r[1] for r in rows]}, index=texts.index)

    return vectors(text)
