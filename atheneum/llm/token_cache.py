"""Token counts with a digest cache.

Counting tokens is the dear step, so its results are kept: a cache table holds, per (tokenizer version digest,
content digest), the number of tokens. A run joins the digests of its texts to that table, encodes each distinct
text that is missing exactly once, appends the counts, and joins again. The cache is append-only Parquet in a
folder that all executors share; a task that is run again writes the same rows.

Cases: a null text counts as empty and has 0 tokens or what the tokenizer gives for it; repeated rows each get their count; an empty
table gives an empty result and appends nothing; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: Only for looking up; the digest of the content is that of its normalised form.
_ENCODERS: dict[str, Callable[[list[str]], list[int]]] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: a changed tokenizer never meets the counts of an old one."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by the library that the file belongs to; loaded once per Python worker."""
    if path not in _ENCODERS:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _ENCODERS[path] = lambda texts: [len(model.encode(t)) for t in texts]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda texts: [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    return _ENCODERS[path]


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each digest once per task, its text compressed, so that a text with very many copies is shuffled once a task."""
    seen: set[bytes] = set()
    packer = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        digests, texts = batch.column("digest").to_pylist(), batch.column("text")
        keep = []
        for i, d in enumerate(digests):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        yield pa.RecordBatch.from_arrays(
            [pa.array([digests[i] for i in keep], pa.binary()), pa.array([packer.compress(texts[i].as_py().encode()) for i in keep], pa.binary())],
            names=["digest", "packed"],
        )


def encode_distinct(missing: DataFrame, path: str, version: str) -> DataFrame:
    """One row (version, digest, n_tokens) for each distinct digest of ``missing`` (digest, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches):
            new = {d: i for i, d in enumerate(batch.column("digest").to_pylist()) if d not in done}
            done.update(new)
            packed = batch.column("packed")
            counts = _counter(path)([unpack(packed[i].as_py()).decode() for i in new.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(new), pa.string()), pa.array(list(new), pa.binary()), pa.array(counts, pa.int64())],
                names=["version", "digest", "n_tokens"],
            )

    # Rows of a digest meet in one task: at most one from each task before, and the first is encoded.
    return missing.mapInArrow(tidy(_first_texts), "digest binary, packed binary").repartition("digest").mapInArrow(tidy(count), CACHE_SCHEMA)


def content(text: Column) -> Column:
    """The normalised content: null is empty. The tokenizers here tell all other differences apart, so nothing else is folded."""
    return F.coalesce(text, F.lit(""))


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row a digest; none where the cache was never written."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return spark.createDataFrame([], CACHE_SCHEMA)
    # Two runs at once may have appended the same digest; both counts are the same.
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("version") == version).groupBy("version", "digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``; the cache at ``cache_path`` holds all their digests afterwards."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    rows = docs.select(F.col(id_col).alias(id_col), content(F.col(text_col)).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = read_cache(spark, cache_path, version)
    missing = rows.select("digest", "text")
    if not known.isEmpty():
        missing = missing.join(known.select("digest"), "digest", "left_anti")
    encode_distinct(missing, tokenizer_path, version).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path, version).select("digest", "n_tokens")
    sized = rows.select(id_col, "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
