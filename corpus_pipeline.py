"""From raw documents to token ids: quality rules, near-duplicate removal, repeated passages, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns rows for the next; all but the last keep the columns of ``documents``. Between stages
the rows are written as Parquet to the shared folder and read again, so a stage that fails is run again alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.llm import byte_bpe, jaccard_trie, quality_cascade, source_mixing, suffix_dedup
from atheneum.llm.common import bounded_batches, load, written

#: Near duplicates: words of a shingle, percent of similarity.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Length in bytes from which a repeated passage goes, and the share of tokens that mixing keeps.
REPEAT_BYTES, MIX_BUDGET = 100, 0.8
#: Ids of dropped documents are sent to all executors up to this many; beyond it the join shuffles.
MAX_BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, with all their columns.

    A null text, and one without words, is rejected; long texts are judged whole; repeated rows share their verdict; an empty table stays empty.
    """
    bounded_batches(spark)
    return quality_cascade.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, those without an id last and then by the hash of the text.

    A document is an id with a text: different texts under one id are different documents, of repeated rows one stays. Texts without words
    are no one's near duplicates, so such rows without an id all stay.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("doc_id"), "th")
    found = written(jaccard_trie.jaccard_components(rows.select(own.alias("own"), F.col("given.text").alias("text")), NEAR_WORDS, NEAR_PERCENT, "own"), "near")
    loose = F.col("id").isNull() & ~F.coalesce(F.col("given.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if not found.filter("NOT own.none OR n_shingles > 0").groupBy("own").count().filter("count > 1").isEmpty():
        rows = rows.filter(loose).unionByName(rows.filter(~loose).dropDuplicates(["id", "th"]))
    gone = found.filter("own > component_id").select(F.col("own.doc_id").alias("gone_id"), F.col("own.th").alias("gone_th")).distinct()
    small = gone.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return rows.join(F.broadcast(gone) if small else gone, (F.col("th") == F.col("gone_th")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti").select("given.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document, or an earlier part of the same one, has already said; ``n_chars`` follows.

    A null text stays null, with a null ``n_chars``; texts under the length lose nothing; a row without an id comes before all others; rows of one id and text are one document;
    an empty table stays empty; other columns are as they were.
    """
    return suffix_dedup.cleaned(docs, REPEAT_BYTES).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights.

    Null sources and languages are a value of their own; a document without tokens is drawn as its cell is; repeated rows share their fate; an empty table stays empty;
    other columns are as they were.
    """
    return source_mixing.mixed(docs, MIX_BUDGET)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids; the texts are those that the ids decode to.

    A null text becomes an empty one without ids; texts of any length are encoded whole; repeated rows stay; other columns than those named are dropped; an empty table stays empty.
    """
    encoded = byte_bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.decode("decoded", "UTF-8").alias("text"), "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("source_mixing", mixing),
    ("byte_bpe", encoding),
]

#: SQL has no suffix arrays, tries or merges by rank; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
