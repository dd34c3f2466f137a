"""A positional inverted index: which documents hold a word, how often, and where, in buckets by word.

Documents are cut into segments of at most ``SEGMENT``; a word's postings in a segment are one row, with its largest count and the shortest document there, which bound what the word can
add to any score in the segment. A query opens the folders of its words' buckets only. Changed documents go into a new generation, and from then on what older ones say of them
does not count. Which generations there are is the index's value in the commit log, with their numbers of documents and words.

Document ids are unique among those of one ``build`` or ``update``. A null text, and one without a word, is a document of length 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.log import SnapshotLog, Stale

K1, B = 1.2, 0.75
SEGMENT, BUCKETS, SALTS = 512, 64, 4
#: Documents whose postings of one bucket a task sorts at most, but for the share of frequent words.
DOCS_A_SALT = 32_768
#: Segments with the highest bounds that the first pass of a top-k scores.
FIRST_SEGMENTS = 8
NAME = "text-index:"
POSTINGS = "term string, segment long, n int, max_count int, min_length int, docs array<long>, lengths array<int>, counts array<int>, ends array<int>, places array<int>"


def tokens(text: Column) -> Column:
    """The words of a text: runs of letters and digits, lowered."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def share(count: Column, length: Column, mean: float) -> Column:
    """What a word adds to a score, but for its weight."""
    count = count.cast("double")
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / F.lit(mean)))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a word and segment; postings in a segment lie by document id."""
    context, made = TaskContext.get(), 0
    part = context.partitionId() if context else 0
    for batch in batches:
        for at in range(0, batch.num_rows, SEGMENT):
            piece = batch.slice(at, SEGMENT)
            piece = piece.take(pa.array(np.argsort(piece.column("doc_id").to_numpy(), kind="stable")))
            words = piece.column("words")
            lengths = np.diff(words.offsets.to_numpy()).astype(np.int32)
            coded = words.flatten().dictionary_encode()
            term, total = coded.indices.to_numpy().astype(np.int64), int(lengths.sum())
            if not total:
                continue
            doc = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order = np.lexsort((doc, term))  # stable: places stay in order
            term, doc, place = term[order], doc[order], place[order].astype(np.int32)
            first = np.flatnonzero(np.diff(term * len(lengths) + doc, prepend=-1))  # of each (word, document)
            counts = np.diff(first, append=total).astype(np.int32)
            of_term = np.flatnonzero(np.diff(term[first], prepend=-1))
            offsets = np.append(of_term, len(first)).astype(np.int32)
            docs, sizes = piece.column("doc_id").to_numpy()[doc[first]], lengths[doc[first]]
            ends = np.append(first[1:], total) - np.repeat(first[of_term], np.diff(offsets))  # within the word's places
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (docs, sizes, counts, ends.astype(np.int32))]
            places = pa.ListArray.from_arrays(pa.array(np.append(first[of_term], total).astype(np.int32)), pa.array(place))
            columns = [
                coded.dictionary.take(pa.array(term[first][of_term])).cast(pa.string()), pa.array(np.full(len(of_term), (part << 32) + made)), pa.array(np.diff(offsets)),
                pa.array(np.maximum.reduceat(counts, of_term)), pa.array(np.minimum.reduceat(sizes, of_term)), *lists, places,
            ]
            made += 1
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in POSTINGS.split(", ")])


class TextIndex:
    def __init__(self, log: SnapshotLog, name: str = "text", buckets: int = BUCKETS):
        self.log, self.spark, self.name, self.buckets = log, log.spark, name, buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, docs: DataFrame) -> dict:
        """A generation's postings and its documents' lengths."""
        folder = f"{self.name}/{uuid.uuid4().hex}"
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("words"))
        # A word in every document is in every segment. A bucket is dealt over more tasks the more documents there are, so that none sorts more than its memory holds.
        salts = max(SALTS, -(-docs.count() // DOCS_A_SALT))
        spread = [*([self.buckets * salts] if salts > SALTS else []), F.col("bucket"), F.pmod(F.xxhash64("segment"), F.lit(salts))]
        postings = rows.mapInArrow(_segments, POSTINGS).withColumn("bucket", self._bucket(F.col("term"))).repartition(*spread).sortWithinPartitions("bucket", "term")
        postings.write.partitionBy("bucket").parquet(f"{self.log.root}/{folder}/postings")
        rows.select("doc_id", F.size("words").alias("length")).write.parquet(f"{self.log.root}/{folder}/docs")
        n, total = self._docs(folder).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return {"folder": folder, "docs": n, "words": total}

    def _docs(self, folder: str) -> DataFrame:
        return self.spark.read.schema("doc_id long, length int").parquet(f"{self.log.root}/{folder}/docs")

    def generations(self, state: dict | None = None) -> list[dict]:
        return (self.log.state()[1] if state is None else state).get(NAME + self.name, [])

    def build(self, docs: DataFrame) -> int:
        """The index of these documents (doc_id, text), whatever there was before."""
        first = self._write(docs)
        return self.log.transact(lambda _: {NAME + self.name: [first]})

    def update(self, docs: DataFrame, gone: DataFrame | None = None) -> int:
        """Adds or replaces documents, and takes out those of ``gone`` (doc_id). Only their postings are written."""
        new = self._write(docs)
        ids = self._docs(new["folder"]).select("doc_id")
        ids = ids if gone is None else ids.unionByName(gone.select(F.col("doc_id").cast("long").alias("doc_id"))).distinct()
        ids.write.parquet(f"{self.log.root}/{new['folder']}/replaced")
        replaced = self._replaced(new["folder"])
        while True:
            old = self.generations()
            n, total = self._lengths(old).join(replaced, "doc_id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            entry = new | {"docs": new["docs"] - n, "words": new["words"] - total, "replaces": True}

            def same(state: dict, old=old, entry=entry) -> dict:
                if self.generations(state) != old:
                    raise Stale
                return {NAME + self.name: [*old, entry]}

            try:
                return self.log.transact(same)
            except Stale:
                continue

    def _replaced(self, folder: str) -> DataFrame:
        return self.spark.read.schema("doc_id long").parquet(f"{self.log.root}/{folder}/replaced")

    def _current(self, rows: DataFrame, generations: list[dict]) -> DataFrame:
        """``rows`` (doc_id, generation, ...) without what a later generation replaces."""
        later = [self._replaced(g["folder"]).withColumn("_since", F.lit(i)) for i, g in enumerate(generations) if g.get("replaces")]
        for change in later:
            rows = rows.join(change, (rows.doc_id == change.doc_id) & (rows.generation < change["_since"]), "left_anti")
        return rows

    def _lengths(self, generations: list[dict]) -> DataFrame:
        rows = self.spark.createDataFrame([], "doc_id long, length int, generation int")
        for i, g in enumerate(generations):
            rows = rows.unionByName(self._docs(g["folder"]).withColumn("generation", F.lit(i)))
        return self._current(rows, generations)

    def rows_of(self, words: list[str], generations: list[dict]) -> DataFrame:
        """The words' rows; the filters on bucket and term reach the scan."""
        terms = self.spark.createDataFrame([(w,) for w in words], "term string").select(self._bucket(F.col("term"))).collect()
        out = None
        for i, g in enumerate(generations):
            path = f"{self.log.root}/{g['folder']}/postings"
            rows = self.spark.read.schema(f"{POSTINGS}, bucket int").parquet(path).filter(F.col("bucket").isin(sorted({t[0] for t in terms})) & F.col("term").isin(words))
            rows = rows.drop("bucket").withColumns({"generation": F.lit(i), "segment": F.col("segment") * 4096 + i})
            out = rows if out is None else out.unionByName(rows)
        return out

    def _postings(self, rows: DataFrame, generations: list[dict]) -> DataFrame:
        """(term, generation, doc_id, length, count), one row a word and document."""
        flat = rows.select("term", "generation", F.explode(F.arrays_zip("docs", "lengths", "counts")).alias("p"))
        return self._current(flat.select("term", "generation", F.col("p.docs").alias("doc_id"), F.col("p.lengths").alias("length"), F.col("p.counts").alias("count")), generations)

    def _weights(self, rows: DataFrame, generations: list[dict]) -> tuple[dict[str, float], float]:
        """The weight of each word and the mean length."""
        n, total = sum(g["docs"] for g in generations), sum(g["words"] for g in generations)
        if any(g.get("replaces") for g in generations):
            counted = self._postings(rows, generations).groupBy("term").agg(F.count("*").alias("df"))
        else:  # the rows' own counts; no postings are read
            counted = rows.groupBy("term").agg(F.sum("n").alias("df"))
        return {r.term: float(np.log(1.0 + (n - r.df + 0.5) / (r.df + 0.5))) for r in counted.collect()}, total / max(n, 1)

    def _scores(self, rows: DataFrame, generations: list[dict], weights: dict[str, float], mean: float) -> DataFrame:
        if not weights or not mean:
            return self.spark.createDataFrame([], "doc_id long, score double")
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("term")]
        return self._postings(rows, generations).groupBy("doc_id").agg(F.sum(weight * share(F.col("count"), F.col("length"), mean)).alias("score"))

    def search(self, query: str) -> DataFrame:
        """(doc_id, score) of all documents with a word of the query."""
        generations, words = self.generations(), sorted(set(query.lower().split()))
        if not generations or not words:
            return self.spark.createDataFrame([], "doc_id long, score double")
        rows = self.rows_of(words, generations)
        return self._scores(rows, generations, *self._weights(rows, generations))

    def top(self, query: str, k: int) -> tuple[DataFrame, dict[str, int]]:
        """The k documents of the highest scores, ties by id, and how many segments with a word of the query there are and how many were scored.

        A segment's bound is the sum of what its words can add at most. The segments of the highest bounds are scored first; then only those whose bound reaches the k-th score."""
        generations, words = self.generations(), sorted(set(query.lower().split()))
        none = self.spark.createDataFrame([], "doc_id long, score double")
        if not generations or not words:
            return none, {"segments": 0, "scored": 0}
        rows = self.rows_of(words, generations)
        weights, mean = self._weights(rows, generations)
        if not weights or not mean:
            return none, {"segments": 0, "scored": 0}
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("term")]
        bounds = rows.groupBy("segment").agg(F.sum(weight * share(F.col("max_count"), F.col("min_length"), mean)).alias("bound"))
        best = [F.desc("score"), F.col("doc_id")]
        heads = [r.segment for r in bounds.orderBy(F.desc("bound"), "segment").limit(FIRST_SEGMENTS).collect()]
        first = self._scores(rows.filter(F.col("segment").isin(heads)), generations, weights, mean).orderBy(*best).limit(k).collect()
        least = first[-1].score if len(first) == k else 0.0
        more = bounds.filter((F.col("bound") >= least * (1 - 1e-9)) & ~F.col("segment").isin(heads))
        counted = bounds.agg(F.count("*"), F.sum(((F.col("bound") >= least * (1 - 1e-9)) | F.col("segment").isin(heads)).cast("long"))).first()
        rest = self._scores(rows.join(more.select("segment"), "segment", "left_semi"), generations, weights, mean)
        found = self.spark.createDataFrame(first, "doc_id long, score double").unionByName(rest)
        return found.orderBy(*best).limit(k), {"segments": counted[0], "scored": counted[1]}

    def phrase(self, text: str) -> DataFrame:
        """(doc_id, times) of documents that hold these words one after the other."""
        generations, words = self.generations(), text.lower().split()
        if not generations or not words:
            return self.spark.createDataFrame([], "doc_id long, times int")
        rows = self.rows_of(sorted(set(words)), generations)
        flat = rows.select("term", "generation", "places", F.explode(F.arrays_zip("docs", "counts", "ends")).alias("p"))
        flat = flat.select("term", "generation", F.col("p.docs").alias("doc_id"), F.slice("places", F.col("p.ends") - F.col("p.counts") + 1, F.col("p.counts")).alias("at"))
        by_doc = self._current(flat, generations).groupBy("doc_id").agg(*[F.max(F.when(F.col("term") == w, F.col("at"))).alias(f"at{i}") for i, w in enumerate(words)])
        starts = F.col("at0")
        for i in range(1, len(words)):
            back = F.lit(i)
            starts = F.array_intersect(starts, F.transform(f"at{i}", lambda p: p - back))  # noqa: B023  used at once
        return by_doc.select("doc_id", F.size(starts).alias("times")).filter("times > 0")
