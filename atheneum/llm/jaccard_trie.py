"""N-gram Jaccard join with a prefix tree.

A document is the set of its word n-grams. Sets are put into a prefix tree in one global order of n-grams, frequent
ones first, so that near copies share long paths. A set is compared with all sets in the tree by one traversal: the
overlap of a path is counted once for all sets below it, and a subtree is left out when the overlap so far and what
remains of either side cannot reach the threshold, by length bounds kept in the nodes, or when all sets in it are already
known to be linked with the probe.

To deal the work out, linked sets must meet in a task. In the global order rare elements come first; how many sets have an element is found by an exchange of
compressed hashes between blocks of distinct sets. Linked sets share an element of their prefixes
(Chaudhuri et al. 2006), and as most sets have enough elements of their own to fill the prefix, few have a candidate at all. Sets that share
a prefix element form candidate groups; the connected components of these are joined exactly, each by one tree, or, if large, by
slices of bounded size of which only the sets not linked to the component's hub travel to the other slices.

Sets are compared by 64-bit hashes of their n-grams, and equal sets are one node (its key hashes the set).

Cases: null texts and texts without words have empty sets and link with nothing; texts with fewer words than n have their whole word sequence as their
one element; texts are read whole; equal texts and repeated rows share a component; an empty table gives an empty result; other columns are ignored.
A null id takes no part in the smallest id of a component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_BYTES, discard, scratch, text_parts, tidy, written
from .components import connected_components

U = np.uint64
#: Elements in the sets of one slice of a large group.
SLICE_ELEMENTS = 2_000_000
#: Packed bytes of text in a block of distinct sets.
BLOCK_BYTES = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(17).integers(0, 2**64, 256, dtype=U)
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.random.default_rng(19).integers(0, 2**64, 64, dtype=U) | U(1)
_POWERS: list[np.ndarray] = [np.zeros(0, U), np.zeros(0, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(HASH_BYTES * 5 // 4, n)
        _POWERS[0] = np.cumprod(np.full(size, _BASE, U))
        _POWERS[1] = np.cumprod(np.full(size, pow(_BASE, -1, 2**64), U))
    return _POWERS[0], _POWERS[1]


def ngram_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of all texts, and the text each belongs to; sorted by text, then hash."""
    joined = np.frombuffer(b"\n".join(t.translate(_LOWER) for t in texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[joined]
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if not len(start):
        return np.zeros(0, U), np.zeros(0, np.int64)
    up, down = _powers(len(joined))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[joined] * up[: len(joined)])])
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    doc = np.searchsorted(ends, start, side="right")
    hashes, owner = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    if len(word) >= n:
        whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
        hashes.append(mix(sum((word[k : len(word) - n + 1 + k] * _PLACE[k] for k in range(n)), U(0)))[whole])
        owner.append(doc[: len(doc) - n + 1][whole])
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.concatenate([first, [len(doc)]]))
    for size in range(1, n):  # the whole sequence of a short text
        at = first[count == size]
        hashes.append(mix(sum((word[at + k] * _PLACE[k] for k in range(size)), U(0)) + U(size)))
        owner.append(doc[at])
    h, d = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], d[new]


def set_keys(h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and key (a hash of the set; 0 for the empty one) of the sets of n texts."""
    size = np.bincount(d, minlength=n)
    key = np.zeros(n, U)
    some = np.flatnonzero(size)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        key[some] = mix(np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), starts) + size[some].astype(U))
    return size, key.view(np.int64)


class PrefixTree:
    """Sets of ranked elements; ``link`` puts a set in and unites it with all sets it is similar to."""

    __slots__ = ("percent", "parent", "root", "sizes")

    def __init__(self, percent: int):
        self.percent = percent
        self.parent: list[int] = []  # of sets, as a union-find forest
        self.sizes: list[int] = []
        #: A node is [elements on the way from its parent, children by first element, sets ending here, smallest and largest size below, label].
        #: The label is a set with which all sets below are linked, or -1.
        self.root = [(), {}, [], 1 << 60, 0, -2]

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def new(self, size: int) -> int:
        self.parent.append(len(self.parent))
        self.sizes.append(size)
        return len(self.parent) - 1

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def needed(self, a: int, b: int) -> int:
        """Smallest overlap of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def probe(self, me: int, elements: list[int]) -> None:
        """Unites ``me`` with each set in the tree that is similar to it."""
        size, find, percent = len(elements), self.find, self.percent
        low, high = -(-size * percent // 100), size * 100 // percent
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, i, overlap, depth = stack.pop()
            if node[4] < low or node[3] > high:
                continue
            if node[5] >= 0 and find(node[5]) == find(me):
                continue
            need = self.needed(size, max(node[3], low))
            most = min(node[4], high)
            gone = False
            for x in node[0]:
                while i < size and elements[i] < x:
                    i += 1
                if i < size and elements[i] == x:
                    overlap += 1
                    i += 1
                depth += 1
                if overlap + min(size - i, most - depth) < need:
                    gone = True
                    break
            if gone:
                continue
            for other in node[2]:
                if other != me and overlap >= self.needed(size, self.sizes[other]):
                    self.unite(me, other)
            children = node[1]
            if children:
                same = None
                for x, child in children.items():
                    if i < size and x == elements[i]:
                        same = child
                    else:
                        stack.append((child, i, overlap, depth))
                if same is not None:  # followed first: a link found there spares the others
                    stack.append((same, i, overlap, depth))

    def insert(self, me: int, elements: list[int]) -> None:
        size, node, at = len(elements), self.root, 0
        while True:
            node[3], node[4] = min(node[3], size), max(node[4], size)
            if node[5] == -2:
                node[5] = me
            elif node[5] >= 0 and self.find(node[5]) != self.find(me):
                node[5] = -1
            if at == size:
                node[2].append(me)
                return
            child = node[1].get(elements[at])
            if child is None:
                node[1][elements[at]] = [tuple(elements[at:]), {}, [me], size, size, me]
                return
            way, k = child[0], 0
            while k < len(way) and at + k < size and way[k] == elements[at + k]:
                k += 1
            if k < len(way):  # split the way
                upper = [way[:k], {way[k]: child}, [], child[3], child[4], child[5]]
                child[0] = way[k:]
                node[1][elements[at]] = upper
                child = upper
            node, at = child, at + k


def ranked(sets: list[np.ndarray]) -> list[list[int]]:
    """Sets as ascending ranks in the order of frequency (frequent first), ties by hash."""
    if not sets:
        return []
    flat = np.concatenate(sets)
    values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -count))] = np.arange(len(values))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(x).tolist() for x in np.split(rank[inverse], cuts)]


def link_sets(sets: list[np.ndarray], percent: int, united: list[int] | None = None, probes: list[bool] | None = None) -> list[int]:
    """For each set the first set it is connected with. ``united``: sets with the same number are known to be connected.
    ``probes``: where given, links between two sets neither of which is a probe are taken as known."""
    tree, ids, first = PrefixTree(percent), [], {}
    for k, s in enumerate(sets):
        me = tree.new(len(s))
        ids.append(me)
        if united is not None:
            tree.unite(me, first.setdefault(united[k], me))
    order = sorted(range(len(sets)), key=lambda k: (bool(probes and probes[k]), len(sets[k]), k))
    elements = ranked(sets)
    for k in order:
        if len(sets[k]):
            if probes is None or probes[k]:
                tree.probe(ids[k], elements[k])
            tree.insert(ids[k], elements[k])
    return [tree.find(i) for i in ids]


# --- DataFrames ----------------------------------------------------------------------------------------------------


def set_rows(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, key) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, texts in text_parts(batch.column("text")):
                size, key = set_keys(*ngram_sets(texts, n), len(texts))
                sizes.append(size)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(keys))], names=[id_col, "n_shingles", "key"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_shingles long, key long")


def packed_texts(docs: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """(key, packed): each distinct set of a task with a text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for _, texts in text_parts(batch.column("text")):
                _, keys = set_keys(*ngram_sets(texts, n), len(texts))
                new = [i for i, k in enumerate(keys.tolist()) if k and not (k in seen or seen.add(k))]
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array([pack(texts[i]) for i in new], pa.binary())], names=["key", "packed"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "key long, packed binary")


def distinct_blocks(docs: DataFrame, n: int, text_col: str = "text") -> tuple[DataFrame, str]:
    """(block, keys, packed): all distinct sets with a text each, some hundred to a row; and the table's name. It is bucketed by ``block``, so later joins on it shuffle only their other side.

    A block's number is its first key; keys are dealt by hash, so that is also the bucket the row is in, and each task writes one file.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[int] = []
        packed: list[bytes] = []

        def block() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([keys[0]], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([packed], pa.list_(pa.binary()))], names=["block", "keys", "packed"])
            keys.clear()
            packed.clear()
            return made

        size = 0
        for batch in batches:
            for k, x in zip(batch.column("key").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if k in seen:
                    continue
                seen.add(k)
                keys.append(k)
                packed.append(x)
                size += len(x)
                if size >= BLOCK_BYTES:
                    yield block()
                    size = 0
        if keys:
            yield block()

    rows = packed_texts(docs, n, text_col).repartition(buckets, "key").mapInArrow(tidy(run), "block long, keys array<long>, packed array<binary>")
    path = scratch(spark, "blocks")
    name = f"blocks_{path.rsplit('-', 1)[1]}"
    rows.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name), name


class BlockSets(NamedTuple):
    """The sets of a block: all elements in order of set and hash; the distinct ones, and where each element is among them."""

    element: np.ndarray
    owner: np.ndarray
    distinct: np.ndarray
    at: np.ndarray
    count: np.ndarray


def block_sets(packed: list[bytes], n: int) -> BlockSets:
    unpack = zstandard.ZstdDecompressor().decompress
    h, d = ngram_sets([unpack(x) for x in packed], n)
    distinct, at, count = np.unique(h, return_inverse=True, return_counts=True)
    return BlockSets(h, d, distinct, at, count)


def element_levels(blocks: DataFrame, n: int) -> DataFrame:
    """(block, found): for each of a block's distinct elements, in parts ordered by ``part``, the level of its frequency: 0 if one set only has it, else the
    logarithm to base 2 of how many have it, rounded down.

    Elements travel as differences of their first 40 bits, sorted and compressed: about three bytes each. Those that agree in these are counted
    together, which changes the order of elements for all sets alike.
    """
    parts = 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                sets = block_sets(packed, n)
                short = sets.distinct >> U(24)
                part = (short * U(parts) >> U(40)).astype(np.int64)
                cut = np.searchsorted(part, np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cut))
                spans = [slice(cut[p], cut[p + 1]) for p in some]
                blobs = [pack(np.diff(short[x], prepend=U(0)).tobytes()) for x in spans]
                times = [pack(sets.count[x].astype(np.uint32).tobytes()) for x in spans]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array(blobs, pa.binary()), pa.array(times, pa.binary())], names=["part", "block", "blob", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        # The rows of a task come part by part, and one part is in memory at a time.
        each = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "blob", "times")), strict=True))
        for part, group in itertools.groupby(each, lambda row: row[0]):
            rows = [(b, np.cumsum(np.frombuffer(unpack(x), U)), np.frombuffer(unpack(t), np.uint32)) for _, b, x, t in group]
            values, at = np.unique(np.concatenate([x for _, x, _ in rows]), return_inverse=True)
            total = np.bincount(at, np.concatenate([t for _, _, t in rows]), len(values))
            levels = np.log2(total).astype(np.uint8)[at]
            cuts = np.cumsum([0, *(len(x) for _, x, _ in rows)])
            blobs = [pack(levels[i:j].tobytes()) for i, j in itertools.pairwise(cuts.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array(blobs, pa.binary())], names=["block", "part", "levels"])

    sent = blocks.select("block", "packed").mapInArrow(tidy(send), "part long, block long, blob binary, times binary").repartition("part").sortWithinPartitions("part")
    return sent.mapInArrow(tidy(count), "block long, part long, levels binary").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "levels"))).alias("found"))


def candidate_edges(blocks: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): keys of sets that share an element of their prefixes, each linked to the smallest key that has it.

    The order of elements is by level of frequency, then hash. Two linked sets of which one has size s share one of its first s - needed + 1
    elements; those of level 0 are never shared, so only what comes after them in the prefix is sent.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for keys, packed, found in zip(*(batch.column(c).to_pylist() for c in ("keys", "packed", "found")), strict=True):
                sets, key = block_sets(packed, n), np.array(keys)
                level = np.concatenate([np.frombuffer(unpack(x["levels"]), np.uint8) for x in found])[sets.at]
                size = np.bincount(sets.owner, minlength=len(key))
                own = np.bincount(sets.owner, level == 0, len(key)).astype(np.int64)
                at = np.flatnonzero(level)
                at = at[np.lexsort((sets.element[at], level[at], sets.owner[at]))]
                owner = sets.owner[at]
                begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(at) else at
                rank = own[owner] + np.arange(len(at)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(at)]])))
                first = rank < (size - -(-size * percent // 100) + 1)[owner]
                sig, node = sets.element[at][first], key[owner[first]]
                order = np.lexsort((node, sig))
                sig, node = sig[order], node[order]
                # What already meets here goes on as one row and as edges, so an element has few rows in all.
                lead = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
                leader = node[np.maximum.accumulate(np.where(lead, np.arange(len(sig)), 0))] if len(sig) else node
                pairs = np.unique(np.stack([leader[~lead], node[~lead]]), axis=1)
                tie = mix(mix(pairs[0].view(U)) + pairs[1].view(U))
                sig = np.concatenate([sig[lead], tie, tie])
                node = np.concatenate([node[lead], pairs[0], pairs[1]])
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node)], names=["sig", "node"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_lead = None
        for batch in batches:
            sig, node = batch.column("sig").to_numpy(), batch.column("node").to_numpy()
            if not len(sig):
                continue
            lead = np.concatenate([[last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]])
            at = np.maximum.accumulate(np.where(lead, np.arange(len(sig)), -1))
            leader = np.where(at >= 0, node[np.maximum(at, 0)], 0 if last_lead is None else last_lead)
            last_sig, last_lead = sig[-1], leader[-1]
            pairs = np.unique(np.stack([leader, node]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    rows = blocks.join(element_levels(blocks, n), "block").select("keys", "packed", "found").mapInArrow(tidy(send), "sig long, node long")
    return rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(tidy(star), "a long, b long")


def chosen_members(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` (key, grp, slices, slice) with the packed text of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("keys", "packed", "wanted")), strict=True):
                text = dict(zip(keys, packed, strict=True))
                columns = [[x[c] for x in wanted] for c in ("key", "grp", "slices", "slice")]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([text[k] for k in columns[0]], pa.binary())], names=["key", "grp", "slices", "slice", "packed"])

    where = blocks.select("block", F.explode("keys").alias("key"))
    wanted = where.join(placed, "key").groupBy("block").agg(F.collect_list(F.struct("key", "grp", "slices", "slice")).alias("wanted"))
    return blocks.join(wanted, "block").select("keys", "packed", "wanted").mapInArrow(tidy(run), "key long, grp long, slices long, slice long, packed binary")


def unpack_sets(packed: pa.ChunkedArray, n: int) -> list[np.ndarray]:
    unpack, out = zstandard.ZstdDecompressor().decompress, []
    for x in packed:
        out.append(ngram_sets([unpack(x.as_py())], n)[0])
    return out


def links(docs: DataFrame, sizes: DataFrame, n: int = 4, percent: int = 85, text_col: str = "text") -> DataFrame:
    """(node, root): keys of sets that have a link, with the smallest key of their component. ``sizes``: (key, n_shingles) of the distinct sets."""
    blocks, blocks_name = distinct_blocks(docs, n, text_col)
    groups = connected_components(candidate_edges(blocks, n, percent), "groups").withColumnsRenamed({"node": "key", "root": "grp"})
    groups = groups.join(sizes, "key")
    total = groups.groupBy("grp").agg(F.ceil(F.sum("n_shingles") / SLICE_ELEMENTS).alias("slices"))
    placed = groups.join(total, "grp").select("key", "grp", "slices", F.pmod(F.xxhash64("key"), F.col("slices")).alias("slice"))
    members = written(chosen_members(blocks, placed), "members")
    spark = docs.sparkSession
    files = blocks.inputFiles()[:1]
    spark.sql(f"DROP TABLE {blocks_name}")
    if files:
        discard(spark, files[0].rsplit("/", 1)[0])

    def within(table: pa.Table) -> pa.Table:
        keys = table["key"].to_pylist()
        found = link_sets(unpack_sets(table["packed"], n), percent)
        return pa.table({"a": pa.array(keys, pa.int64()), "b": pa.array([keys[i] for i in found], pa.int64())})

    # The hub of a large group, its smallest key, is in each of its slices.
    hub = members.filter("slices > 1 AND key = grp").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    own = members.filter("NOT (slices > 1 AND key = grp)").unionByName(hub)
    first = written(own.groupBy("grp", "slice").applyInArrow(tidy(within), "a long, b long"), "links")
    if members.filter("slices > 1").isEmpty():
        return connected_components(first, "linked")
    label = connected_components(first, "linked-in-slices")
    known = members.filter("slices > 1").join(label, F.col("key") == F.col("node")).select("key", "grp", "slices", "slice", "packed", "root")
    hubs = label.select(F.col("node").alias("grp"), F.col("root").alias("hub_root"))
    known = written(known.join(hubs, "grp"), "labelled")
    rest = known.filter("root <> hub_root").withColumn("home", F.col("slice"))
    counts = rest.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.ceil(F.col("n") / 4096).alias("cuts"))
    rest = rest.join(counts, "grp").withColumns({"probe": F.lit(True), "cut": F.pmod(F.xxhash64(F.lit(1), F.col("key")), F.col("cuts"))})
    rest = rest.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).filter("slice <> home")
    base = known.join(counts, "grp").withColumns({"probe": F.lit(False), "cut": F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))})
    columns = ["grp", "slice", "cut", "key", "packed", "root", "probe"]

    def across(table: pa.Table) -> pa.Table:
        keys = table["key"].to_pylist()
        found = link_sets(unpack_sets(table["packed"], n), percent, table["root"].to_pylist(), table["probe"].to_pylist())
        return pa.table({"a": pa.array(keys, pa.int64()), "b": pa.array([keys[i] for i in found], pa.int64())})

    more = base.select(*columns).unionByName(rest.select(*columns)).groupBy("grp", "slice", "cut").applyInArrow(tidy(across), "a long, b long")
    return connected_components(first.unionByName(more), "linked")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document: component_id is the smallest id it is connected with, itself included."""
    rows = written(set_rows(docs.select(F.col(id_col).alias("given_id"), F.col(text_col).alias("text")), n, "given_id"), "set-rows")
    # One row for each distinct set: copies are summed up before anything is joined, so a component's sets meet, not its rows.
    sets = rows.filter("n_shingles > 0").groupBy("key").agg(F.max("n_shingles").alias("n_shingles"), F.min("given_id").alias("least"))
    found = links(docs, sets.select("key", "n_shingles"), n, percent, text_col)
    of = sets.select("key", "least").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    label = written(of.join(lowest, "root").select("key", "component_id"), "set-labels")
    # Rows meet their set's label; a set that very many rows have is split by adaptive execution, as both sides come straight from tables.
    out = rows.filter("n_shingles > 0").join(label, "key").select(F.col("given_id").alias(id_col), "n_shingles", "component_id")
    return out.unionByName(rows.filter("n_shingles = 0").select(F.col("given_id").alias(id_col), "n_shingles", F.col("given_id").alias("component_id")))
