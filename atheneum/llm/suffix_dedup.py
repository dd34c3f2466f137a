"""Removal of repeated substrings by sorting suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (in a document of a smaller id, or further left in the same one).
Suffixes are sorted deep-shallow (Manzini and Ferragina 2004): multikey quicksort, eight bytes a key, to a shallow
depth; the groups that still agree there have long common prefixes and are ordered by blind tries, which look at one
byte a branch and compare whole strings only once a suffix; groups too large for a trie go on with quicksort. Equal neighbours in
suffix order are the repeats, and the one that starts first stays.

A suffix array over all places would be many times the corpus. Each window of ``length`` bytes is therefore dealt by content: its anchor is
the place of the smallest hash among the ``GRAM``-byte strings inside it (the leftmost such place), which equal windows have
in common. Only anchors whose hash is met again anywhere go on, with the stretch of text of the windows they own;
those that meet in a task are sorted: first whole stretches, so that long repeats are settled at once, then, where
stretches differ, the single windows. What repeats inside a batch of documents is settled before anything is shuffled, so that a passage
which very many documents share sends one stretch a batch.

Cases: a null text is empty; texts below ``length`` bytes lose nothing; long texts are read whole, in overlapping segments; equal starts cannot
tie but in repeated rows of one id and text, which count as one document and get one result each; different texts under one id are ordered by a hash of the text; a null id
sorts first; an empty table gives an empty result; other columns are ignored, or returned by ``cleaned``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_BYTES, NULL_ID, text_parts, tidy, written
from .jaccard_trie import mix

U = np.uint64
LENGTH, GRAM = 100, 32
#: Bytes that quicksort looks at before the tries take over, and the largest group given to a trie.
SHALLOW, TRIE_MAX = 40, 64
#: Stretches sorted at once.
CHUNK = 2_000
_BYTE = np.random.default_rng(23).integers(0, 2**64, 256, dtype=U)
_PLACE_BITS = U(24)
SEGMENT = 1 << 23

# --- sorting -------------------------------------------------------------------------------------------------------


class BlindTrie:
    """Orders strings; a node holds the place of the first byte in which the strings below differ."""

    __slots__ = ("root", "strings")

    def __init__(self, strings: list[bytes]):
        #: A leaf is a list of the indexes of equal strings; a node a tuple (place, children by byte, -1 for the end of the string).
        self.strings, self.root = strings, None

    def insert(self, index: int) -> None:
        s, root, strings = self.strings[index], self.root, self.strings
        if root is None:
            self.root = [index]
            return
        node, n = root, len(s)
        while type(node) is tuple:  # down blindly: bytes between the places aren't looked at
            at, children = node
            node = children.get(s[at] if at < n else -1) or next(iter(children.values()))
        t = strings[node[0]]
        if s == t:
            node.append(index)
            return
        short = min(n, len(t))
        differ = int.from_bytes(s[:short], "big") ^ int.from_bytes(t[:short], "big")
        place = short - (differ.bit_length() + 7) // 8 if differ else short
        other = t[place] if place < len(t) else -1
        above, node = None, root
        while type(node) is tuple and node[0] < place:
            above = node
            node = node[1][s[node[0]] if node[0] < n else -1]
        if type(node) is tuple and node[0] == place:
            node[1][s[place] if place < n else -1] = [index]
            return
        made = (place, {s[place] if place < n else -1: [index], other: node})
        if above is None:
            self.root = made
        else:
            above[1][s[above[0]] if above[0] < n else -1] = made

    def ordered(self) -> list[list[int]]:
        """Indexes of equal strings, in the order of the strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def sort_suffixes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, shallow: int = SHALLOW, trie_max: int = TRIE_MAX) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes text[start:end] in order (a shorter one before those it begins), and for each place in that order whether the suffix equals the one before."""
    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)  # the order so far, and the group of each place in it
    same = np.zeros(n, bool)
    active = np.arange(n)  # places whose group has more than one suffix
    raw, depth = text.tobytes(), 0
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    while len(active):
        if depth >= shallow:
            g = group[active]
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
            size = np.diff(cut)
            for a, k in zip(cut[:-1][size <= trie_max].tolist(), size[size <= trie_max].tolist(), strict=True):
                places = active[a : a + k]
                own = order[places]
                trie = BlindTrie([raw[starts[i] + depth : ends[i]] for i in own.tolist()])
                for j in range(k):
                    trie.insert(j)
                at = int(places[0])
                for equal in trie.ordered():
                    equal.sort()
                    order[at : at + len(equal)] = own[equal]
                    same[at + 1 : at + len(equal)] = True
                    at += len(equal)
            active = active[np.repeat(size > trie_max, size)]
            if not len(active):
                break
        own = order[active]
        at = starts[own] + depth
        left = np.clip(ends[own] - at, 0, 8)
        key = words[np.minimum(at, len(text))].view(">u8")[:, 0].astype(U)
        key = key >> U(8) * (8 - left).astype(U) << U(8) * (8 - left).astype(U) if (left < 8).any() else key
        by = np.lexsort((left, key, group[active]))
        own, key, left, g = own[by], key[by], left[by], group[active]
        order[active] = own
        joined = np.concatenate([[False], (g[1:] == g[:-1]) & (key[1:] == key[:-1]) & (left[1:] == left[:-1])])
        head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(active))))
        group[active] = active[head]
        ended = joined & (left < 8)
        same[active[ended]] = True  # both end here, and nothing differed
        more = joined | np.concatenate([joined[1:], [False]])
        active = active[more & (left == 8)]
        depth += 8
    return order, same


def equal_classes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each suffix the smallest index of a suffix equal to it."""
    order, same = sort_suffixes(text, starts, ends)
    head = np.flatnonzero(~same)
    if not len(order):
        return order
    lowest = np.minimum.reduceat(order, head)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(lowest, np.diff(np.concatenate([head, [len(order)]])))
    return out


# --- anchors -------------------------------------------------------------------------------------------------------


def gram_hashes(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on: hashes of lengths 1, 2, 4 and so on, put together as the bits of ``gram`` say."""
    power, n, base = _BYTE[text], 1, 0x9E3779B97F4A7C15
    h, done = None, 0
    while True:
        if gram & n:
            if h is None:
                h = power
            else:  # the ``n`` bytes first, then those taken before
                h = power[: len(h) - n] * U(pow(0x9E3779B97F4A7C15, done, 2**64)) + h[n:]
            done += n
        if 2 * n > gram:
            return mix(h)
        power = power[:-n] * U(base) + power[n:]
        base, n = base * base % 2**64, 2 * n


def owned_windows(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the text's index, first and last window's start in it, hash at the anchor. In order."""
    found: list[tuple[np.ndarray, ...]] = []

    def segment(part: list[bytes], first: int, skip: int) -> None:
        joined = np.frombuffer(b"".join(part), np.uint8)
        if len(joined) < length:
            return
        sizes = np.array([len(t) for t in part])
        begin = np.cumsum(sizes) - sizes
        h = gram_hashes(joined, gram)
        best = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=U)
        n, width = 1, length - gram + 1
        while 2 * n <= width:
            best = np.minimum(best[:-n], best[n:])
            n *= 2
        if width > n:
            best = np.minimum(best[: n - width], best[width - n :])
        count = np.maximum(sizes - length + 1, 0)
        doc = np.repeat(np.arange(len(part)), count)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = (best[begin[doc] + start] & U((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])) if len(at) else np.zeros(0, np.int64)
        last = np.concatenate([new[1:], [len(at)]]) - 1 if len(at) else new
        found.append((doc[new] + first, start[new] + skip, start[last] + skip, h[at[new]]))

    small: list[bytes] = []
    for i, t in enumerate([*texts, None]):
        if t is None or len(t) > SEGMENT:
            if small:
                segment(small, i - len(small), 0)
                small = []
            for skip in range(0, len(t) - length + 1 if t else 0, SEGMENT - length + 1):
                segment([t[skip : skip + SEGMENT]], i, skip)
        else:
            small.append(t)
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, U),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# --- settling ------------------------------------------------------------------------------------------------------


def stretches(text: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of ``windows`` windows each, in the order of their occurrence: whether the whole stretch occurred before, and,
    for the windows of all stretches one after the other, whether the window did."""
    ends = starts + windows + length - 1
    first = equal_classes(text, starts, ends)
    whole = first != np.arange(len(starts))
    owner = np.repeat(np.arange(len(starts)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    repeated = whole[owner]
    left = np.flatnonzero(~repeated)
    at = starts[owner[left]] + offset[left]
    repeated[left] = equal_classes(text, at, at + length) != np.arange(len(left))
    return whole, repeated


def covered(owner: np.ndarray, start: np.ndarray, repeated: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows as (owner, first byte, end)."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return at, at, at
    o, s = owner[at], start[at]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(at)]]) - 1
    return o[head], s[head], s[tail] + length


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with those that touch or overlap joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


# --- DataFrames ----------------------------------------------------------------------------------------------------


def _occurrences(rows: DataFrame, length: int) -> DataFrame:
    """(g, doc, h): anchors, ``g`` being the hash h, or, for those already met in their batch, any number, with h beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for at, texts in text_parts(batch.column("text")):
                doc, _, _, h = owned_windows(texts, length)
                docs.append(ids[doc + at])
                hashes.append(h)
            doc, h = np.concatenate(docs), np.concatenate(hashes)
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            known = ~new | np.concatenate([~new[1:], [False]]) if len(h) else new
            # The first of those met in this batch stands for them where batches meet; all of them are known to repeat.
            extra = np.flatnonzero(known)
            extra = extra[np.concatenate([[True], (doc[extra][1:] != doc[extra][:-1]) | (h[extra][1:] != h[extra][:-1])])] if len(extra) else extra
            lead = np.flatnonzero(new)
            g = np.concatenate([h[lead], mix(h[extra] ^ mix(doc[extra].view(U) + U(1)))]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(np.concatenate([doc[lead], doc[extra]])), pa.array(np.concatenate([h[lead], h[extra]]).view(np.int64), mask=np.arange(len(g)) < len(lead))],
                names=["g", "doc", "h"],
            )

    return rows.select("doc", "text").mapInArrow(tidy(run), "g long, doc long, h long")


def _repeated(anchors: DataFrame) -> DataFrame:
    """(doc, h): anchors whose hash is met more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # a row of the last batch that is alone so far
        for batch in batches:
            g, doc = batch.column("g").to_numpy(), batch.column("doc").to_numpy()
            h = batch.column("h")
            known = np.asarray(h.is_valid())
            h = np.where(known, h.fill_null(0).to_numpy(zero_copy_only=False), g)
            if waiting is not None:
                g, doc, h, known = np.concatenate([[waiting[0]], g]), np.concatenate([[waiting[1]], doc]), np.concatenate([[waiting[2]], h]), np.concatenate([[waiting[3]], known])
            if not len(g):
                continue
            equal = g[1:] == g[:-1]
            met = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
            out = known | met
            waiting = (g[-1], doc[-1], h[-1], bool(out[-1]))  # seen again, it is given out once more, which does no harm
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(h[out])], names=["doc", "h"])

    return anchors.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(run), "doc long, h long")


def _pack(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("doc"), batch.column("th"), pa.array([pack(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["own", "doc", "th", "packed"])

    return rows.filter(F.octet_length("text") >= length).select("own", "doc", "th", "text").mapInArrow(tidy(run), "own long, doc long, th long, packed binary")


_STRETCH = "g long, doc long, th long, start long, windows int, stop long, stretch binary"


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """Stretches of anchors that repeat (``stretch`` set), and spans already known to go (``stop`` set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, ths = batch.column("doc").to_numpy(), batch.column("th").to_numpy()
            wanted, packed = batch.column("hashes"), batch.column("packed")
            texts: list[bytes] = []
            parts: list[list[np.ndarray]] = []
            order = np.lexsort((ths, ids)).tolist()  # occurrences in the order of documents
            base = 0

            def flush():
                nonlocal base, texts
                doc, first, last, h = owned_windows(texts, length)
                keep = np.zeros(len(doc), bool)
                bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
                for k in range(len(texts)):
                    a, b = bounds[k], bounds[k + 1]
                    if b > a:
                        keep[a:b] = np.isin(h[a:b].view(np.int64), wanted[order[base + k]].values.to_numpy())
                joined, sizes = b"".join(texts), np.array([len(t) for t in texts])
                begin = np.cumsum(sizes) - sizes
                doc, first, last, h = doc[keep], first[keep], last[keep], h[keep]
                yield from settle(np.frombuffer(joined, np.uint8), begin, base, doc, first, last, h)
                base += len(texts)
                texts = []

            def settle(text, begin, base, doc, first, last, h):
                if not len(doc):
                    return
                own = np.array(order)[base + doc]
                windows = last - first + 1
                # Those of one hash in the order of documents: what repeats among them goes now.
                by = np.lexsort((first, doc, h))
                own, doc, first, windows, h = own[by], doc[by], first[by], windows[by], h[by]
                at = begin[doc] + first
                lead = equal_classes(text, at, at + windows + length - 1)
                gone = lead != np.arange(len(lead))
                spread = mix(ids[own].view(U) + first.astype(U)).view(np.int64)
                raw = text.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(gone, spread, h.view(np.int64))),
                        pa.array(ids[own]),
                        pa.array(ths[own]),
                        pa.array(first),
                        pa.array(windows.astype(np.int32)),
                        pa.array(first + windows + length - 1, mask=~gone),
                        pa.array([None if x else raw[a : a + w + length - 1] for x, a, w in zip(gone.tolist(), at.tolist(), windows.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["g", "doc", "th", "start", "windows", "stop", "stretch"],
                )

            size = 0
            for i in order:
                texts.append(unpack(packed[i].as_py()))
                size += len(texts[-1])
                if size >= 4 * HASH_BYTES:
                    yield from flush()
                    size = 0
            if texts:
                yield from flush()

    return docs.mapInArrow(tidy(run), _STRETCH)


def _spans(found: DataFrame, length: int) -> DataFrame:
    """(doc, th, start, stop): bytes to remove; spans may overlap."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        done = [r for r in rows if r[6] is None]
        rows = [r for r in rows if r[6] is not None]
        out = [np.array([r[k] for r in done], np.int64) for k in (1, 2, 3, 5)]
        if rows:
            sizes = np.array([len(r[6]) for r in rows])
            starts = np.cumsum(sizes) - sizes
            windows = np.array([r[4] for r in rows], np.int64)
            _, repeated = stretches(np.frombuffer(b"".join(r[6] for r in rows), np.uint8), starts, windows, length)
            owner = np.repeat(np.arange(len(rows)), windows)
            first = np.array([r[3] for r in rows], np.int64)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
            o, a, b = covered(owner, start, repeated, length)
            more = [np.array([r[k] for r in rows], np.int64)[o] for k in (1, 2)] + [a, b]
            out = [np.concatenate(x) for x in zip(out, more, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc", "th", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= CHUNK and row[0] != held[-1][0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    return found.repartition("g").sortWithinPartitions("g", "doc", "th", "start").mapInArrow(tidy(run), "doc long, th long, start long, stop long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(own, doc, th, text): a document is an id with a hash of its text, and ``own`` a key of documents that two may share: the id with four bits of the
    hash, which packs well where it is shuffled beside each anchor, or, without an id, the hash, so that such texts, however many, don't meet."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.withColumn("own", F.when(F.col("doc") == NULL_ID, F.col("th")).otherwise(F.shiftleft("doc", 4).bitwiseOR(F.col("th").bitwiseAND(F.lit(15)))))


def removals(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, spans, packed): the spans to remove, sorted and apart, of each document that loses any, with its packed text."""
    rows = keyed(docs, id_col, text_col)
    repeated = _repeated(_occurrences(rows.select(F.col("own").alias("doc"), "text"), length)).groupBy(F.col("doc").alias("own")).agg(F.collect_set("h").alias("hashes"))
    chosen = written(_pack(rows, length).join(repeated, "own").dropDuplicates(["own", "doc", "th"]).drop("own"), "chosen")
    spans = _spans(_stretches(chosen, length), length).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            merged = [[{"start": a, "stop": b} for a, b in merge_spans([(x["start"], x["stop"]) for x in row])] for row in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(merged, kind), batch.column("packed")], names=["doc", "th", "spans", "packed"])

    schema = "doc long, th long, spans array<struct<start: long, stop: long>>, packed binary"
    return spans.join(chosen.select("doc", "th", "packed"), ["doc", "th"]).select("doc", "th", "spans", "packed").mapInArrow(tidy(merge), schema)


def removal_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            spans = [[(x["start"], x["stop"]) for x in row] for row in batch.column("spans").to_pylist()]
            kept = [hashlib.sha256(without(unpack(t), s)).hexdigest() for t, s in zip(batch.column("packed").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("th"), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(kept, pa.string())],
                names=["doc", "th", "n_removed", "n_spans", "kept"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("given_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("all_sha256"))
    found = removals(docs, length, id_col, text_col).mapInArrow(tidy(digest), "doc long, th long, n_removed long, n_spans long, kept string")
    out = rows.join(found, ["doc", "th"], "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("given_id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "all_sha256").alias("kept_sha256"))


def cleaned(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes gone from their texts; a character that loses some of its bytes goes as a whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept = []
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, whole = unpack(packed), []
                for x in spans:
                    a, b = x["start"], x["stop"]
                    while text[a : a + 1] and text[a] & 0xC0 == 0x80:
                        a -= 1
                    while b < len(text) and text[b] & 0xC0 == 0x80:
                        b += 1
                    whole.append((a, b))
                kept.append(without(text, merge_spans(whole)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(kept, pa.string())], names=["doc", "th", "kept"])

    found = removals(docs, length, id_col, text_col).mapInArrow(tidy(cut), "doc long, th long, kept string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given")  # so that no column of the caller's meets one of these
    rows = docs.select(given, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("th")).join(found, ["doc", "th"], "left")
    return rows.select(*[(F.coalesce("kept", F.col(f"given.`{c}`")) if c == text_col else F.col(f"given.`{c}`")).alias(c) for c in docs.columns])
