"""Language identification with a linear-chain conditional random field.

Words (runs of letters, lower-cased) are labelled in chains, so that switches of language inside a text are
found: features are affixes of one to four characters, character bi- and trigrams with word ends, and a learned lexicon (the word
itself); transitions between neighbouring words' labels are learned too. Marginals come from forward-backward; a
document's language has the largest summed marginal, its score is the mean of that.

Training reads a bounded sample, ``DOCS_PER_LANG`` documents of each language (those of the smallest id hashes), on the driver; the chains
of a sample document carry its label, and further chains spliced from documents of two languages teach the
transitions. Prediction runs over every whole text, cut into chains of ``CHAIN`` words.

Cases: null texts and those without a letter get ``und`` and score 0; ties go to the label that sorts first;
repeated rows get equal labels; with nothing to learn from, every row gets ``und``; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import tidy

DOCS_PER_LANG, MAX_LANGS, CHAIN, SLOTS, EPOCHS = 150, 200, 64, 1 << 18, 25
#: Words whose emissions a worker remembers, and words decoded at once.
MEMO_WORDS, DECODE_WORDS = 300_000, 200_000
UND = "und"
#: A longer run of letters is cut into words of so many, so that each letter is scored and a word has a bounded number of features.
WORD_LETTERS = 40
#: Marks belong to the letters before them.
_WORDS, _MARKED = re.compile(rf"[^\W\d_]{{1,{WORD_LETTERS}}}"), regex.compile(rf"[\p{{L}}][\p{{L}}\p{{M}}]{{0,{WORD_LETTERS - 1}}}")
_MARKS = regex.compile(r"\p{M}")


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    if not text.isascii() and _MARKS.search(text):
        return _MARKED.findall(text)
    words = _WORDS.findall(text)
    if text.isascii() or all(map(str.isalpha, set(words))):
        return words
    # The pattern also takes numerals that are no letters, such as fractions and superscripts: these end a word.
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]


def features(word: str) -> list[int]:
    """Slots of the word's features."""
    n, ended = len(word), f"^{word}$"
    names = [f"w{word}"]
    names += [f"p{word[:k]}" for k in range(1, min(n, 4) + 1)] + [f"s{word[-k:]}" for k in range(1, min(n, 4) + 1)]
    names += [ended[i : i + k] for k in (2, 3) for i in range(n + 3 - k)]
    return [zlib.crc32(x.encode()) % SLOTS for x in names]


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Summed feature weights of each word."""
    if not words:
        return np.zeros((0, weights.shape[1]), np.float32)
    each = [features(w) for w in words]
    starts = np.cumsum([0, *map(len, each)])[:-1]
    return np.add.reduceat(weights[np.fromiter((s for f in each for s in f), np.int64)], starts, axis=0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (chains, steps, labels), expected transitions (labels, labels) and the log-likelihood's log Z of padded chains."""
    n, steps, labels = scores.shape
    top = scores.max(axis=2, keepdims=True)
    b, a = np.exp(scores - top), np.exp(trans)
    on = np.arange(steps)[None, :] < lengths[:, None]
    b = np.where(on[:, :, None], b, 1.0)
    alpha, scale = np.empty_like(b), np.ones((n, steps), b.dtype)
    for t in range(steps):
        now = b[:, t] if t == 0 else (alpha[:, t - 1] @ a) * b[:, t]
        scale[:, t] = now.sum(axis=1)
        now = now / scale[:, t, None]
        alpha[:, t] = now if t == 0 else np.where(on[:, t, None], now, alpha[:, t - 1])
    beta, pairs = np.ones((n, labels), b.dtype), np.zeros((labels, labels))
    marginal = np.empty_like(b)
    for t in range(steps - 1, -1, -1):
        m = alpha[:, t] * beta
        marginal[:, t] = m / m.sum(axis=1, keepdims=True)
        if t:
            ahead = np.where(on[:, t, None], b[:, t] * beta / scale[:, t, None], 0.0)
            pairs += a * (alpha[:, t - 1].T.astype(np.float64) @ ahead)
            back = ahead @ a.T
            beta = np.where(on[:, t, None], back, beta)
    log_z = float((np.log(scale) * on).sum() + (top[:, :, 0] * on).sum())
    return marginal * on[:, :, None], pairs, log_z


def padded(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of consecutive chains as (chains, longest, ...)."""
    steps = int(lengths.max(initial=1))
    on = np.arange(steps)[None, :] < lengths[:, None]
    out = np.zeros((len(lengths), steps, *values.shape[1:]), values.dtype)
    out[on] = values
    return out


class LanguageCRF:
    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.trans = labels, weights, trans

    @classmethod
    def train(cls, docs: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 5) -> LanguageCRF | None:
        """From (text, language) pairs: AdaGrad on the chains' log-likelihood."""
        labels = sorted({lang for _, lang in docs})
        index, rng = {}, np.random.default_rng(seed)
        chains: list[tuple[np.ndarray, np.ndarray]] = []
        for text, lang in docs:
            ids = np.array([index.setdefault(w, len(index)) for w in words_of(text)], np.int64)
            chains += [(ids[i : i + CHAIN], np.full(len(ids[i : i + CHAIN]), labels.index(lang))) for i in range(0, len(ids), CHAIN)]
        if not chains:
            return None
        for _ in range(len(chains) // 3 if len(labels) > 1 else 0):  # code-switched: the head of one chain, the tail of another
            (x, lx), (y, ly) = (chains[int(i)] for i in rng.integers(len(chains), size=2))
            i, j = int(rng.integers(len(x) + 1)), int(rng.integers(len(y) + 1))
            mixed = (np.concatenate([x[:i], y[j:]])[:CHAIN], np.concatenate([lx[:i], ly[j:]])[:CHAIN])
            if len(mixed[0]):
                chains.append(mixed)
        each = [features(w) for w in index]
        sizes = np.array([len(f) for f in each])
        flat, starts = np.fromiter((s for f in each for s in f), np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = len(labels)
        weights, trans = np.zeros((SLOTS, n)), np.zeros((n, n))
        sum_w, sum_t = np.full((SLOTS, n), 1e-6), np.full((n, n), 1e-6)
        lengths = np.array([len(c[0]) for c in chains])
        all_ids, all_gold = np.concatenate([c[0] for c in chains]), np.concatenate([c[1] for c in chains])
        ends = np.cumsum(lengths)
        for _ in range(epochs):
            order = rng.permutation(len(chains))
            for part in np.array_split(order, max(1, len(chains) // 1500)):
                rows = np.concatenate([np.arange(ends[c] - lengths[c], ends[c]) for c in part])
                ids, gold, size = all_ids[rows], all_gold[rows], lengths[part]
                used, local = np.unique(ids, return_inverse=True)
                at = np.concatenate([np.arange(starts[u], starts[u] + sizes[u]) for u in used])
                slots, first = flat[at], np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
                score = np.add.reduceat(weights[slots], first, axis=0)[local]
                marginal, pairs, _ = forward_backward(padded(score, size), size, trans)
                on = np.arange(marginal.shape[1])[None, :] < size[:, None]
                grad = -marginal[on]
                grad[np.arange(len(gold)), gold] += 1
                by_word = np.stack([np.bincount(local, grad[:, k], len(used)) for k in range(n)], axis=1)
                per_slot, where = np.unique(slots, return_inverse=True)
                spread = np.repeat(by_word, sizes[used], axis=0)
                g = np.stack([np.bincount(where, spread[:, k], len(per_slot)) for k in range(n)], axis=1) / len(part) - 1e-4 * weights[per_slot]
                sum_w[per_slot] += g * g
                weights[per_slot] += 0.1 * g / np.sqrt(sum_w[per_slot])
                begin = np.zeros(len(gold), bool)
                begin[np.concatenate([[0], np.cumsum(size)[:-1]])] = True
                seen = np.zeros((n, n))
                np.add.at(seen, (gold[:-1][~begin[1:]], gold[1:][~begin[1:]]), 1)
                g = (seen - pairs) / len(part) - 1e-4 * trans
                sum_t += g * g
                trans += 0.1 * g / np.sqrt(sum_t)
        return cls(labels, weights.astype(np.float32), trans.astype(np.float32))

    def marginals(self, words: list[str]) -> np.ndarray:
        """(words, labels) for one text."""
        lengths = chain_lengths(np.array([len(words)]))[0]
        m, _, _ = forward_backward(padded(emissions(words, self.weights), lengths), lengths, self.trans)
        return m[np.arange(m.shape[1])[None, :] < lengths[:, None]]


def chain_lengths(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the chains of texts of these many words, in order, and the text each belongs to."""
    count = -(-sizes // CHAIN)
    owner = np.repeat(np.arange(len(sizes)), count)
    lengths = np.full(len(owner), CHAIN)
    last = np.cumsum(count)[sizes > 0] - 1
    lengths[last] = sizes[sizes > 0] - (count[sizes > 0] - 1) * CHAIN
    return lengths, owner


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS_PER_LANG) -> LanguageCRF | None:
    """Trained on at most ``per_lang`` documents of each language, and ``per_lang * MAX_LANGS`` in all (each language's first ones before any second), among the rows where ``learn`` holds."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    order = W.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    picked = rows.select(id_col, lang_col).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang)
    ids = [r[0] for r in picked.orderBy("n", lang_col).limit(per_lang * MAX_LANGS).collect()]
    # Of several texts or languages of an id those of the smallest hash are learned from, wherever they lie.
    one = F.min(F.struct(F.xxhash64(text_col, lang_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    sample = rows.filter(F.col(id_col).isin(ids)).groupBy(id_col).agg(one.alias("one")).select(id_col, "one.text", "one.lang").orderBy(id_col).collect() if ids else []
    return LanguageCRF.train([(r[1], r[2]) for r in sample])


def predict(docs: DataFrame, model: LanguageCRF | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score) of every row."""
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias("text"))
    if model is None:
        return rows.select(id_col, *keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.trans))  # SLOTS x labels floats, whatever the input
    schema = docs.select(id_col, *keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, weights, trans = shared.value
        slot: dict[str, int] = {}
        known = np.zeros((0, len(labels)), np.float32)

        def decode(texts: list[list[str]]) -> tuple[list[str], list[float]]:
            nonlocal known
            if len(slot) > MEMO_WORDS:
                slot.clear()
                known = known[:0]
            new = list(dict.fromkeys(w for t in texts for w in t if w not in slot))
            slot.update(zip(new, range(len(slot), len(slot) + len(new)), strict=True))
            known = np.concatenate([known, emissions(new, weights)])
            sizes = np.array([len(t) for t in texts])
            lengths, owner = chain_lengths(sizes)
            total = np.zeros((len(texts), len(labels)))
            if len(lengths):
                ids = np.fromiter((slot[w] for t in texts for w in t), np.int64, int(sizes.sum()))
                marginal, _, _ = forward_backward(padded(known[ids], lengths), lengths, trans)
                np.add.at(total, owner, marginal.sum(axis=1))
            best = total.argmax(axis=1)
            score = np.minimum(1.0, total[np.arange(len(texts)), best] / np.maximum(sizes, 1))
            return [labels[b] if s else UND for b, s in zip(best, sizes, strict=True)], score.tolist()

        for batch in batches:
            langs, scores, part, size = [], [], [], 0
            for text in batch.column("text").to_pylist():
                part.append(words_of(text))
                size += len(part[-1])
                if size >= DECODE_WORDS:
                    got = decode(part)
                    langs, scores, part, size = langs + got[0], scores + got[1], [], 0
            if part:
                got = decode(part)
                langs, scores = langs + got[0], scores + got[1]
            others = [batch.column(c) for c in (id_col, *keep)]
            yield pa.RecordBatch.from_arrays([*others, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, *keep, "lang_pred", "score"])

    return rows.mapInArrow(tidy(label), schema)
