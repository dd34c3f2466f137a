"""The filter audit and the ranked search against plain Python, and on odd rows."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from atheneum.llm import filter_audit, ranked_search

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
SHOUT = "AB cd " * 40
LONG = " ".join(f"w{i}" for i in range(30_000)) + " #"
CLASH = "id string, part string, digest string, fails int, bits int, first long, score long, rank int, salt int"
EXTRA = ("x", "y", "z", 1, 2, 3, 4, 5, 6)
DOCS = [
    (1, "one two three", "a"), (2, "one two three", "b"), (2, "one two three", "a"), (3, None, None), (4, "", ""), (5, "é" * 80 + " É", "a"), (6, SHOUT, "a"), (7, SHOUT, "b"),
    (None, SHOUT, "b"), (8, LONG, "b"), (9, "one\x00two one-three_ONE Été", "c"), (10, "one\x00two one-three_ONE Été", "c"), (11, " \t\n", "c"), (None, "two", None),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (6, None, 1), (7, 1, 0), (8, 1, 0), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, *EXTRA) for d in DOCS], f"doc_id long, text string, source string, {CLASH}").repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def failing(doc_id, text, docs):
    words = WORD.findall(text)
    smallest = min((-1 if i is None else i) for i, t, _ in docs if (t or "") == text)
    found = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return "".join(c for c in found if found[c]) + "E" * ((-1 if doc_id is None else doc_id) > smallest)


def plain_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = [(part or "", failing(i, text or "", docs), i in good, i in toxic) for i, text, part in docs]
    out = set()
    for part in {r[0] for r in rows}:
        own, shapley, found = [r for r in rows if r[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, failed = [r for r in left if f in r[1]], sum(f in r[1] for r in own)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                found.append((part, order, step, len(left), len(gone), failed - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(*r, shapley[r[1][r[2] - 1]]) for r in found}
    return out


def test_audit_against_plain_python(docs, labels):
    found = [tuple(r) for r in filter_audit.audit(docs, labels).collect()]
    assert len(found) == len(set(found)) == 600 * 4 and set(found) == plain_audit(DOCS, LABELS)


def test_audit_of_no_documents(spark, docs, labels):
    assert filter_audit.audit(docs.limit(0), labels).isEmpty()
    assert filter_audit.audit(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").isEmpty()


def test_bitsets_of_odd_lengths_and_many_parts():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 1000):
        bits, part = rng.integers(0, 128, n).astype(np.uint8), rng.integers(0, 3, n)
        counts = filter_audit.prefix_counts(bits, [np.packbits(part == p) for p in range(3)])
        for p in range(3):
            for subset in range(32):
                kept = bits[(part == p) & (bits & subset == 0)]
                assert counts[p, subset].tolist() == [len(kept), int((kept >> 5 & 1).sum()), int((kept >> 6 & 1).sum())]


def plain_search(docs, items, k):
    """(item, rank, doc, score) straight from the definition; documents are rows."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, own in terms.items():
        scores = []
        for doc, bag, length in bags:
            m = 50 + 50 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in own if t in bag)
            if score > 0:
                scores.append((-score, -1 if doc is None else doc, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=repr)


def found_by(docs, items, k):
    return sorted((tuple(r) for r in ranked_search.ranked_search(docs, items, k).collect()), key=repr)


ITEMS = [(1, "ONE two été Été"), (2, None), (3, ""), (4, "missing"), (5, "three one"), (5, "w7 w9 w29999"), (None, "two cd")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, term string")


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_on_odd_rows(docs, items, k):
    assert found_by(docs, items, k) == plain_search([d[:2] for d in DOCS], ITEMS, k)


def test_search_of_empty_tables(docs, items):
    assert found_by(docs.limit(0), items, 5) == found_by(docs, items.limit(0), 5) == []


@pytest.mark.parametrize(("window", "postings", "block"), [(5, 10**6, 10**6), (8192, 40, 10**6), (64, 300, 60), (700, 10**6, 10)])
def test_windows_and_blocks_of_any_size(spark, monkeypatch, window, postings, block):
    monkeypatch.setattr(ranked_search, "WINDOW_POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "WINDOW", window)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    rng = np.random.default_rng(window)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) if x < 500) for _ in range(900)]
    rows = [(int(i) % 800, t) for i, t in zip(rng.permutation(900), texts, strict=True)]  # ids that two texts share, in no order
    items = [(i, " ".join(f"t{int(x)}" for x in rng.integers(1, 400, 12))) for i in range(15)]
    found = ranked_search.ranked_search(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_search(rows, items, 10)
