"""The methods against brute force: sorters, tries, tokenizers, search, and accuracy held out."""

import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from atheneum.llm import byte_bpe, chat_format, jaccard_trie, language_crf, quality_cascade, queries, source_mixing, suffix_dedup, topk_blocks, toxicity_fm

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 150)), max_size=50), st.sampled_from([0, 8, 40]), st.sampled_from([2, 64]))
def test_deep_shallow_sort(places, shallow, trie_max):
    r = random.Random(len(places))
    text = bytes(r.choice(b"ab") for _ in range(301))
    starts = np.array([a for a, _ in places], np.int64)
    ends = np.minimum(starts + np.array([n for _, n in places], np.int64), len(text))
    order, same = suffix_dedup.sort_suffixes(np.frombuffer(text, np.uint8), starts, ends, shallow, trie_max)
    found = [text[starts[i] : ends[i]] for i in order]
    assert found == sorted(found) and same.tolist() == [i > 0 and found[i] == found[i - 1] for i in range(len(found))]


def test_removals_against_all_windows(spark, texts):
    import hashlib

    seen, want = set(), {}
    for doc_id in sorted(texts):
        b, spans = (texts[doc_id] or "").encode(), []
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                spans.append((s, s + 100))
            seen.add(w)
        spans = suffix_dedup.merge_spans(spans)
        want[doc_id] = (len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(suffix_dedup.without(b, spans)).hexdigest())
    found = {r.doc_id: tuple(r)[1:5] for r in queries.op1_suffix_dedup(spark, SMALL).collect()}
    assert found == want and any(w[1] for w in want.values())


def test_segments_of_long_texts_agree(monkeypatch):
    r = random.Random(3)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(5000))
    whole = suffix_dedup.owned_windows([text])
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    cut = suffix_dedup.owned_windows([text])
    windows = lambda x: {(s, h) for _, a, b, h in zip(*[c.tolist() for c in x], strict=True) for s in range(a, b + 1)}
    assert windows(whole) == windows(cut) and len(windows(whole)) == 4901


def components(texts, n, percent):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(jaccard_trie._LOWER))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, count):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefg") + r.choice("xyzuv") + str(r.randint(0, 40))
    out = []
    for _ in range(count):
        base = [word() for _ in range(r.choice([1, 3, 5, 9, 14, 40, 120]))]
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 20))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    r.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("n, percent, slice_elements", [(4, 85, 2_000_000), (5, 80, 2_000_000), (4, 85, 60)])
def test_jaccard_components(spark, monkeypatch, n, percent, slice_elements):
    monkeypatch.setattr(jaccard_trie, "SLICE_ELEMENTS", slice_elements)  # the last case cuts groups into slices
    monkeypatch.setattr(jaccard_trie, "BLOCK_BYTES", 500)
    docs = near_copies(percent + slice_elements % 7, 50)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_trie.jaccard_components(df, n, percent).collect()}
    assert found == components(docs, n, percent)


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.tokenizer(queries.BYTE_RANKS, public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_is_tiktoken(bpe, text):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    ids = bpe.encode(text)
    assert ids == reference.encode_ordinary(text) and bpe.decode(ids) == text.encode()


def test_bpe_on_documents_and_long_pieces(spark, bpe, texts):
    import hashlib

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for piece in ("ab" * 20_000, "thequickbrown" * 3_000, " " * 5_000, "é" * 5_000):
        assert bpe.encode(piece) == reference.encode_ordinary(piece)
    for r in queries.op5_byte_bpe(spark, SMALL).collect():
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_token_counts_are_the_library_s(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    for r in queries.op4_token_counts(spark, SMALL).collect():
        assert r.n_tokens == len(model.encode(texts[r.doc_id] or "")) and r.over_limit == (r.n_tokens > 4096)


def test_stored_counts_are_used(spark):
    """A count in the cache is given back as it is, for that very text and tokenizer; what is not there is encoded and stored."""
    import sentencepiece

    from atheneum.llm import token_cache
    from atheneum.llm.common import scratch

    model, cache = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL), scratch(spark, "cache")
    rows = [(1, "caf\u00e9"), (2, "cafe\u0301"), (3, "two  blanks"), (4, "two blanks"), (5, None), (6, ""), (7, "caf\u00e9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = spark.createDataFrame([(token_cache.tokenizer_version(queries.PIECE_MODEL), hashlib.sha256("caf\u00e9".encode()).digest(), 77), ("another tokenizer", hashlib.sha256(b"two blanks").digest(), 99)], token_cache.CACHE_SCHEMA)
    stored.write.parquet(cache)
    found = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(docs, queries.PIECE_MODEL, cache).collect()}
    assert found == {i: 77 if i in (1, 7) else len(model.encode(t or "")) for i, t in rows}
    version = token_cache.tokenizer_version(queries.PIECE_MODEL)
    held = {bytes(r.digest): r.n_tokens for r in spark.read.parquet(cache).filter(f"version = '{version}'").collect()}
    assert held == {hashlib.sha256((t or "").encode()).digest(): found[i] for i, t in rows}
    spark.createDataFrame([(version, hashlib.sha256(b"new").digest(), 5)], token_cache.CACHE_SCHEMA).write.mode("append").parquet(cache)
    more = spark.createDataFrame([(1, "new"), (2, "two blanks")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_cache.count_tokens(more, queries.PIECE_MODEL, cache).collect()} == {1: 5, 2: found[4]}


@pytest.mark.parametrize("block", [1, 7, 64])
def test_block_pruning_is_exact(block):
    r = np.random.default_rng(block)
    centres = r.normal(0, 40, (6, 16))
    rows = np.concatenate([centres[i] + r.normal(0, 4, (50, 16)) for i in range(6)]).astype(np.int64)
    rows[30:40] = rows[0]
    ids = np.arange(len(rows)) * 3
    at = np.arange(0, len(rows), 20)
    q, v, s, scored = topk_blocks.cell_topk(ids[at], rows[at], ids, rows, 20, block)
    want = []
    for i in at:
        score = rows @ rows[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        want += [(ids[i], ids[j], score[j]) for j in order]
    assert list(zip(q.tolist(), v.tolist(), s.tolist(), strict=True)) == want
    assert scored < len(at) * -(-len(rows) // block) if block < 64 else True


def test_groups_out_of_reach_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(topk_blocks, "GROUP", 200)
    monkeypatch.setattr(topk_blocks, "BLOCK", 16)
    r = np.random.default_rng(5)
    centres = r.normal(0, 40, (20, 16))
    rows = np.concatenate([centres[i % 20] + r.normal(0, 2, (1, 16)) for i in range(3000)]).astype(np.int64)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rows)], "vec_id long, ints array<long>").repartition(5)
    asked = df.filter("vec_id % 20 < 2 AND vec_id % 3 = 0")
    at = [i for i in range(3000) if i % 20 < 2 and i % 3 == 0]
    want = {(i, j, int(rows[j] @ rows[i])) for i in at for j in [j for j in np.lexsort((np.arange(3000), -(rows @ rows[i]))) if j != i][:20]}
    assert {(x.query_id, x.vec_id, x.score) for x in topk_blocks.top_k(df, asked, 20).collect()} == want
    grouped, own = topk_blocks.grouped_rows(df, asked)
    groups = grouped.select("group").distinct().count()
    first = topk_blocks.scores(grouped, own.selectExpr("*", f"{topk_blocks.NO_SCORE} AS least"), own.selectExpr("vec_id", "home AS group"), 20)
    visited = topk_blocks.reached(topk_blocks.seeded(own, first, 20), topk_blocks.group_maxima(grouped)).count()
    assert visited < 0.3 * len(at) * (groups - 1)  # on clustered rows most pairs of a query and a group are never scored
    monkeypatch.setattr(topk_blocks, "MAX_BROADCAST_MAXIMA", 4096)  # maxima that are sent in turn reach the same groups
    turns = topk_blocks.reached(topk_blocks.seeded(own, first, 20), topk_blocks.group_maxima(grouped))
    assert turns.count() == visited == turns.distinct().count() and groups * 16 * 16 > 3 * 4096
    assert {(x.query_id, x.vec_id, x.score) for x in topk_blocks.top_k(df, asked, 20).collect()} == want


def test_quality_order_never_changes_the_verdict(texts):
    found = [quality_cascade.Text(t) for t in texts.values()]
    forward = quality_cascade.first_rejection(found, list(quality_cascade.RULES))
    backward = quality_cascade.first_rejection(found, list(reversed(quality_cascade.RULES)))
    assert [x is None for x in forward] == [x is None for x in backward]


def test_quality_keeps_good_and_drops_junk(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = [r for r in queries.op7_quality_rules(spark, SMALL).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)


def test_languages_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = [r for r in queries.op2_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(found) > 150 and sum(r.lang_pred == lang[r.doc_id] for r in found) >= 0.97 * len(found)


def test_code_switches_are_found():
    en, de = "the house is on the hill and the river runs near it".split(), "das haus steht auf dem berg und der fluss ist nicht weit".split()
    model = language_crf.LanguageCRF.train([(" ".join(en), "en"), (" ".join(de), "de")] * 10)
    got = [model.labels[i] for i in model.marginals(en + de).argmax(axis=1)]
    assert sum(a == b for a, b in zip(got, ["en"] * len(en) + ["de"] * len(de), strict=True)) >= len(got) - 1


def test_forward_backward_against_enumeration():
    from itertools import product

    r = np.random.default_rng(1)
    scores, trans = r.normal(size=(1, 4, 3)), r.normal(size=(3, 3))
    weight = {p: np.exp(sum(scores[0, t, y] for t, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))) for p in product(range(3), repeat=4)}
    total = sum(weight.values())
    marginal, pairs, log_z = language_crf.forward_backward(scores, np.array([4]), trans)
    assert log_z == pytest.approx(np.log(total))
    assert marginal[0] == pytest.approx(np.array([[sum(w for p, w in weight.items() if p[t] == y) / total for y in range(3)] for t in range(4)]))
    assert pairs == pytest.approx(np.array([[sum(w * sum(x == (a, b) for x in zip(p, p[1:], strict=False)) for p, w in weight.items()) / total for b in range(3)] for a in range(3)]))


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    found = [(r.predicted, labels[r.doc_id]) for r in queries.op6_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    hit, miss, false = found.count((1, 1)), found.count((0, 1)), found.count((1, 0))
    assert hit / (hit + miss) > 0.9 and hit / (hit + false) > 0.95


def test_factorization_machine_against_all_pairs():
    r = np.random.default_rng(4)
    linear, factors, bias = r.normal(size=9), r.normal(size=(9, 3)), 0.3
    rows = [np.array(x, np.int64) for x in ([], [2], [0, 3, 8], list(range(9)))]
    want = [bias + sum(linear[i] for i in x) + sum(float(factors[x[a]] @ factors[x[b]]) for a in range(len(x)) for b in range(a)) for x in rows]
    assert toxicity_fm.FactorizationMachine.raw(rows, bias, linear, factors) == pytest.approx(np.array(want))


def test_pairs_weigh_what_their_parts_do_not():
    docs = [(f"{a} {b} {c}", int((a, b) == ("insult", "group"))) for a in ("insult", "kind") for b in ("group", "stone") for c in ("one", "two", "six")] * 40
    machine = toxicity_fm.FactorizationMachine.train(docs)
    both, *parts = machine.scores(["insult group one", "insult stone one", "kind group two", "kind stone six"])
    assert both > 0.5 > max(parts)
    slots = [machine.slot[t] for t in sorted(toxicity_fm.terms_of("insult group")) if t in machine.slot]
    assert toxicity_fm.FactorizationMachine.raw([np.array(slots)], 0.0, 0 * machine.linear, machine.factors)[0] > 0.5


def test_terms_beyond_chance_at_any_size():
    r = np.random.default_rng(1)
    for n in (60, 3_000):  # labels that have nothing to do with the terms leave few, real ones stay
        noise = r.chisquare(1, 5_000)
        assert len(toxicity_fm.beyond_chance(noise, np.ones(5_000, bool))) <= 5
        gain = np.concatenate([noise, np.full(20, n / 2.0)])
        kept = toxicity_fm.beyond_chance(gain, np.arange(len(gain)) != 5_003)
        assert set(range(5_000, 5_020)) - {5_003} <= set(kept.tolist()) and 5_003 not in kept and len(kept) <= 24


def test_marks_stay_in_their_words():
    assert language_crf.words_of("हिन्दी भाषा, e\u0301te\u0301 \u0301x ½a") == ["हिन्दी", "भाषा", "e\u0301te\u0301", "x", "a"]


def test_terms_tell_a_stem_used_throughout_from_one_word():
    import zlib

    terms = lambda *names: {zlib.crc32(x.encode()) for x in names}
    once, often = toxicity_fm.terms_of("wordless " + "a " * 200), toxicity_fm.terms_of("wordless wordily words worded " + "a " * 50)
    assert terms("wordless", "4word", "5wordl") <= once & often and terms("1x4word", "2x4word", "25r4word") <= often - once


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a[ROLE]\\"]), st.text(alphabet="\\[]</>sINSTROLE \n", max_size=25)), max_size=6))
def test_template_round_trip(turns):
    made = [chat_format.format_turn(r, t) for r, t in turns]
    assert chat_format.read_turns("".join(x[0] for x in made)) == turns
    assert [chat_format.unescape(x[0][x[1][0] : x[1][1]]) for x in made if x[1]] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    import json

    records = [
        {"prompt": "q", "completion": "a"},
        {"instruction": "i", "input": "", "output": "o"},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"dialog": {"turns": [{"speaker": "human", "text": "h"}]}},
        None,
        {"messages": []},
    ]
    df = spark.createDataFrame([(i, r and json.dumps(r)) for i, r in enumerate(records)], "id long, j string")
    found = {}
    for r in chat_format.canonical_turns(df, "id", "j").orderBy("id", "turn").collect():
        found.setdefault(r.id, []).append((r.role, r.text))
    assert found == {0: [("user", "q"), ("assistant", "a")], 1: [("user", "i"), ("assistant", "o")], 2: [("system", "s"), ("user", "")], 3: [("user", "h"), ("assistant", "g")], 4: [("user", "h")]}
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.turns_of({"what": 1})


def test_raking_meets_the_marginals(spark):
    from pyspark.sql import functions as F

    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5)).alias("source"), F.when(F.col("id") % 7 < 2, "de").otherwise("en").alias("lang"), F.repeat(F.lit("word "), (F.col("id") % 40 + 5).cast("int")).alias("text"))
    given = {"mix_source": {f"s{i}": 1.0 for i in range(5)}, "mix_lang": {"de": 0.4, "en": 0.6}}
    rows = source_mixing.measured(docs)
    plan = source_mixing.plan_mix(rows, 0.3, given, rounds=12).collect()
    total = sum(r.weight for r in plan)
    share = lambda key, value: sum(r.weight for r in plan if r[key] == value) / total
    assert all(share("mix_source", f"s{i}") == pytest.approx(0.2, abs=0.01) for i in range(5)) and share("mix_lang", "de") == pytest.approx(0.4, abs=0.01)
    tokens = sum(r.tokens for r in plan)
    assert sum(r.probability * r.tokens for r in plan) == pytest.approx(0.3 * tokens, rel=0.02)
    drawn = source_mixing.draw(rows, spark.createDataFrame(plan)).filter("drawn").agg(F.sum("mix_tokens")).first()[0]
    assert drawn == pytest.approx(0.3 * tokens, rel=0.15)


def test_mixing_against_plain_python(spark):
    import hashlib
    from collections import defaultdict

    table = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    rows = {}
    for doc_id, text, source, lang in zip(table["doc_id"], table["text"], table["source"], table["lang"], strict=True):
        text = text or ""
        topic = "contact" if "@" in text else "links" if "http" in text else "table" if " | " in text else "short_lines" if len(text.encode()) < 60 * len(text.split("\n")) else "prose"
        rows[doc_id] = ((source or "(none)", lang or "(none)", topic), len(text.encode().split()))
    tokens = defaultdict(int)
    for cell, n in rows.values():
        tokens[cell] += n
    total, shares = sum(tokens.values()), []
    for k, power in enumerate((0.7, 0.8, 0.9)):
        own = defaultdict(float)
        for cell, n in tokens.items():
            own[cell[k]] += n / total
        whole = sum(v**power for v in own.values())
        shares.append({v: x**power / whole for v, x in own.items()})
    weight = {c: float(n) for c, n in tokens.items()}
    for _ in range(source_mixing.ROUNDS):
        for k in range(3):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[k]] += w
            weight = {c: w * shares[k][c[k]] / sums[c[k]] for c, w in weight.items()}
    p = dict.fromkeys(tokens, 0.0)
    for _ in range(source_mixing.CAP_ROUNDS):
        left = 0.8 * total - sum(tokens[c] for c in p if p[c] >= 1)
        whole = sum(weight[c] for c in p if p[c] < 1)
        p = {c: 1.0 if x >= 1 else min(1.0, max(0.0, left) * weight[c] / whole / tokens[c]) for c, x in p.items()}
    found = queries.op10_source_mixing(spark, SMALL).collect()
    assert len(found) == len(rows)
    for r in found:
        cell, n = rows[r.doc_id]
        assert ((r.mix_source, r.mix_lang, r.mix_topic), r.mix_tokens) == (cell, n) and r.probability == pytest.approx(p[cell], abs=1e-5)
        number = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32
        assert r.drawn == (number < p[cell]) or abs(number - p[cell]) < 1e-9


def correlated(spark):
    """Each source 97 percent in a language of its own, one source with a third of the tokens."""
    rows, doc_id = [], 0
    for i in range(6):
        for j in range(6):
            for _ in range((100 if i == 0 else 40) if i == j else 1):
                rows.append((doc_id, f"s{i}", f"l{j}", "word " * (81 if i == j else 20)))
                doc_id += 1
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")


def marginal_errors(plan):
    for m in source_mixing.MARGINALS:
        for value in {r[m] for r in plan}:
            share = next(r[f"{m}_share"] for r in plan if r[m] == value)
            yield abs(sum(r.weight for r in plan if r[m] == value) / share - 1)


def test_raking_of_correlated_marginals_converges(spark):
    plan = source_mixing.plan_mix(source_mixing.measured(correlated(spark)), 0.8).collect()
    assert max(marginal_errors(plan)) <= 1.1 * source_mixing.TOLERANCE and plan[0].residual <= source_mixing.TOLERANCE


def test_raking_reports_targets_that_contradict(spark):
    docs = spark.createDataFrame([(0, "a", "de", "x " * 50), (1, "b", "en", "x " * 50)], "doc_id long, source string, lang string, text string")
    given = {"mix_source": {"a": 0.9, "b": 0.1}, "mix_lang": {"de": 0.5, "en": 0.5}}
    with pytest.warns(UserWarning, match="off its target"):
        plan = source_mixing.plan_mix(source_mixing.measured(docs), 0.8, given).collect()
    assert plan[0].residual == pytest.approx(max(marginal_errors(plan))) and plan[0].residual > 0.1


def test_all_of_a_long_run_of_letters_has_features():
    import zlib

    run = "a" * 60 + "bcd" + "e" * 60
    words = language_crf.words_of(run)
    slots = {s for w in words for s in language_crf.features(w)}
    assert "".join(words) == run and zlib.crc32(b"bcd") % language_crf.SLOTS in slots
    assert language_crf.words_of("a b" + "c" * 39) == ["a", "b" + "c" * 39]
