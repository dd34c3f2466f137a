"""Nulls, empty and long texts, repeated rows, empty tables and columns of clashing names, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from atheneum.llm import byte_bpe, chat_format, jaccard_trie, language_crf, quality_cascade, queries, source_mixing, suffix_dedup, token_cache, topk_blocks, toxicity_fm
from atheneum.llm.common import scratch

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of green tea near an old stone bridge at dawn and sing softly about rivers, hills and far away towns where nobody counts the hours or the coins that fall between the cobbles"
CLASH = ["id", "key", "doc", "th", "root", "node", "score", "rank", "digest", "version", "packed", "spans", "drawn", "probability", "mix_tokens", "ids", "decoded", "n_words", "kept", "g", "h", "name", "kind", "label", "n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), *["x"] * len(CLASH))


ROWS = [
    row(1, PROSE),
    row(2, PROSE),
    row(2, PROSE),  # a repeated row
    row(3, None, None, None),
    row(4, ""),
    row(5, "   \n\t "),
    row(None, PROSE + " and more"),
    row(6, "é" * 50_000),  # one very long word
    row(7, "Hallo Welt, wie geht es dir heute", "de"),
    row(8, "123 456"),
]
N = len(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_suffix_dedup(docs, none):
    found = by_id(suffix_dedup.removal_digests(docs))
    size = len(PROSE)
    assert sum(map(len, found.values())) == N
    assert found[None][0].n_removed == 0  # a null id comes first
    assert [(r.n_removed, r.n_spans) for r in [*found[1], *found[2]]] == [(size, 1)] * 3
    assert found[6][0].n_removed == 100_000 - 2 and found[3][0].n_bytes == found[4][0].n_bytes == 0
    assert found[3][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert suffix_dedup.removal_digests(none).count() == 0
    kept = by_id(suffix_dedup.cleaned(docs))
    assert kept[1][0].text == "" and kept[None][0].text == PROSE + " and more" and kept[3][0].text is None and kept[6][0].text == "é"


def test_language(docs, none):
    assert {r.lang_pred for r in language_crf.predict(docs, None).collect()} == {"und"}
    model = language_crf.fit(docs, F.lit(True))
    found = by_id(language_crf.predict(docs, model))
    assert sum(map(len, found.values())) == N
    assert [found[i][0].lang_pred for i in (3, 4, 5, 8)] == ["und"] * 4 and found[3][0].score == 0
    assert found[1][0].lang_pred == found[2][1].lang_pred == "en" and found[7][0].lang_pred == "de" and found[6][0].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for rs in found.values() for r in rs)
    assert language_crf.fit(none, F.lit(True)) is None and language_crf.predict(none, model).count() == 0


def test_jaccard(docs, none):
    found = by_id(jaccard_trie.jaccard_components(docs))
    assert sum(map(len, found.values())) == N
    assert [r.component_id for r in [*found[1], *found[2], *found[None]]] == [1, 1, 1, 1]
    assert [(found[i][0].n_shingles, found[i][0].component_id) for i in (3, 4, 5)] == [(0, 3), (0, 4), (0, 5)]
    assert (found[6][0].n_shingles, found[8][0].n_shingles) == (1, 1)
    assert jaccard_trie.jaccard_components(none).count() == 0


def test_token_counts(spark, docs, none):
    cache = scratch(spark, "cache")
    found = by_id(token_cache.count_tokens(docs, queries.PIECE_MODEL, cache, limit=10))
    assert sum(map(len, found.values())) == N and found[3][0].n_tokens == found[4][0].n_tokens == 0
    assert found[1][0].n_tokens == found[2][0].n_tokens > 10 and found[1][0].over_limit and found[6][0].n_bytes == 100_000
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in ROWS})
    assert by_id(token_cache.count_tokens(docs, queries.PIECE_MODEL, cache)) and spark.read.parquet(cache).count() == stored.count()  # all hits: nothing is appended
    assert token_cache.count_tokens(none, queries.PIECE_MODEL, scratch(spark, "cache")).count() == 0


def test_byte_bpe(docs, none):
    import public_tokenizers

    found = by_id(byte_bpe.encode_digests(docs, queries.BYTE_RANKS, public_tokenizers.PATTERN))
    assert sum(map(len, found.values())) == N
    for doc_id, text in ((r[0], r[1] or "") for r in ROWS):
        assert found[doc_id][0].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert found[3][0].n_tokens == 0 and found[3][0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.encode_column(none, queries.BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0, "x"), (2, 1, "x"), (2, 0, "x"), (7, 1, "x"), (6, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    for model in (toxicity_fm.fit(docs, labels, F.lit(True)), toxicity_fm.fit(docs, labels.limit(0), F.lit(True))):
        found = toxicity_fm.score(docs, model).collect()
        assert len(found) == N and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
        assert toxicity_fm.score(none, model).count() == 0


def test_quality(docs, none):
    found = by_id(quality_cascade.assess(docs))
    assert sum(map(len, found.values())) == N
    assert (found[1][0].n_words, found[1][0].base_failed) == (len(PROSE.split()), len(PROSE.split()) < 50)
    for i in (3, 4, 5):
        assert (found[i][0].n_words, found[i][0].base_failed, found[i][0].kept) == (0, True, False)
    assert quality_cascade.assess(none).count() == quality_cascade.keep_good(none).count() == 0
    assert quality_cascade.keep_good(docs).columns == docs.columns


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0]), (20, [-1.0, -0.25])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, score string, ints string")
    ints = topk_blocks.integer_rows(df, "vec_id", "embedding")
    found = topk_blocks.top_k(ints, ints.filter("vec_id % 20 = 0"), 2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [(0, 1, 1, 64 * 64 + 32 * 32), (0, 2, 2, 64 * 64 + 32 * 32), (20, 1, 0, -64 * 64 - 16 * 32), (20, 2, 1, -64 * 64 - 16 * 32)]
    empty = topk_blocks.integer_rows(df.limit(0), "vec_id", "embedding")
    assert topk_blocks.top_k(empty, empty, 5).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "</s>"), (1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x\\"), (None, 0, "system", "[ROLE]"), (2, 0, "assistant", "a" * 100_000)]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, id string, formatted string")
    found = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (found[1].n_turns, found[1].turns_sha256) == (4, digest(("", "x\\"), ("user", ""), ("user", ""), ("assistant", "</s>")))
    assert (found[1].loss_chars, found[1].loss_sha256) == (4, hashlib.sha256(b"</s>").hexdigest()) and found[None].turns_sha256 == digest(("system", "[ROLE]")) and found[2].loss_chars == 100_000
    assert chat_format.conversation_digests(chat_format.format_turns(df.limit(0))).count() == 0


def test_mixing(docs, none):
    found = by_id(source_mixing.mix_report(docs))
    assert sum(map(len, found.values())) == N and len({r.drawn for r in found[2]}) == 1
    assert found[3][0].mix_source == found[3][0].mix_lang == "(none)" and all(0 <= r.probability <= 1 for rs in found.values() for r in rs)
    whole = source_mixing.mixed(docs, 1.0)
    given = {tuple(r) for r in ROWS}
    assert whole.columns == docs.columns and {tuple(r) for r in whole.collect()} <= given and whole.count() > 0  # columns called probability, drawn and so on keep their values
    assert source_mixing.mix_report(none).count() == source_mixing.mixed(none).count() == 0


def test_mixing_by_given_tokens_and_topics(docs):
    found = by_id(source_mixing.mix_report(docs, tokens=F.col("doc_id") * 10, topics=F.when(F.col("doc_id") < 5, "low")))
    assert (found[2][0].mix_tokens, found[2][0].mix_topic, found[7][0].mix_topic, found[None][0].mix_tokens) == (20, "low", "(none)", 0)


@pytest.mark.parametrize("name", ["doc", "key", "given_id"])
def test_id_columns_of_any_name(docs, name):
    rows = docs.select(F.col("doc_id").alias(name), "text")
    for found in (suffix_dedup.removal_digests(rows, id_col=name), jaccard_trie.jaccard_components(rows, id_col=name)):
        assert found.columns[0] == name and sorted(r[0] or 0 for r in found.collect()) == sorted(r[0] or 0 for r in ROWS)


def test_many_texts_without_id(spark):
    texts = [f"{PROSE} {i}" for i in range(40)]
    rows = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    chosen = suffix_dedup.removals(rows).collect()
    assert len(chosen) == 39 and all(r.spans for r in chosen)  # one of them stays whole, the others lose what it has said


def test_token_cache_of_the_session(spark, docs):
    spark.conf.set(queries.TOKEN_CACHE, scratch(spark, "kept"))
    try:
        cold = sorted(queries.op4_token_counts(spark, "/root/testdata/sf0.001").collect())
        stored = spark.read.parquet(spark.conf.get(queries.TOKEN_CACHE)).count()
        warm = sorted(queries.op4_token_counts(spark, "/root/testdata/sf0.001").collect())
        assert cold == warm and stored and spark.read.parquet(spark.conf.get(queries.TOKEN_CACHE)).count() == stored
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)
    assert sorted(queries.op4_token_counts(spark, "/root/testdata/sf0.001").collect()) == cold


def test_contents_of_equal_form_count_apart():
    """What the tokenizer's own normaliser folds or drops may share a count; what it tells apart has digests of its own."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    pairs = [("a b", "a  b"), ("ﬁn", "fin"), ("a", "a "), ("x\ty", "x y"), ("é", "e\u0301")]
    for a, b in pairs:
        assert token_cache._counter(queries.PIECE_MODEL)([a, b]) == [len(model.encode(a)), len(model.encode(b))]


def test_numerals_are_no_letters(spark):
    rows = spark.createDataFrame([(1, "½ ² Ⅷ 7"), (2, "a½b"), (3, "½")], "doc_id long, text string")
    assert [language_crf.words_of(t) for t in ("½ ² Ⅷ 7", "a½b", "ñ½ x")] == [[], ["a", "b"], ["ñ", "x"]]
    model = language_crf.LanguageCRF.train([("a b", "en"), ("ñ x", "es")])
    assert [r.lang_pred == "und" for r in language_crf.predict(rows, model).orderBy("doc_id").collect()] == [True, False, True]


def test_quality_is_its_sql_on_odd_characters(spark, tmp_path):
    import duckdb

    lines = ["½ ² Ⅷ\n" * 30, "word½ " * 60, "…\u00a0\n" * 5 + "one two\n" * 60, "\u2003- bullet line here\n" * 40, " - bullet line here\n" * 40, "tail...\v\n" * 60, "tail...\f\n" * 60, "É É É\n" * 30]
    spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.op7_quality_rules(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(db.sql(queries.OP7_SQL).select(*found.columns).fetchall())


def test_components_that_do_not_settle_are_an_error(spark):
    from atheneum.llm.components import connected_components

    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        connected_components(path, max_rounds=1)
    assert {tuple(r) for r in connected_components(path).collect()} == {(i, 0) for i in range(51)}


def test_pipeline_stages(spark, docs, none):
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, "").columns == documents.columns
        assert stage(spark, none.select(*documents.columns), "").count() == 0
    kept = corpus_pipeline.near_duplicates(spark, documents, "")
    assert kept.filter("doc_id IN (1, 2)").count() == 1
    assert {r.n_tokens for r in corpus_pipeline.encoding(spark, documents, "").filter("doc_id = 3").collect()} == {0}


def test_pipeline_stages_leave_other_columns_alone(spark, docs, none):
    """Columns of any name, those of the stages' own helpers among them, stay as they were."""
    more = ["given", "own", "gone_id", "gone_th", "__th", "__doc", "__kept", "_metadata"]
    wide = docs.withColumns({c: F.lit(c) for c in more})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found, empty = stage(spark, wide, ""), stage(spark, none.withColumns({c: F.lit(c) for c in more}), "")
        rows = found.collect()
        assert found.columns == empty.columns == wide.columns and empty.isEmpty(), name
        assert rows or name == "quality_rules"
        assert all(r[c] == "x" for r in rows for c in CLASH) and all(r[c] == c for r in rows for c in more), name


def test_encoding_of_odd_rows(spark, docs, none):
    assert corpus_pipeline.encoding(spark, none, "").isEmpty()
    found = by_id(corpus_pipeline.encoding(spark, docs, ""))
    assert sum(map(len, found.values())) == N and set(next(iter(found.values()))[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids"}
    assert found[6][0].text == "é" * 50_000 and found[6][0].n_tokens == len(found[6][0].ids) and [r.text for r in found[2]] == [PROSE] * 2  # repeated rows stay
    assert found[3][0].text == found[4][0].text == "" and found[3][0].ids == [] and found[5][0].text == "   \n\t "


def test_near_duplicates_of_shared_and_null_ids(spark):
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abce")
    texts = [(1, a), (1, b), (1, b), (2, a + " z"), (3, b), (3, e), (None, c), (None, c), (None, c + " z"), (None, a), (None, ""), (None, "")]
    documents = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, documents, "").collect()), key=str)
    assert [x for x in left if x[0]] == [(1, a), (1, b), (3, e)]
    assert left.count((None, "")) == 2 and len(left) == 6 and {t for i, t in left if i is None} - {""} in ({c}, {c + " z"})
