"""The pipeline against brute force on the smallest table."""

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_methods import components

import corpus_pipeline
from atheneum.llm import byte_bpe, queries, suffix_dedup
from atheneum.llm.common import load, written

SMALL = "/root/testdata/sf0.001"
SQL_TABLES = ("documents", "embeddings", "conversations", "labels", "benchmark")


def test_stages_against_brute_force(spark):
    docs, after = load(spark, SMALL, "documents"), {}
    after[""] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = after[name] = written(stage(spark, docs, SMALL), f"test-{name}")
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in after.items()}
    kept = {r.doc_id for r in queries.op7_quality_rules(spark, SMALL).collect() if r.kept}
    assert set(rows["quality_rules"]) == kept and 0 < len(kept) < len(rows[""])
    groups = components({i: r.text for i, r in rows["quality_rules"].items()}, 5, 80)
    assert set(rows["near_duplicates"]) == {i for i, (_, c) in groups.items() if i == c}
    seen = set()
    for i in sorted(rows["near_duplicates"]):
        b, spans = rows["near_duplicates"][i].text.encode(), []
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                spans.append((s, s + 100))
            seen.add(b[s : s + 100])
        left = suffix_dedup.without(b, suffix_dedup.merge_spans(spans))
        text = rows["suffix_dedup"][i].text
        assert text == left.decode(errors="ignore") or len(spans) and text.encode() in (left, left.decode(errors="ignore").encode())
        assert rows["suffix_dedup"][i].n_chars == len(text)
    drawn = rows["source_mixing"]
    assert 0 < len(drawn) <= len(rows["suffix_dedup"]) and all(drawn[i].text == rows["suffix_dedup"][i].text for i in drawn)
    bpe = byte_bpe.read_ranks(queries.BYTE_RANKS)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe, special_tokens={})
    last = rows["byte_bpe"]
    assert set(last) == set(drawn) and all(last[i].ids == reference.encode_ordinary(drawn[i].text) and last[i].text == drawn[i].text for i in drawn)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for t in SQL_TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda columns, rows: sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in rows)
    assert order(df.columns, df.collect()) == order(want.columns, want.fetchall())
