"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, filter_audit, jaccard_trie, language_crf, main_text, quality_cascade, ranked_search, source_mixing, suffix_dedup, token_cache, topk_blocks, toxicity_fm
from .common import fold_of, load, shared_dir

#: The paths of the vocabularies are parameters; these are the installed public ones.
PIECE_MODEL, BYTE_RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The setting that names the folder of a token cache which lasts from run to run.
TOKEN_CACHE = "spark.atheneum.tokenCache"
TOKEN_LIMIT, TOP_K, QUERY_STEP, MIX_BUDGET, RANKED = 4096, 20, 20, 0.8, 50


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(load(spark, sf_dir, "documents"), length=100)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = language_crf.fit(docs, ~held_out)
    return language_crf.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.jaccard_components(load(spark, sf_dir, "documents"), n=4, percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with the cache that the session names in ``TOKEN_CACHE``; where it names none, with one in the shared folder, which later runs find."""
    cache = spark.conf.get(TOKEN_CACHE, None) or f"{shared_dir(spark)}/token-cache"
    return token_cache.count_tokens(load(spark, sf_dir, "documents"), PIECE_MODEL, cache, limit=TOKEN_LIMIT)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(load(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = toxicity_fm.fit(docs, labels, ~held_out)
    return toxicity_fm.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.assess(load(spark, sf_dir, "documents")).drop("rejected_by")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_blocks.integer_rows(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_blocks.top_k(rows, rows.filter(F.col("vec_id") % QUERY_STEP == 0), TOP_K)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.conversation_digests(chat_format.format_turns(rows.unionByName(extra)))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mixing.mix_report(load(spark, sf_dir, "documents"), MIX_BUDGET)
    return out.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.round("probability", 5).alias("probability"), "drawn")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each source, for every order of them."""
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extract(load(spark, sf_dir, "pages"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for each benchmark item."""
    return ranked_search.ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), RANKED)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_jaccard_join, op4_token_counts, op5_byte_bpe, op6_toxicity, op7_quality_rules, op8_topk_search, op9_chat_format, op10_source_mixing, op11_filter_audit, op12_html_extraction, op13_ranked_search)}

_WORD = r"[^\x20\x09-\x0D]+"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
t AS (SELECT r, unnest(list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: {{'i': i, 'g': words[i] || chr(31) || words[i+1] || chr(31) || words[i+2]}})) AS x FROM w),
g AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.g) AS n FROM t),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, range(3) AS o(k) WHERE n > 1 GROUP BY r),
b AS (SELECT w.*, len(words) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 5 * n_symbols <= n_words AND 4 * n_dup_lines <= 3 * len(lines)
  AND 2 * len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) <= n_words
  AND 2 * len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) >= n_words
  AND 2 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) <= len(lines)
  AND 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) <= 9 * len(lines) AS kept
FROM f
"""

OP8_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

_CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "[ROLE]")


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in _CONTROLS:
        out = f"replace({out}, '{c}', '\\{c}')"
    return f"length({out})"


OP9_SQL = f"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_escaped("text")} + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 8 ELSE 20 + {_escaped("role")} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_SUBSETS = ", ".join(f"count(*) FILTER (bits & {s} = 0) AS k{s}, count(*) FILTER (good AND bits & {s} = 0) AS g{s}, count(*) FILTER (toxic AND bits & {s} = 0) AS t{s}" for s in range(32))
_LISTS = ", ".join(f"[{', '.join(f'{c}{s}' for s in range(32))}] AS {c}" for c in "kgt")
OP11_SQL = rf"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT coalesce(CAST(doc_id AS HUGEINT), CAST(-9223372036854775808 AS HUGEINT) - 1) AS i, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words FROM d),
b AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN i > min(i) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS bits FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, {_SUBSETS} FROM b GROUP BY part),
s AS (SELECT part, {_LISTS} FROM c),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
o AS (SELECT f0.f AS a0, f1.f AS a1, f2.f AS a2, f3.f AS a3, f4.f AS a4 FROM f f0, f f1, f f2, f f3, f f4 WHERE len(list_distinct([f0.f, f1.f, f2.f, f3.f, f4.f])) = 5),
p AS (SELECT unnest([{{'o': [a0, a1, a2, a3, a4], 'step': 1, 'f': a0, 'b': 0}}, {{'o': [a0, a1, a2, a3, a4], 'step': 2, 'f': a1, 'b': 1 << a0}}, {{'o': [a0, a1, a2, a3, a4], 'step': 3, 'f': a2, 'b': (1 << a0) + (1 << a1)}},
  {{'o': [a0, a1, a2, a3, a4], 'step': 4, 'f': a3, 'b': (1 << a0) + (1 << a1) + (1 << a2)}}, {{'o': [a0, a1, a2, a3, a4], 'step': 5, 'f': a4, 'b': 31 - (1 << a4)}}]) AS x FROM o),
r AS (SELECT part, array_to_string(list_transform(x.o, lambda v: substr('ABCDE', v + 1, 1)), '') AS filter_order, CAST(x.step AS INTEGER) AS step, x.f AS f,
  k[x.b + (1 << x.f) + 1] AS kept, k[x.b + 1] - k[x.b + (1 << x.f) + 1] AS removed, k[1] - k[(1 << x.f) + 1] AS failing, k[32 - (1 << x.f)] - k[32] AS unique_fails,
  g[x.b + 1] - g[x.b + (1 << x.f) + 1] AS good_lost, t[x.b + 1] - t[x.b + (1 << x.f) + 1] AS toxic_lost FROM s, p)
SELECT part, filter_order, step, kept, removed, failing - removed AS redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS N, CAST(sum(len(terms)) AS BIGINT) AS L FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * N + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT r, doc_id, 50 + (50 * len(terms) * N) // L AS m FROM d, s WHERE len(terms) > 0),
c AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""

ORACLE_SQL = {"op7_quality_rules": OP7_SQL, "op8_topk_search": OP8_SQL, "op9_chat_format": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_ranked_search": OP13_SQL}
