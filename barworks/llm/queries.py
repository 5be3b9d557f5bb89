"""The operators of this package as named queries over the given tables, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barworks.llm import bpe, chat, collocations, filter_audit, hilbert, jaccard, kneser_ney, language_id, licenses, mixing, quality, sequences, topk
from barworks.llm.arrow import prepared
from barworks.llm.licence_texts import EQUIVALENT, KNOWN
from barworks.session import shared_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Parts of the mix: the first source is to have a fifth of it.
WEIGHTS = {"src0": 5, **{f"src{i}": 1 for i in range(1, 20)}}
PLANTED_TURN = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(_table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, WEIGHTS)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similarity_classes(_table(spark, sf_dir, "documents"), jaccard.Join(words=3, percent=90))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(turns).alias("t")).select(
        "conv_id", "t.turn", "t.role", F.lit(PLANTED_TURN).alias("text")
    )
    return chat.read_back(chat.format_turns(rows.unionByName(planted))).drop("rewritten")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(prepared(spark))}/tokens-{uuid.uuid4().hex}"
    end = bpe.vocabulary_size(VOCABULARY)
    ids = bpe.encode_texts(_table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, sequences.narrowed(end), "ids binary")
    sequences.write_training_order(ids, path, end=end, given=sequences.id_type(end))
    return sequences.read_shards(spark, path).select(
        "slot", "shard", "doc_id", "piece", "n_tokens", F.crc32("payload").alias("payload_crc32")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(_table(spark, sf_dir, "documents"), shards=16).drop("hilbert")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    rounded = [F.round(c, 6).alias(c) for c in ("bits", "perplexity", "limit_bits")]
    return found.select("doc_id", "lang", "n_bytes", *rounded, "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(_table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 6))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(prepared(spark), sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans, op2_exact_top_k, op3_byte_level_bpe, op4_mixing_sources, op5_quality_rules, op6_ngram_jaccard_join,
        op7_chat_formatting, op8_token_output, op9_sharding, op10_quality_classifier, op11_filter_audit,
        op12_phrase_collocations, op13_language_id, pipeline,
    )
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(line: str) -> str:
    plain = f"""regexp_replace(lower({line}), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F‐-―‘-‟]+', ' ', 'g')"""
    out = f"' ' || trim({plain}, ' ') || ' '"
    for old, new in EQUIVALENT:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out}, ' ')"


def _lines_sql(text: str) -> str:
    keep = r"x <> '' AND NOT regexp_matches(x, '^(copyright|c)( c)? ([0-9]{4}|yyyy|year)( |$)|^all rights reserved$')"
    return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda y: {_canonical_sql('y')}), lambda x: {keep})"


OP1_SQL = f"""
WITH known AS (
  SELECT min(license_id) AS license_id, digest FROM (
    SELECT license_id, sha256(array_to_string({_lines_sql('body')}, ' ')) AS digest
    FROM (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in KNOWN)}) t(license_id, body)
  ) GROUP BY digest
), lined AS (
  SELECT row_number() OVER () AS r, doc_id, {_lines_sql('text')} AS lines FROM documents
), hits AS (
  SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS names, count(*) AS n
  FROM (SELECT r, sha256(unnest(lines)) AS digest FROM lined) JOIN known USING (digest) GROUP BY r
), whole AS (
  SELECT r, doc_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS digest FROM lined
)
SELECT doc_id, digest, license_id, coalesce(names, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
FROM whole LEFT JOIN known USING (digest) LEFT JOIN hits USING (r)
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id AS query_id, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v WHERE vec_id % 100 = 0
), c AS (
  SELECT vec_id, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v
), s AS (
  SELECT query_id, vec_id, sum(q.x * c.x)::BIGINT AS score FROM q JOIN c USING (i) WHERE query_id <> vec_id GROUP BY ALL
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
) WHERE rank <= 10
"""

OP5_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
  ) GROUP BY r
), b AS (
  SELECT doc_id, text, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS upper,
    length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS bangs
  FROM t LEFT JOIN rep USING (r)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
    OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 5 * n_repeat_words > 2 * n_words
    OR 10 * n_dup_lines > 5 * n_lines OR 2 * upper > letters OR 3 * digits > word_chars OR 3 * bangs > n_words
    OR 2 * letters < word_chars) AS kept
FROM f
"""

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"

OP7_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, {_quoted(PLANTED_TURN)} FROM (VALUES (0, 'user'), (1, 'assistant')) p(t, r)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || replace({_ESCAPED.format('role')}, ':', '\\:') || ': ' || {_ESCAPED.format('text')} || ' </turn>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP11_SQL = r"""
WITH RECURSIVE orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || c FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(c) WHERE length(o) < 5 AND NOT contains(o, c)
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), f AS (
  SELECT part, concat(
      CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
      CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM d LEFT JOIN marks USING (doc_id) GROUP BY ALL
), steps AS (
  SELECT o AS filter_order, s AS step, substr(o, s, 1) AS c, substr(o, 1, s - 1) AS earlier FROM orders, range(1, 6) r(s) WHERE length(o) = 5
), counted AS (
  SELECT part, filter_order, step, c,
    sum(CASE WHEN fails = '' OR NOT regexp_matches(fails, '[' || earlier || c || ']') THEN n ELSE 0 END)::BIGINT AS kept,
    coalesce(sum(n) FILTER (here), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (contains(fails, c) AND NOT here), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = c), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here), 0)::BIGINT AS toxic_lost
  FROM (SELECT *, contains(fails, c) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || '-]')) AS here FROM f, steps)
  GROUP BY part, filter_order, step, c
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM counted
"""

OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)
), counts AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 5) l(m)) GROUP BY ALL
), often AS (SELECT * FROM counts WHERE f >= 30
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang
), cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m > 1)
), scores AS (
  SELECT c.lang, c.m, c.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.head JOIN often y ON y.lang = c.lang AND y.phrase = c.tail
), weakest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, a, m, q, unnest(range(1, m - q + 2)) AS i, string_split(phrase, ' ') AS w FROM weakest, range(2, 4) t(q) WHERE q < m
), outer_most AS (
  SELECT lang, array_to_string(w[i:i + q - 1], ' ') AS phrase, max(a) AS top FROM longer GROUP BY ALL
), kept AS (
  SELECT w.* FROM weakest w LEFT JOIN outer_most o USING (lang, phrase) WHERE top IS NULL OR 100::HUGEINT * top < 80::HUGEINT * w.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES = {
    "op1_license_scans": OP1_SQL,
    "op2_exact_top_k": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
}
