"""Registered queries of the operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfscope.llm import (bpe, conversations, language, merkle, oracles, packing, privacy, quality, secrets, simhash, structure,
                            suffixes, tiling, toxicity)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(_table(spark, sf_dir, "documents"))


def op4_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.privacy_report(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats_report(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(_table(spark, sf_dir, "documents"))


def op10_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.render(_table(spark, sf_dir, "conversations"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(_table(spark, sf_dir, "documents"), VOCABULARY)


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.structure_report(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_bpe": op2_bpe,
    "op3_language": op3_language,
    "op4_privacy": op4_privacy,
    "op5_toxicity": op5_toxicity,
    "op6_tiling": op6_tiling,
    "op7_quality": op7_quality,
    "op8_suffixes": op8_suffixes,
    "op9_simhash": op9_simhash,
    "op10_conversations": op10_conversations,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
    "op13_structure": op13_structure,
}

# op1: each kind's matches and the pieces between them give the places; the
# expressions are spelled out here, in another dialect, on purpose.
_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k(no, kind, pat, least, grp) AS (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?[A-Za-z0-9+/_.=-]+', 12, true),
  (1, 'access', 'AKIA[A-Z0-9]+', 18, false),
  (2, 'hex', '[0-9a-f]{16,}', 16, false),
  (3, 'pem', '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 0, false),
  (4, 'github', 'gh[pousr]_[A-Za-z0-9]{36,}', 0, false),
  (5, 'slack', 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, false),
  (6, 'jwt', 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}', 0, false)),
m AS (SELECT doc_id, no, kind, least, grp, regexp_extract_all(t, pat) AS ms, string_split_regex(t, pat) AS ps
      FROM d, k WHERE regexp_matches(t, pat)),
s AS (SELECT doc_id, no, kind, least, grp, ms[i] AS v,
        list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS b
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
f AS (SELECT doc_id, no, kind, b, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + length(v) AS BIGINT) AS span
      FROM s WHERE CASE WHEN grp THEN length(regexp_extract(v, '^.*?[A-Za-z]["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= least
                        ELSE length(v) >= least END),
g AS (SELECT doc_id, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS c, count(*) FILTER (no = 2) AS h,
        string_agg(span, ',' ORDER BY b, no) FILTER (no < 3) AS base, string_agg(span, ',' ORDER BY b, no) AS every
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

# op7: the windows of a text as lists of words; measures from plain list functions.
_OP7 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
p AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
      (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, length(t) - length(translate(t, '!?', '')) AS n_marks,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_marks > n_words
       OR 2 * n_dup_lines > n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM m
"""

# op10: whole prefixes as texts, no hashes; separators that no text holds.
_OP10 = r"""
WITH t AS (SELECT conv_id, coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) || chr(3) AS piece,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS shown,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM conversations),
p AS (SELECT conv_id, n, string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY n) AS prefix,
    string_agg(shown, '') OVER (PARTITION BY conv_id ORDER BY n) AS shown, count(*) OVER (PARTITION BY conv_id) AS total FROM t),
w AS (SELECT prefix, min(conv_id) AS conv_id, any_value(shown) AS shown, any_value(total) AS total FROM p WHERE n = total GROUP BY prefix)
SELECT conv_id, CAST(total AS BIGINT) AS n_turns, shown AS text FROM w
WHERE prefix NOT IN (SELECT prefix FROM p WHERE n < total)
"""

ORACLE: dict[str, str] = {
    "op1_secrets": _OP1,
    "op7_quality": _OP7,
    "op10_conversations": _OP10,
    "op11_merkle": oracles.MANIFEST,
    "op13_structure": oracles.STRUCTURE,
}
