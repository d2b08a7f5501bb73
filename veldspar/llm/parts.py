"""The columns of op5, op9 and op10 that follow from the text or the url alone, with DuckDB twins.

Each query takes its rows from the whole operator and leaves out what a trained model says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.katz import op10_katz
from veldspar.llm.quality_rules import op9_quality_rules
from veldspar.llm.url_filter import RULES, op5_url_filter

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"


def part9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


PART9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
places AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d),
windows AS (SELECT r, i, CASE WHEN i + 4 <= len(words) THEN array_to_string(words[i:i + 4], ' ') END AS win FROM places),
often AS (SELECT r, i, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS twice FROM windows),
inside AS (SELECT r, max(CAST(twice AS INT)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM often),
repeats AS (SELECT r, CAST(sum(x) AS BIGINT) AS n FROM inside GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN repeats USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
"""


def part5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict is that of the given rules; null where the mined ones decide."""
    return op5_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
PART5_SQL = rf"""
WITH rules(h, p, v) AS (VALUES {_RULE_ROWS}),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
urls AS (SELECT r, page_id, {_LOWER.format("raw")} AS host, path FROM parts),
best AS (
  SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, verdict FROM urls LEFT JOIN best USING (r)
"""


def part10_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_katz(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


# crc32 is a step a bit: a byte goes in with its first step, nothing with the other seven.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
         lambda a, b: xor(xor(a, b) >> 1, 3988292384::BIGINT * (xor(a, b) & 1))), 4294967295::BIGINT)"""
PART10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC} % 5, 0) = 1 AS held_out, list_concat({_WORDS.format(_LOWER.format("text"))}, ['']) AS tokens FROM documents),
placed AS (SELECT r, held_out, unnest(tokens) AS token FROM d),
own AS (SELECT r, held_out, token, count(*) AS n FROM placed GROUP BY ALL),
train AS (SELECT token, sum(n) AS c FROM own WHERE NOT held_out GROUP BY token),
whole AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS train_tokens, count(*) AS distinct_tokens FROM train),
sums AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(coalesce(sum(n) FILTER (c > 0), 0) AS BIGINT) AS n_known,
         sum(n * log10((coalesce(c, 0)::DOUBLE + 0.5) / (train_tokens + 0.5 * (distinct_tokens + 1)))) AS base
  FROM own LEFT JOIN train USING (token), whole GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base, 6) AS base_score FROM d JOIN sums USING (r), whole
"""

QUERIES = {f.__name__: f for f in (part5_rules, part9_counts, part10_base)}
SQL = {"part5_rules": PART5_SQL, "part9_counts": PART9_SQL, "part10_base": PART10_SQL}
