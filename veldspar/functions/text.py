"""Text expressions: tokens, BM25 parts, overlaps, rerankers, token estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words that the full-text index leaves out.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "it", "its", "this", "that",
    "these", "those", "i", "me", "my", "we", "our", "you", "your", "he", "she", "they", "them", "their", "not", "no", "so", "if", "as",
)
SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"
K1, B, LENGTH = 1.2, 0.75, 100.0
KEYWORD_K1, KEYWORD_LENGTH = 1.5, 500.0
RRF_K = 60


def tokens(text: Column) -> Column:
    """Lower-case tokens of over one byte between non-alphanumerics, without stop words; null text: none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda t: F.octet_length(t) > 1)
    return F.filter(F.transform(parts, F.lower), lambda t: ~t.isin(*STOP_WORDS))


def exploded(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with a row for each token, ``token``: the same tokens by generated code, without lambdas."""
    parts = df.select("*", F.explode(F.split(text, SPLIT)).alias("_w")).where(F.octet_length("_w") > 1)
    return parts.withColumn("token", F.lower("_w")).drop("_w").where(~F.col("token").isin(*STOP_WORDS))


def query_tokens(query: str) -> list[str]:
    out, now = [], ""
    for c in query + " ":
        if c.isalnum():
            now += c
            continue
        if len(now.encode()) > 1 and now.lower() not in STOP_WORDS:
            out.append(now.lower())
        now = ""
    return out


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def tf_part(tf: Column, length: Column | None = None, average: Column | None = None) -> Column:
    """With constant lengths (the default) 2.2 tf / (tf + 1.2); with a length and its average, true BM25."""
    norm = F.lit(1.0) if length is None else 1 - B + B * length / average
    return tf * (K1 + 1) / (tf + K1 * norm)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(term)))) / len(term)).cast("long")


def keyword_score(text: Column, terms: Sequence[str], least: int = 1) -> Column:
    """Sum of saturated substring counts over terms, by length in characters; 0 under ``least`` matching terms."""
    lower, length = F.lower(F.coalesce(text, F.lit(""))), F.char_length(F.coalesce(text, F.lit("")))
    total, matched = F.lit(0.0), F.lit(0)
    for t in terms:
        n = occurrences(lower, t)
        part = n * (KEYWORD_K1 + 1) / (n + KEYWORD_K1 * (1 - B + B * length / KEYWORD_LENGTH))
        total, matched = total + F.when(n > 0, part).otherwise(0.0), matched + (n > 0).cast("int")
    return F.when(matched < least, 0.0).otherwise(total)


def keyword_overlap(text: Column, query: str) -> Column:
    """Share of the query's words that the text holds; 0 for an empty query."""
    terms = query.lower().split()
    lower = F.lower(F.coalesce(text, F.lit("")))
    return sum((lower.contains(t).cast("int") for t in terms), F.lit(0)) / len(terms) if terms else F.lit(0.0)


def bm25_rerank(text: Column, query: str) -> Column:
    """Mean saturated count of the query's words, at most 1; 1 for an empty query."""
    terms = query.lower().split()
    return F.least(keyword_score(text, terms, 0) / len(terms), F.lit(1.0)) if terms else F.lit(1.0)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def rrf(weight: float, rank: Column) -> Column:
    return F.coalesce(F.lit(weight) / (RRF_K + rank), F.lit(0.0))
