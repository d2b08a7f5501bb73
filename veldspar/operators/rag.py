"""Retrieval for language models: chunkers, embedders, hybrid search, context assembly."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import text as T
from veldspar.functions import vector as V

CHUNK = "chunk_id string, document_id string, content string, chunk_index int, total_chunks int, start_offset long, end_offset long"


def chunk_fixed(docs: DataFrame, size: int = 512, overlap: int = 50, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """Windows of ``size`` characters, ``overlap`` in common; offsets in UTF-8 bytes; an empty text has no chunk."""
    step = max(1, size - overlap)
    text, n = F.col(text_col), F.char_length(text_col)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("int")
    spread = docs.where(n > 0).select(F.col(id_col).cast("string").alias("document_id"), text.alias("_t"), (last + 1).alias("total_chunks"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    content = F.substr("_t", F.col("chunk_index") * step + 1, F.lit(size))
    start = F.octet_length(F.substr("_t", F.lit(1), F.col("chunk_index") * step)).cast("long")
    return spread.select(
        F.concat_ws("_", "document_id", "chunk_index").alias("chunk_id"), "document_id", content.alias("content"), "chunk_index", "total_chunks",
        start.alias("start_offset"), (start + F.octet_length(content)).alias("end_offset"),
    )


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s]


def pack_sentences(text: str, max_tokens: int) -> list[tuple[str, int, int]]:
    """(content, start, end): sentences joined while their characters make at most ``max_tokens`` tokens of 4; offsets count packed bytes."""
    out, now, start = [], "", 0
    for s in sentences(text):
        if now and (len(now) + len(s)) // 4 > max_tokens:
            end = start + len(now.encode())
            out.append((now, start, end))
            now, start = s, end
        else:
            now = f"{now} {s}" if now else s
    return out + [(now, start, start + len(now.encode()))] if now else out


def pack_paragraphs(text: str, max_size: int) -> list[tuple[str, int, int]]:
    """Paragraphs (parted by an empty line) joined up to ``max_size`` bytes."""
    out, now, start = [], "", 0
    for p in (x.strip() for x in text.split("\n\n")):
        if not p:
            continue
        if now and len(now.encode()) + len(p.encode()) + 2 > max_size:
            end = start + len(now.encode())
            out.append((now, start, end))
            now, start = p, end
        else:
            now = f"{now}\n\n{p}" if now else p
    return out + [(now, start, start + len(now.encode()))] if now else out


_HEADS = ("# ", "## ", "### ", "#### ", "---", "***", "===")


def pack_sections(text: str, max_size: int) -> list[tuple[str, int, int]]:
    """Sections from heading to heading; one over ``max_size`` bytes is cut into fixed chunks of that many characters, 50 in common."""
    sections: list[list[str]] = [[]]
    for line in text.split("\n"):
        if line.startswith(_HEADS) and any(x.strip() for x in sections[-1]):
            sections.append([])
        sections[-1].append(line)
    out, start = [], 0
    for lines in sections:
        body = "\n".join(lines)
        size, content = len(body.encode()), body.strip()
        if content and size <= max_size:
            out.append((content, start, start + size))
        elif content:
            step, at = max(1, max_size - 50), 0
            while True:
                piece = body[at : at + max_size]
                a = start + len(body[:at].encode())
                out.append((piece, a, a + len(piece.encode())))
                if at + max_size >= len(body):
                    break
                at += step
        start += size + 1
    return out


def _packed(docs: DataFrame, cut: Callable[[str], list[tuple[str, int, int]]], id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["d"], pdf["t"], strict=True):
                found = cut(text or "")
                rows += [(f"{doc}_{i}", doc, c, i, len(found), a, b) for i, (c, a, b) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNK.split(", ")])

    return docs.select(F.col(id_col).cast("string").alias("d"), F.col(text_col).alias("t")).mapInPandas(run, CHUNK)


def chunk_sentences(docs: DataFrame, max_tokens: int = 128, id_col: str = "id", text_col: str = "content") -> DataFrame:
    return _packed(docs, lambda t: pack_sentences(t, max_tokens), id_col, text_col)


def chunk_paragraphs(docs: DataFrame, max_size: int = 1000, id_col: str = "id", text_col: str = "content") -> DataFrame:
    return _packed(docs, lambda t: pack_paragraphs(t, max_size), id_col, text_col)


def chunk_sections(docs: DataFrame, max_size: int = 2000, id_col: str = "id", text_col: str = "content") -> DataFrame:
    return _packed(docs, lambda t: pack_sections(t, max_size), id_col, text_col)


class HashEmbedder:
    """Unit vectors from hashes of the whole text: stable, of the right shape, without meaning."""

    name = "local-hash"

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def column(self, text: Column) -> Column:
        raw = F.transform(F.sequence(F.lit(0), F.lit(self.dimension - 1)), lambda i: (F.pmod(F.xxhash64(text, i), F.lit(2000001)) / 1000000.0 - 1).cast("float"))
        return V.normalize(raw)


class TermEmbedder:
    """Counts of a vocabulary's words, unit length: term frequency without idf."""

    name = "tf"

    def __init__(self, vocabulary: Sequence[str]):
        self.vocabulary = list(dict.fromkeys(w.lower() for w in vocabulary))
        self.dimension = len(self.vocabulary)

    def column(self, text: Column) -> Column:
        words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
        hits = F.filter(words, lambda w: w.isin(*self.vocabulary))  # one pass; bound once, then counted for each word
        names = F.array(*[F.lit(w) for w in self.vocabulary])
        counts = F.element_at(F.transform(F.array(hits), lambda h: F.transform(names, lambda v: F.size(F.filter(h, lambda w: w == v)).cast("float"))), 1)
        return V.normalize(counts)


class RemoteEmbedder:
    """The interface of a hosted model: give it a function from texts to vectors; it runs as an Arrow-batched UDF."""

    # Dimensions of the hosted models.
    DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}

    def __init__(self, embed: Callable[[list[str]], np.ndarray] | None = None, model: str = "text-embedding-3-small"):
        self.embed, self.name, self.dimension = embed, model, self.DIMENSIONS[model]

    def column(self, text: Column) -> Column:
        embed = self.embed
        if embed is None:
            raise RuntimeError("a hosted model needs a function that calls it")

        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(list(np.asarray(embed(s.fillna("").tolist()), np.float32)))

        return run(text)


def embedder(name: str, embed: Callable[[list[str]], np.ndarray] | None = None) -> HashEmbedder | RemoteEmbedder:
    if name in ("local", "hash", "local-hash"):
        return HashEmbedder()
    models = {"openai": "text-embedding-3-small", "openai-small": "text-embedding-3-small", "openai-large": "text-embedding-3-large"}
    if name not in models:
        raise ValueError(f"unknown embedder {name}")
    return RemoteEmbedder(embed, models[name])


WEIGHTS = {"balanced": (0.5, 0.5), "keyword": (0.7, 0.3), "semantic": (0.3, 0.7)}


def hybrid(nodes: DataFrame, text_col: str, vec_col: str, query: str, vector: Sequence[float], k: int = 10, mode: str = "balanced", least: int = 1) -> DataFrame:
    """rank, id, score and both ranks: the best 3k of a keyword and of a vector search, merged by reciprocal ranks."""
    terms = query.lower().split()
    by_score = Window.orderBy(F.desc("s"), "id")
    keyword = nodes.select("id", T.keyword_score(F.col(text_col), terms, least).alias("s")).where("s > 0").orderBy(F.desc("s"), "id").limit(3 * k)
    keyword = keyword.select("id", F.row_number().over(by_score).alias("keyword_rank"))
    near = nodes.select("id", V.cosine_similarity(F.col(vec_col), V.literal(vector)).alias("s")).where("s is not null").orderBy(F.desc("s"), "id").limit(3 * k)
    near = near.select("id", F.row_number().over(by_score).alias("vector_rank"))
    w_k, w_v = WEIGHTS[mode]
    both = keyword.join(near, "id", "full_outer")
    both = both.withColumn("score", T.rrf(w_k, F.col("keyword_rank")) + T.rrf(w_v, F.col("vector_rank")))
    best = both.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("rank", "id", "score", "keyword_rank", "vector_rank")


def keyword_search(nodes: DataFrame, text_col: str, query: str, k: int = 10) -> DataFrame:
    found = nodes.select("id", T.keyword_overlap(F.col(text_col), query).alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), "id").limit(k)


def within_budget(ranked: DataFrame, max_tokens: int, text_col: str = "content") -> DataFrame:
    """The longest prefix of a ranked list (of bounded size) whose estimated tokens fit."""
    tokens = ranked.withColumn("estimated_tokens", T.estimate_tokens(F.col(text_col)))
    total = F.sum("estimated_tokens").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("total_tokens", total).where(F.col("total_tokens") <= max_tokens)


def retrieve(chunks: DataFrame, vec_col: str, vector: Sequence[float], max_tokens: int = 4000, min_score: float = 0.0, text_col: str = "content", rerank: Callable[[Column], Column] | None = None) -> DataFrame:
    """rank, id, content, score, estimated_tokens, total_tokens. With ``rerank`` the score is the mean of both."""
    k = min(max(max_tokens // (100 if rerank is None else 50), 10 if rerank is None else 20), 100 if rerank is None else 200)
    s = V.cosine_similarity(F.col(vec_col), V.literal(vector))
    best = chunks.select("id", F.col(text_col).alias("content"), s.alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)
    best = best.where(F.col("score") >= min_score)
    if rerank is not None:
        best = best.withColumn("score", 0.5 * F.col("score") + 0.5 * rerank(F.col("content")))
    return within_budget(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))), max_tokens)


def format_for_llm(context: DataFrame, doc_col: str | None = None) -> DataFrame:
    """One text of a context's chunks, with sources and relevance, in their order."""
    doc = F.concat(F.lit("(Doc: "), F.col(doc_col), F.lit(") ")) if doc_col else F.lit("")
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), doc, F.format_string("(Relevance: %.2f)\n", "score"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("p"))))
    return context.agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "\n\n---\n\n").alias("text"))


def text_only(context: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "content")))
    return context.agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n").alias("text"))


def to_json(context: DataFrame, query: str, doc_col: str | None = None, index_col: str | None = None) -> DataFrame:
    """One JSON text of a context: query, total_tokens, chunks with content, score, and document and index where there are such columns."""
    parts = ["rank", "content", "score"]
    chunk = F.struct(*parts, *[F.col(c).alias(n) for c, n in ((doc_col, "document_id"), (index_col, "chunk_index")) if c])
    chunks = F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x.dropFields("rank"))
    return context.agg(F.to_json(F.struct(F.lit(query).alias("query"), F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("total_tokens"), chunks.alias("chunks"))).alias("json"))


def ingest(docs: DataFrame, made: HashEmbedder | TermEmbedder | RemoteEmbedder, size: int = 512, overlap: int = 50, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """Fixed chunks with embeddings."""
    chunks = chunk_fixed(docs, size, overlap, id_col, text_col)
    return chunks.withColumn("embedding", made.column(F.col("content")))
