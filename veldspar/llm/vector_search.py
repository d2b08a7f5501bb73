"""Approximate nearest neighbours by additive quantisation.

A unit vector is coded as a sum of one full-dimensional codeword from each of several codebooks, chosen by beam
search; its code and the norm of its reconstruction are the index. A query turns each codebook into a table of inner
products, sums looked-up entries over the codes, divides by stored norms, and the best candidates are
reranked by the exact cosine in double precision on the original vectors.

Codebooks come from a bounded sample (a documented parameter); every row is coded. Queries are handled in blocks of
bounded size, each against all rows, and each task returns only its best k a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.llm.common import store, table


@dataclass
class Codebooks:
    """words: (books, words, dim) float32."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, books) of unit rows by beam search, and the norm of each reconstruction."""
        codes, rest = _beam(x, self.words, beam)
        return codes, np.maximum(np.sqrt(((x - rest) ** 2).sum(1)), 1e-9).astype(np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products (books, words, queries)."""
        return np.ascontiguousarray(np.einsum("bwd,qd->bwq", self.words, q, optimize=True), dtype=np.float32)


def _beam(x: np.ndarray, words: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n, dim = x.shape
    rest, codes, width = x[:, None, :], np.zeros((n, 1, 0), np.uint8), 1
    for book in words:
        half = 0.5 * (book * book).sum(1)
        cost = half - rest.reshape(-1, dim) @ book.T  # up to a constant of each row
        cost = cost.reshape(n, width, -1) + 0.5 * (rest * rest).sum(2)[:, :, None]
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        order = np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        parent, word = best // len(book), best % len(book)
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        width = keep
    return codes[:, 0], rest[:, 0]


def train(x: np.ndarray, books: int = 8, words: int = 256, rounds: int = 6) -> Codebooks:
    """Residual k-means, book after book, then least-squares refits of each book on beam-search codes."""
    rng = np.random.default_rng(5)
    rest, made = x.copy(), []
    for _ in range(books):
        centre = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = np.argmax(rest @ centre.T - 0.5 * (centre * centre).sum(1), axis=1)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(centre)
            np.add.at(total, near, rest)
            centre[count > 0] = total[count > 0] / count[count > 0, None]
        near = np.argmax(rest @ centre.T - 0.5 * (centre * centre).sum(1), axis=1)
        rest = rest - centre[near]
        made.append(centre)
    out = np.array(made, np.float32)
    for _ in range(2):
        codes, _ = _beam(x, out, 4)
        for b in range(books):
            others = sum(out[j][codes[:, j]] for j in range(books) if j != b)
            total, count = np.zeros_like(out[b]), np.bincount(codes[:, b], minlength=words)
            np.add.at(total, codes[:, b], x - others)
            out[b][count > 0] = total[count > 0] / count[count > 0, None]
    return Codebooks(out)


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows that take part: id and vector not null, every component finite, not all zero; v is array<double>."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # so that squares of very large or small components stay finite
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def build(rows: DataFrame, sample: int = 16384, books: int = 8) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks from at most ``sample`` rows (the first by hash of the id), and the index (id, v, code, norm) of all rows.

    Rows are (id, v) with vectors of one length.
    """
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = _unit(_matrix(chosen["v"])).astype(np.float32) if len(chosen) else np.zeros((0, 1), np.float32)
    if not len(x):
        return None, rows.selectExpr("id", "v", "cast(null as binary) code", "cast(null as float) norm")
    made = train(x, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                codes, norms = made.encode(_unit(_matrix(part.column("v"))).astype(np.float32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["id", "v", "code", "norm"])

    return made, rows.mapInArrow(code, "id long, v array<double>, code binary, norm float")


def _scan(made: Codebooks, query_ids: np.ndarray, queries: np.ndarray, k: int, depth: int):
    """A task function over index rows: approximate scores by lookup, exact cosines of the ``depth`` best a query and block, the best ``k``."""
    unit = _unit(queries)
    tables = made.tables(unit.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_q = len(query_ids)
        best_s, best_i = np.full((n_q, k), -np.inf), np.full((n_q, k), np.iinfo(np.int64).max)
        for batch in batches:
            order = np.argsort(batch.column("id").to_numpy(), kind="stable")
            ids, vectors = batch.column("id").to_numpy()[order], _unit(_matrix(batch.column("v")))[order]
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            norms = batch.column("norm").to_numpy()[order]
            for start in range(0, len(ids), 4096):
                own, vec = ids[start : start + 4096], vectors[start : start + 4096]
                part = codes[start : start + 4096]
                for at in range(0, n_q, 256):
                    block = slice(at, min(at + 256, n_q))
                    score = tables[0][part[:, 0], block]
                    for b in range(1, len(tables)):
                        score = score + tables[b][part[:, b], block]
                    score = (score / norms[start : start + 4096, None]).T
                    score[own[None, :] == query_ids[block, None]] = -np.inf
                    take = min(depth, len(own))
                    # rows are in the order of ids, so a stable sort gives equal codes in that order
                    least = -np.partition(-score, take - 1, axis=1)[:, take - 1]
                    rows, cols = np.nonzero(score >= least[:, None])
                    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
                    starts = np.flatnonzero(first)
                    above = score[rows, cols] > least[rows]
                    # ties at the edge: keep the smaller ids up to ``take``; copies of one vector have one code
                    need = take - np.add.reduceat(above, starts) if len(rows) else 0
                    owner = np.cumsum(first) - 1
                    tied = np.cumsum(~above) - (np.cumsum(~above)[starts] - ~above[starts])[owner]
                    kept = above | (tied <= need[owner])
                    rows, cols = rows[kept], cols[kept]
                    exact = np.einsum("ij,ij->i", unit[block][rows], vec[cols])
                    exact[~np.isfinite(score[rows, cols])] = -np.inf
                    all_r = np.r_[rows, np.repeat(np.arange(block.stop - block.start), k)]
                    all_s, all_i = np.r_[exact, best_s[block].ravel()], np.r_[own[cols], best_i[block].ravel()]
                    o = np.lexsort((all_i, -all_s, all_r))
                    rank = np.arange(len(o)) - np.searchsorted(all_r[o], all_r[o], side="left")
                    o = o[rank < k]
                    best_s[block], best_i[block] = all_s[o].reshape(-1, k), all_i[o].reshape(-1, k)
        rows, cols = np.nonzero(best_s > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[rows]), pa.array(best_i[rows, cols]), pa.array(best_s[rows, cols])], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, depth: int = 64, sample: int = 16384, block: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``vectors`` found for each row of ``queries``.

    Score is the cosine in double precision on the original vectors; ties go to the smaller id; a row is not a
    candidate for the query of its own id. Vectors that are null, zero, or hold null or non-finite components
    take no part; vectors are compared with those of their own length only. An id that comes twice is asked
    once, with its least vector, and may be found twice. Fewer than ``k`` candidates: all are returned. Empty tables give an
    empty result; other columns are ignored. ``block`` queries are sent to the tasks at a time, and each
    is compared with every code, so work grows with queries times rows: a whole-table search is for the index's scan.
    """
    spark = vectors.sparkSession
    rows = store(_usable(vectors, id_col, vec_col), "vectors")
    asked = store(_usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")), "queries")
    found = []
    for (dim,) in [tuple(r) for r in asked.select(F.size("v")).distinct().collect()]:
        made, index = build(rows.where(F.size("v") == dim), sample)
        if made is None:
            continue
        index = store(index, "index")
        ids, block_v = [], []

        def flush(index=index, made=made):
            q_ids, q = np.array(ids, np.int64), np.array(block_v)
            best = index.mapInArrow(_scan(made, q_ids, q, k, depth), "query_id long, vec_id long, score double")
            found.append(store(best, "nearest"))
            ids.clear(), block_v.clear()

        for r in asked.where(F.size("v") == dim).toLocalIterator():  # one block, of bounded size, is held at a time
            ids.append(r["id"]), block_v.append(r["v"])
            if len(ids) == block:
                flush()
        if ids:
            flush()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    merged = found[0]
    for x in found[1:]:
        merged = merged.unionByName(x)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
