"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents gives hashed byte n-gram weights, their truncated singular vectors and the
labelled latent vectors; these are of fixed size and go to the executors with the task. Every document is
projected from its whole text and compared with every labelled vector by exact blocked cosine products; the
nearest ones vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.common import annotate, labelled_sample, remainder, table

_CHUNK = 1 << 20


def ngram_counts(texts: list[str | None], dim: int) -> np.ndarray:
    """Counts of byte 2- and 3-grams, hashed to ``dim`` places, for each whole text."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        for start in range(0, max(0, len(raw) - 1), _CHUNK):
            a = raw[start : start + _CHUNK + 2].astype(np.uint32)
            two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
            two = two[: min(_CHUNK, len(two))]
            three = two[: len(a) - 2] + a[2 : 2 + len(two)] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
            for grams in (two, three):
                grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2545F491)) >> np.uint32(12)
                row += np.bincount((grams % np.uint32(dim)).astype(np.int64), minlength=dim)
    return out


def shape(text: str | None) -> list[float]:
    """Shares that n-gram counts show badly: words equal to the last one, lines equal to an earlier one, symbols, capitals."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found, lines = raw.split(), raw.split(b"\n")
    again = sum(a == b for a, b in zip(found, found[1:], strict=False))
    marks = len(raw) - len(raw.translate(None, b"#*$%&|<>!"))
    capitals = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    return [again / max(1, len(found)), 1 - len(set(lines)) / len(lines), marks / max(1, len(raw)), capitals / max(1, len(raw))]


def described(texts: list[str | None], dim: int) -> np.ndarray:
    """The columns of the term-document matrix: n-gram counts, then shares."""
    return np.hstack([ngram_counts(texts, dim), np.array([shape(t) for t in texts], np.float32).reshape(len(texts), SHARES)])


SHARES, SHARE_WEIGHT = 4, 1.5


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log counts times idf, beside the shares times SHARE_WEIGHT."""
    return np.hstack([_unit(np.log1p(x[:, :-SHARES]) * idf), SHARE_WEIGHT * x[:, -SHARES:]])


@dataclass
class Voters:
    """idf: weight of each place; axes: (places and shares, rank); points: unit latent vectors of labelled documents."""

    idf: np.ndarray
    axes: np.ndarray
    points: np.ndarray
    labels: np.ndarray
    near: int

    def project(self, texts: list[str | None]) -> np.ndarray:
        return _unit(weighted(described(texts, len(self.idf)), self.idf) @ self.axes)

    def score(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; 0 for a text without n-grams or with no voter."""
        out = np.zeros(len(texts))
        for start in range(0, len(texts) if len(self.points) else 0, block):
            cos = self.project(texts[start : start + block]) @ self.points.T
            k = min(self.near, cos.shape[1])
            best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cos, best, 1), 0).astype(float) ** 8
            total = weight.sum(1)
            out[start : start + block] = np.where(total > 0, (weight * self.labels[best]).sum(1) / np.maximum(total, 1e-300), 0)
        return np.clip(out, 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", each: int = 2500, dim: int = 2048, rank: int = 48, near: int = 15) -> Voters:
    """Learns from at most ``each`` labelled documents of either label (the first by hash of the id); held-out ids never enter."""
    sample = labelled_sample(docs, labels, label, each)
    fields = annotate(sample, lambda texts: [[row.tobytes() for row in described(texts, dim)]], "_c binary")
    rows = fields.select("doc_id", "_y", "_c").collect()  # 2 * each rows of 4 * dim bytes at most
    rows.sort(key=lambda r: (r[0], bytes(r[2])))
    x = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.float32).reshape(len(rows), dim + SHARES)
    idf = np.log((1 + len(x)) / (1 + (x[:, :dim] > 0).sum(0))).astype(np.float32) + 1
    x = weighted(x, idf)
    rng = np.random.default_rng(3)
    rank = min(rank, max(1, len(x)))
    basis = rng.standard_normal((len(x), rank + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration
        basis = np.linalg.qr(x @ (x.T @ basis))[0] if len(x) else basis
    axes = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:rank].T if len(x) else np.zeros((dim + SHARES, rank), np.float32)
    return Voters(idf, axes.astype(np.float32), _unit(x @ axes).astype(np.float32), np.array([r[1] for r in rows], float), near)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options: int) -> DataFrame:
    """``docs`` without its text, with held_out, score and predicted for every row.

    Null and empty texts score 0; without labels every score is 0; a null id counts as held out; repeated rows and
    ids get a row each; an empty table gives an empty result. Columns with the names of the results are replaced.
    """
    voters = fit(docs.select("doc_id", "text"), labels, **options)
    out = annotate(docs, lambda texts: [voters.score(texts)], "score double")
    return out.withColumn("held_out", remainder("doc_id") == 0).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
