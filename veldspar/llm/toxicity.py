"""Toxicity: non-negative positive-unlabelled learning on hashed words.

Confirmed toxic documents are the positive sample; a bounded sample of all text, drawn without a look at labels, is the
unlabelled one. A numpy linear classifier minimises the risk pi * R+(P) + max(0, R-(U) - pi * R-(P)) with the logistic
loss; when the corrected negative part falls below zero, its gradient is stepped against, as in the non-negative
estimator. Weights are kept sparse, so that the few positives are not learnt by heart. pi is a parameter, or the share of
toxic rows among the labels, or, where only toxic rows are labelled, the least ratio of both samples' rates over a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.common import annotate, drop, hashed_parts, labelled_sample, one_of_each, remainder, store, table

DIM = 1 << 18
#: Places of words that the classifier sees, those whose rates in both samples differ most.
SEEN = 8192
HEADS = (4, 5, 6)
_EDGE = np.ones(256, bool)
_EDGE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def places(texts: list[str | None], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place), repeats included, of words between non-alphanumeric ASCII characters, A-Z in lower case: a place for
    the word and, so that inflected and joined words share, places for its first 4, 5 and 6 bytes."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts, h, heads = hashed_parts(np.frombuffer(b"\n".join(raws), np.uint8), _EDGE, HEADS)
    row = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right")
    at = np.concatenate([h, *(x for _, x in heads)]) % np.uint64(dim)
    return np.concatenate([row, *(row[i] for i, _ in heads)]), at.astype(np.int64)


def distinct(row: np.ndarray, at: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * dim + at)
    return both // dim, both % dim


@dataclass
class Linear:
    """weights: float32 by place, most of them 0."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, at = places(texts, len(self.weights))
        used = self.weights[at] != 0
        row, at = distinct(row[used], at[used], len(self.weights))
        z = np.bincount(row, self.weights[at], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk(z: np.ndarray, n_p: int, prior: float) -> tuple[float, float]:
    """(positive part, corrected negative part) of the risk under the logistic loss; the first ``n_p`` of ``z`` are positives."""
    high, low = np.logaddexp(0, -z), np.logaddexp(0, z)
    return float(prior * high[:n_p].mean()), float(low[n_p:].mean() - prior * low[:n_p].mean())


def slopes(z: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """What each of ``z`` adds to the step's direction: the gradient of the risk, or, where its negative part is below 0, minus that part's."""
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    d_neg = np.concatenate([-prior * p[:n_p] / n_p, p[n_p:] / (len(z) - n_p)])
    if risk(z, n_p, prior)[1] < 0:
        return -d_neg
    d_neg[:n_p] += prior * (p[:n_p] - 1) / n_p
    return d_neg


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, dim: int, steps: int = 300, rate: float = 0.05, decay: float = 3e-4, sparse: float = 0.05, least: int = 8) -> Linear:
    """Adam with falling steps on the non-negative risk over both whole samples (distinct places of each text); weights shrink
    towards 0 at each step, and the mean of the later half of the steps is taken. Without positives every score is the prior's."""
    if not positive or not unlabelled:
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        return Linear(np.zeros(dim, np.float32), float(np.log(prior / (1 - prior))))
    rows, n_p = [*positive, *unlabelled], len(positive)
    names = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=dim) >= least)
    column = np.full(dim, -1)
    column[names] = np.arange(len(names))
    cols = column[np.concatenate(rows)]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[cols >= 0]
    cols = cols[cols >= 0]
    w, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    m, v, mean = (np.zeros(len(names) + 1) for _ in range(3))
    for step in range(1, steps + 1):
        d = slopes(np.bincount(owner, w[cols], len(rows)) + bias, n_p, prior)
        grad = np.append(np.bincount(cols, d[owner], len(names)) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        now = rate * (1 - step / (steps + 1))
        move = now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - now * sparse, 0)
        if 2 * step > steps:
            mean += np.append(w, bias)
    mean /= steps - steps // 2
    w = np.where(np.abs(mean[:-1]) < 1e-3, 0, mean[:-1])
    z = np.sort(np.bincount(owner, w[cols], len(rows))[n_p:])
    k = min(len(z) - 1, int(np.ceil(len(z) * (1 - prior))))
    bias = -(z[k] + z[max(0, k - max(1, len(z) // 100))]) / 2  # the prior's share of the unlabelled sample scores over 0.5
    weights = np.zeros(dim, np.float32)
    weights[names] = w
    return Linear(weights, float(bias))


def least_ratio(positive: list[np.ndarray], unlabelled: list[np.ndarray], dim: int) -> float:
    """The class prior from both samples alone: over a naive Bayes score learnt on their even rows, the least ratio of the unlabelled
    to the positive rate of the odd rows above a threshold that at least a fifth of the positives pass."""

    def rates(rows: list[np.ndarray]) -> np.ndarray:
        return (np.bincount(np.concatenate(rows), minlength=dim) + 0.5) / (len(rows) + 1) if rows else np.full(dim, 0.5)

    weight = np.log(rates(positive[::2]) / rates(unlabelled[::2]))
    weight[np.abs(weight) < 0.7] = 0
    p, u = (np.sort([weight[r].sum() for r in rows[1::2]])[::-1] for rows in (positive, unlabelled))
    if len(p) < 5 or not len(u):
        return 0.5
    cuts = p[len(p) // 5 :]
    return float(np.min((np.searchsorted(-u, -cuts, side="right") + 1) / len(u) / (np.arange(len(p) // 5, len(p)) + 1) * len(p)))


def samples(docs: DataFrame, labels: DataFrame, label: str, each: int, dim: int, seen: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct places of the texts of at most ``each`` confirmed positives, and of at most twice as many texts of ``docs``, whatever
    their labels or lack of any; the first ids by hash, remainder 0 left out.

    The cluster counts in how many texts of both samples each place is; the ``seen`` places with the largest difference
    of rates, by its standard error, are kept, a bit of a fixed bitmap for each text: what comes to the driver is bounded.
    """
    toxic = labels.where(F.col(label) == 1).select("doc_id", label)
    known = labelled_sample(docs, toxic, label, each).select("doc_id", "text").withColumn("_p", F.lit(1))
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id") != 0)).select("doc_id").distinct()
    chosen = store(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * each), "unlabelled")
    drawn = one_of_each(docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text"), "doc_id", "text")

    def found(texts: list[str | None]) -> list[bytes]:
        row, at = distinct(*places(texts, dim), dim)
        return [x.astype(np.int32).tobytes() for x in np.split(at, np.searchsorted(row, np.arange(1, len(texts))))]

    both = store(annotate(known.unionByName(drawn.withColumn("_p", F.lit(0))), lambda texts: [found(texts)], "_w binary"), "places")
    drop(chosen)

    def count(batches):
        import pyarrow as pa

        counts = np.zeros((2, dim), np.int64)
        for batch in batches:
            for p, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[p, np.frombuffer(w.as_buffer(), np.int32)] += 1
        for p in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([counts[p].astype(np.uint32).tobytes()], pa.binary())], names=["p", "counts"])

    counts, size = np.zeros((2, dim)), [0, 0]
    for r in both.select("_p", "_w").coalesce(4).mapInArrow(count, "p int, counts binary").collect():  # two arrays of fixed size from each of four tasks
        counts[r["p"]] += np.frombuffer(bytes(r["counts"]), np.uint32)
    for r in both.groupBy("_p").count().collect():
        size[r["_p"]] = r["count"]
    rate = counts / np.maximum(1, np.array(size))[:, None]
    pooled = counts.sum(0) / max(1, sum(size))
    z = np.abs(rate[1] - rate[0]) / np.sqrt(pooled * (1 - pooled) * (1 / max(1, size[0]) + 1 / max(1, size[1])) + 1e-12)
    z[counts.sum(0) < 2] = 0
    kept = np.sort(np.argsort(-z, kind="stable")[:seen])
    number = np.full(dim, -1)
    number[kept] = np.arange(len(kept))

    def bits(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for w in batch.column(2):
                at, mark = number[np.frombuffer(w.as_buffer(), np.int32)], np.zeros(len(kept), bool)
                mark[at[at >= 0]] = True
                out.append(np.packbits(mark).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "_p", "_b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = both.select("doc_id", "_p", "_w").mapInArrow(bits, f"doc_id {kind}, _p int, _b binary").collect()  # 3 * each rows of seen / 8 bytes
    drop(both)
    rows.sort(key=lambda r: (r[0], bytes(r[2])))
    texts = [[kept[np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r[2]), np.uint8))[: len(kept)])] for r in rows if r[1] == p] for p in (1, 0)]
    return texts[0], texts[1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = 4000, dim: int = DIM, seen: int = SEEN, prior: float | None = None) -> Linear:
    """Learns from at most ``each`` toxic training documents and twice as many texts drawn from all of ``docs``.

    ``prior``, the share of toxic texts in ``docs``: if not given, the share among the labels of training rows, or, if these
    hold toxic ones only, ``least_ratio``. Rows labelled as not toxic serve this share only; ids with remainder 0 never enter.
    """
    positive, unlabelled = samples(docs, labels, label, each, dim, seen)
    if prior is None:
        known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id") != 0)).groupBy("doc_id").agg(F.max(label).alias("y"))
        share = float(known.agg(F.avg("y")).first()[0] or 0.0)
        prior = share if share < 1 else least_ratio(positive, unlabelled, dim)
    return train(positive, unlabelled, min(max(prior, 1e-3), 0.5), dim)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options: float) -> DataFrame:
    """``docs`` without its text, with held_out, score and predicted for every row.

    A null or empty text has no words and scores by the bias; without toxic labels all rows do. A null id
    counts as held out; repeated rows get a row each; an empty table gives an empty result. Columns with the
    names of the results are replaced.
    """
    model = fit(docs.select("doc_id", "text"), labels, **options)
    out = annotate(docs, lambda texts: [model.score(texts)], "score double")
    return out.withColumn("held_out", remainder("doc_id") == 0).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
