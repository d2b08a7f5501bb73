"""Full-text search: an inverted index as a table, and BM25."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import text as T
from veldspar.operators.graph import folder_for, kept


def postings(nodes: DataFrame, field: str) -> DataFrame:
    """(token, id, tf): one row for each distinct token of a document, counted before anything is shuffled."""
    return T.exploded(nodes.select("id", field), F.col(field)).groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def indexed_documents(nodes: DataFrame, field: str) -> int:
    return nodes.where(F.size(T.tokens(F.col(field))) > 0).count()


def search(nodes: DataFrame, field: str, query: str, limit: int = 10, true_length: bool = False) -> DataFrame:
    """rank, id, type, score and the properties of the ``limit`` best; a token that the query repeats counts again.

    Only query tokens are counted and kept, with the documents that have one. With ``true_length`` documents'
    lengths count, else a constant length does.
    """
    wanted = T.query_tokens(query)
    rest = sorted(c for c in nodes.columns if c not in ("id", "type"))
    if not wanted:
        return nodes.limit(0).select(F.lit(0).alias("rank"), "id", "type", F.lit(0.0).alias("score"), *rest)
    n = nodes.agg(F.count(F.lit(1)).alias("_n"), *([F.avg(F.size(T.tokens(F.col(field)))).alias("_a")] if true_length else [])).first()
    here = nodes.where(F.col(field).isNotNull()).select("id", field, F.size(T.tokens(F.col(field))).alias("length") if true_length else F.lit(0).alias("length"))
    hits = T.exploded(here, F.col(field)).where(F.col("token").isin(*dict.fromkeys(wanted)))
    tf = hits.groupBy("id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))
    return _best(nodes, tf, wanted, n["_n"], limit, float(n["_a"] or 1) if true_length else None)


def _best(nodes: DataFrame, hits: DataFrame, wanted: list[str], n: int, limit: int, average: float | None) -> DataFrame:
    """Ranked rows from the postings (id, length, token, tf) of the query's tokens."""
    marks = [(i, w, wanted.count(w)) for i, w in enumerate(dict.fromkeys(wanted))]
    rest = sorted(c for c in nodes.columns if c not in ("id", "type"))
    tf = kept(hits.groupBy("id", "length").agg(*[F.coalesce(F.max(F.when(F.col("token") == w, F.col("tf"))), F.lit(0)).alias(f"_{i}") for i, w, _ in marks]), "hits")
    df = tf.agg(*[F.count(F.when(F.col(f"_{i}") > 0, 1)).alias(f"_{i}") for i, _, _ in marks]).first()  # one row
    score = F.lit(0.0)
    for i, _, times in marks:
        part = T.tf_part(F.col(f"_{i}")) if average is None else T.tf_part(F.col(f"_{i}"), F.col("length"), F.lit(average))
        score = score + times * T.idf(F.lit(n), F.lit(df[f"_{i}"])) * F.when(F.col(f"_{i}") > 0, part).otherwise(0.0)
    best = tf.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return nodes.join(F.broadcast(best), "id").select("rank", "id", "type", "score", *rest).orderBy("rank")


class StoredIndex:
    """Postings written once, in directories by a hash of the token and sorted by it: a search reads the directories of its tokens
    only, and of these the row groups that can hold them. It holds for the snapshot that it was built from."""

    BUCKETS = 64

    def __init__(self, nodes: DataFrame, field: str):
        self.nodes, self.field = nodes, field
        found = T.exploded(nodes.select("id", field), F.col(field)).groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))
        found = found.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(self.BUCKETS)).cast("int"))
        path = folder_for(nodes.sparkSession, "postings")
        # a token that all documents hold is dealt out by ranges: a bucket may have several files
        found.repartitionByRange("bucket", "token", "id").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)
        self.postings = nodes.sparkSession.read.schema("token string, id string, tf long, bucket int").parquet(path)
        self.size = nodes.count()

    def documents(self) -> int:
        return self.postings.select("id").distinct().count()

    def of(self, tokens: list[str]) -> DataFrame:
        """The postings of some tokens."""
        names = list(dict.fromkeys(tokens))
        places = sorted({_signed(xxhash.xxh64_intdigest(t.encode(), 42)) % self.BUCKETS for t in names})
        return self.postings.where(F.col("bucket").isin(*places) & F.col("token").isin(*names))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """As ``search`` with constant lengths."""
        wanted = T.query_tokens(query)
        if not wanted:
            return search(self.nodes, self.field, query, limit)
        return _best(self.nodes, self.of(wanted).select("id", F.lit(0).alias("length"), "token", "tf"), wanted, self.size, limit, None)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
