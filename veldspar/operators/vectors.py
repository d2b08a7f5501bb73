"""Vector search over a node table: exact top-k and radius, filtered, and approximate by random hyperplanes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import vector as V
from veldspar.operators.graph import folder_for
from veldspar.operators.predicates import Condition, where_present


def _scored(nodes: DataFrame, field: str, query: Sequence[float], metric: str) -> DataFrame:
    score, distance = V.score_and_distance(F.col(field), V.literal(query), metric)
    return nodes.withColumn("score", score).withColumn("distance", distance).where(F.col("score").isNotNull())


def _ranked(found: DataFrame) -> DataFrame:
    """Adds ``rank`` to a result of bounded size."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def search(nodes: DataFrame, field: str, query: Sequence[float], k: int = 10, metric: str = "cosine", conditions: Sequence[Condition] = ()) -> DataFrame:
    """The ``k`` best by score: rank, id, type, score, distance and the properties but the vector; ties by id.

    Conditions hold before the search. Vectors of another length, or without a score, take no part.
    """
    best = _scored(where_present(nodes, conditions), field, query, metric).orderBy(F.desc("score"), "id").limit(k)
    rest = sorted(c for c in nodes.columns if c not in ("id", "type", field) and not c.startswith("$"))
    return _ranked(best).select("rank", "id", "type", "score", "distance", *rest)


def search_radius(nodes: DataFrame, field: str, query: Sequence[float], most: float, metric: str = "cosine") -> DataFrame:
    """All nodes within ``most``, nearest first."""
    return _scored(nodes, field, query, metric).where(F.col("distance") <= most).select("id", "type", "score", "distance").orderBy("distance", "id")


def planes(dim: int, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


class HyperplaneIndex:
    """Buckets by the signs of random projections; candidates come from a few tables, from the
    query's bucket and those one sign away, and are reranked exactly.

    Signs are computed on the JVM, once: buckets are written by table and sorted by key, and a search reads those of its keys.
    The planes are a literal of fixed size. ``rebuild`` is a new instance over new rows.
    """

    def __init__(self, nodes: DataFrame, field: str, dim: int, bits: int = 6, tables: int = 16):
        self.nodes, self.field, self.bits = nodes, field, bits
        self.planes = planes(dim, bits, tables)
        keys = [self._key(F.col(field), t) for t in self.planes]
        usable = nodes.where(F.size(field) == dim)
        found = usable.select("id", F.posexplode(F.array(*keys)).alias("t", "key"))
        path = folder_for(nodes.sparkSession, "planes")
        found.repartitionByRange("t", "key", "id").sortWithinPartitions("t", "key").write.partitionBy("t").parquet(path)
        self.buckets = nodes.sparkSession.read.schema(f"id {dict(nodes.dtypes)['id']}, key int, t int").parquet(path).select("id", "t", "key")

    @staticmethod
    def _key(v, table: np.ndarray):
        signs = [F.when(V.dot(v, F.array(*[F.lit(float(x)) for x in p])) >= 0, 1 << i).otherwise(0) for i, p in enumerate(table)]
        return sum(signs[1:], signs[0])

    def search(self, query: Sequence[float], k: int = 10, metric: str = "cosine") -> DataFrame:
        wanted = F.lit(False)
        q = np.asarray(query, float)
        for t, p in enumerate(self.planes):
            own = int(sum(1 << i for i, s in enumerate(p @ q) if s >= 0))
            wanted = wanted | ((F.col("t") == t) & F.col("key").isin(own, *[own ^ (1 << i) for i in range(self.bits)]))
        hits = self.buckets.where(wanted).select("id").distinct()
        return search(self.nodes.join(hits, "id", "left_semi"), self.field, query, k, metric)

    def stats(self) -> DataFrame:
        by = self.buckets.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
        return by.agg(F.count(F.lit(1)).alias("buckets"), F.avg("n").alias("avg_size"), F.max("n").alias("max_size"))
