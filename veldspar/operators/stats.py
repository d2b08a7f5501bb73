"""Aggregates that the engine itself uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.keys import shard_of
from veldspar.operators.graph import kept


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.countDistinct("type").alias("schema_count"))
    return a.withColumn("edge_count", F.lit(edges.count()).cast("long")).select("node_count", "edge_count", "schema_count")


def by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def centroid(vectors: DataFrame, column: str) -> DataFrame:
    """(pos, mean): a row for each component, in double precision; none if lengths differ or there are no vectors."""
    found = vectors.where(F.col(column).isNotNull())
    parts = found.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.withColumn("_l", F.min("n").over(whole)).withColumn("_h", F.max("n").over(whole)).where("_l = _h").select("pos", "mean")


def vocabulary(texts: DataFrame, column: str, size: int) -> DataFrame:
    """The ``size`` most frequent lower-case words; ties by word."""
    words = texts.select(F.explode(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size)


def shards(nodes: DataFrame, n: int = 16) -> DataFrame:
    return nodes.groupBy(shard_of(F.col("id"), n).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def shard_totals(nodes: DataFrame, edges: DataFrame, n: int = 16) -> DataFrame:
    """shard, node_count, edge_count, size_bytes of every shard, by ids and sources; the row without a shard holds the totals."""
    own = sorted(c for c in nodes.columns if c not in ("id", "type"))
    size = F.octet_length(F.to_json(F.struct(*own))) if own else F.lit(0)
    both = nodes.select(shard_of(F.col("id"), n).alias("shard"), F.lit(1).alias("v"), F.lit(0).alias("e"), size.alias("s"))
    both = both.union(edges.select(shard_of(F.col("src"), n), F.lit(0), F.lit(1), F.lit(0)))
    sums = [F.sum(c).cast("long").alias(a) for c, a in (("v", "node_count"), ("e", "edge_count"), ("s", "size_bytes"))]
    return both.rollup("shard").agg(*sums)


def tiered(meta: DataFrame, hot: int) -> DataFrame:
    """tier, n, bytes: payloads (payload_size) in the hot tier, of at most ``hot`` bytes each, and in the cold one."""
    tier = F.when(F.col("payload_size") <= hot, "hot").otherwise("cold")
    return meta.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum("payload_size").cast("long").alias("bytes"))


def graph_stats(links: DataFrame) -> DataFrame:
    """num_vectors, total, average and largest number of connections of an index's (src, dst) table."""
    by = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("num_vectors"), F.sum("n").alias("total_connections"), F.avg("n").alias("avg_connections"), F.max("n").alias("max_connections"))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def eviction_candidates(meta: DataFrame, cap: int, least: int = 256, share: float = 0.8) -> DataFrame:
    """Payloads to evict, oldest first, until what is left fits in ``share`` of ``cap``: id, payload_size, freed.

    Running sums have two levels: rows are sorted by ranges, sums of whole ranges go ahead of those inside one.
    """
    total = meta.agg(F.coalesce(F.sum("payload_size"), F.lit(0))).first()[0]
    big = meta.where(F.col("payload_size") >= least).repartitionByRange("updated_at", "id").withColumn("range", F.spark_partition_id())
    big = kept(big, "ranges")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = big.groupBy("range").agg(F.sum("payload_size").alias("s")).withColumn("ahead", F.coalesce(F.sum("s").over(ahead), F.lit(0))).drop("s")
    inside = Window.partitionBy("range").orderBy("updated_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    big = big.withColumn("before", F.coalesce(F.sum("payload_size").over(inside), F.lit(0))).join(F.broadcast(ranges), "range").withColumn("before", F.col("before") + F.col("ahead"))
    return big.where(F.lit(total) - F.col("before") > share * cap).select("id", "payload_size", (F.col("before") + F.col("payload_size")).alias("freed"))
