"""Bounded traversal, shortest paths and components over an edge table (src, dst, edge_type).

Frontiers grow in rounds of one join each; every round is written to the shared folder, so a lost executor costs one
round and plans stay short. The join strategy is left to Catalyst, which broadcasts a frontier only while it is small.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder_for(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares; where none is set, in the warehouse, or in local mode in /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "/tmp/checkpoints" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str = "graph") -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = folder_for(df.sparkSession, label)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._kept_at = path
    return found


def forget(*stored: DataFrame) -> None:
    """Deletes tables that ``kept`` wrote, once what was made of them is written itself."""
    for df in stored:
        if path := getattr(df, "_kept_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@dataclass
class Traversal:
    """nodes (id, depth), edges that were followed, adjacency of expanded nodes, and the requested depth."""

    nodes: DataFrame
    edges: DataFrame
    depth: int

    @property
    def adjacency(self) -> DataFrame:
        return self.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


FEW = 1000


def traverse(spark: SparkSession, nodes: DataFrame, edges: DataFrame, starts: Sequence[str], max_depth: int, edge_types: Sequence[str] | None = None, edges_from: Callable[[list[str]], DataFrame] | None = None) -> Traversal:
    """Directed search from ``starts``; a node is expanded if its least depth is under ``max_depth``.

    Edges are all matching out-edges of expanded nodes; targets that are no nodes are not among the nodes. A
    start that is no node is an error. Rounds add their new nodes to those before, which are not written again. With
    ``edges_from``, the out-edges of a frontier of at most FEW nodes are looked up by their ids instead of a join with all edges.
    """

    def typed(df: DataFrame) -> DataFrame:
        return df.where(F.col("edge_type").isin(*edge_types)) if edge_types else df

    def known(ids: DataFrame) -> DataFrame:
        return nodes.select("id").join(F.broadcast(ids), "id").distinct() if few else ids.join(nodes.select("id"), "id", "left_semi")

    few = len(set(starts)) <= FEW
    seeds = spark.createDataFrame([(s,) for s in dict.fromkeys(starts)], "id string")
    seen = frontier = kept(known(seeds).withColumn("depth", F.lit(0)))
    if seen.count() < len(set(starts)):
        raise ValueError("a start is not in the graph")
    followed = []
    for depth in range(1, max_depth + 1):
        found = frontier.select("id").limit(FEW + 1).collect() if edges_from else []
        few = 0 < len(found) <= FEW
        ids = frontier.select(F.col("id").alias("src"))
        out = kept(typed(edges_from([r["id"] for r in found])) if few else typed(edges).join(ids, "src", "left_semi"), "followed")
        followed.append(out)
        reached = out.select(F.col("dst").alias("id")).distinct()
        few = out.limit(100 * FEW + 1).count() <= 100 * FEW
        fresh = kept(known(reached.join(seen, "id", "left_anti")).withColumn("depth", F.lit(depth)))
        if not fresh.head(1):
            break
        seen, frontier = seen.union(fresh), fresh
    all_edges = typed(edges).limit(0)
    for one in followed:
        all_edges = all_edges.unionByName(one)
    return Traversal(seen, all_edges, max_depth)


def shortest_path(spark: SparkSession, edges: DataFrame, start: str, end: str, max_depth: int = 10) -> list[str] | None:
    """The shortest directed path of at most ``max_depth`` edges, the least by its ids among equals; None without one."""
    if start == end:
        return [start]
    frontier = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = frontier.select("id")
    for _ in range(max_depth):
        step = frontier.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("dst", F.concat("path", F.array("dst")).alias("path"))
        step = kept(step.groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
        hit = step.where(F.col("id") == end).head(1)
        if hit:
            return list(hit[0]["path"])
        if not step.head(1):
            return None
        frontier, seen = step, kept(seen.union(step.select("id")))
    return None


def components(nodes: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, component): weakly connected components, named by their least id; with ``kind``, those that hold a node of it.

    Alternating big and small stars: every round replaces links by links to smaller nodes, until each node has one link, to its
    component's least. What is grouped is a minimum, combined before its
    shuffle; the links of a hub meet in the joins only, whose skewed side the engine splits. Long chains take logarithmically many rounds.
    """
    ids = nodes.select("id").distinct()
    both = edges.select("src", "dst").where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = kept(both.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark, before = now, links
        # big star: a node's larger neighbours point at its least neighbour
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.min("b").alias("m")).where("m < a")
        moved = links.join(least.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        big = kept(moved.where("a <> b"))
        # small star: a node and its smaller neighbours point at the least of them; with one smaller neighbour nothing moves
        low = big.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        many = big.join(low.where("n > 1").drop("n"), "a")
        links = kept(many.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        forget(before, big)
    labels = ids.join(links.select(F.col("a").alias("id"), F.col("b").alias("label")), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    out = labels.withColumnRenamed("label", "component")
    if kind is not None:
        wanted = nodes.where(F.col("type") == kind).select("id").join(out, "id").select("component").distinct()
        out = out.join(wanted, "component", "left_semi").select("id", "component")
    return out


def graph_view(edges: DataFrame, typed: DataFrame) -> DataFrame:
    """All out-edges of a type's nodes."""
    return edges.join(typed.select(F.col("id").alias("src")), "src", "left_semi")
