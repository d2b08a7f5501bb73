"""Connected components of a sparse graph by alternating big and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import drop, spread_join, store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): root is the smallest node of its component.

    Rounds map each node's links to its least neighbour (big star: larger neighbours, small star: smaller ones and
    itself) with a grouped minimum, which is combined before its shuffle, and a join. A hub's links would meet in that join:
    they are dealt out over several tasks. Rounds end when nothing changes; every round that
    changes something replaces a link by one to a smaller node, so they do end, after some log(n)^2 in practice.
    Loops and links with a null end are ignored; an empty table gives an empty result.
    """
    now = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == before:
            break
        before = mark
        # big star: for each node, its larger neighbours point at its least neighbour (or itself)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hubs = spread_join(now.select(F.col("b").alias("a"), F.col("a").alias("c")), least, ["a"])
        big = store(hubs.select(F.col("c").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
        # small star: each node and its smaller neighbours point at the least of them
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(big, low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        last, now = now, store(small.distinct(), "links")
        drop(last, big)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
