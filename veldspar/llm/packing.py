"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Bins are kept in the order of what is left in them, and carry two bitmaps: which sources they hold (a few bits for
each) and which duplicate clusters. A document goes to the tightest bin that is compatible: the search starts at the
least sufficient residual and goes on to the successors until neither bitmap objects.

Documents are dealt out by hash to shards of a few thousand, as many as the table needs, and each shard is packed
by itself, largest first: every task is bounded however large the table, a source or a cluster is.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.common import store, table
from veldspar.llm.mixing import words_in
from veldspar.llm.simhash import with_component

CAPACITY = 2048
PER_SOURCE = 4
SHARD = 4096


def best_fit(sizes: Sequence[int], sources: Sequence[object], clusters: Sequence[object], capacity: int, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each item, taken in the given order; no size is over ``capacity``.

    A bin takes at most ``per_source`` items of a source and one of a cluster; None clusters never conflict.
    """
    number: dict[object, int] = {}
    group: dict[object, int] = {}
    full = (1 << per_source) - 1
    left: list[tuple[int, int]] = []
    by_source: list[int] = []
    by_cluster: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = per_source * number.setdefault(source, len(number))
        c = 0 if cluster is None else 1 << group.setdefault(cluster, len(group))
        at = bisect_left(left, (size, -1))
        while at < len(left) and ((by_source[left[at][1]] >> s) & full == full or by_cluster[left[at][1]] & c):
            at += 1
        room, b = left.pop(at) if at < len(left) else (capacity, len(by_source))
        if b == len(by_source):
            by_source.append(0), by_cluster.append(0)
        held = (by_source[b] >> s) & full
        by_source[b] |= ((held + 1) ^ held) << s & full << s  # the next bit of the source
        by_cluster[b] |= c
        out.append((b, capacity - room))
        if room > size:
            insort(left, (room - size, b))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, cluster_col: str | None = None) -> DataFrame:
    """doc_id, piece, size, bin, offset: where the words of every row of ``docs`` go.

    A text of over ``capacity`` words fills whole bins with its first words and packs the rest, as pieces 0, 1, ...
    Duplicate clusters are ``cluster_col``, or equal texts without one; rows of a null cluster never conflict. A
    null source is a source. Null and empty texts get one piece of size 0 with a null bin; repeated rows and null ids are
    packed row by row; an empty table gives an empty result. Other columns are ignored.
    """
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.xxhash64("text").cast("string")
    items = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("words"), cluster.alias("cluster"), F.xxhash64("text").alias("h"))
    # rows equal in all of these may take each other's place: counted before the shuffle, then told apart by number, so that
    # the result doesn't depend on how the rows are partitioned, and many copies of a row are spread over the shards
    items = items.groupBy("doc_id", "source", "words", "cluster", "h").agg(F.count(F.lit(1)).alias("n"))
    items = store(items.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n"), "items")
    items = items.withColumn("tie", F.xxhash64("doc_id", "source", "cluster", "h", "row"))
    shards = max(1, -(-items.count() // shard))
    whole, rest = F.floor(F.col("words") / capacity).cast("long"), (F.col("words") % capacity).cast("long")
    full = items.where(whole > 0).select("doc_id", "tie", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    full = full.select("doc_id", "piece", F.lit(capacity).cast("long").alias("size"), F.concat(F.lit("full-"), F.hex("tie"), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.col("piece").cast("string")).alias("bin"), F.lit(0).cast("long").alias("offset"))
    empty = items.where("words = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("offset"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie", "doc_id", "row"], ascending=[False, True, True, True], kind="stable")
        clusters = [None if pd.isna(c) else c for c in pdf["cluster"]]
        found = best_fit(pdf["size"].tolist(), [None if pd.isna(s) else s for s in pdf["source"]], clusters, capacity, per_source)
        return pd.DataFrame({"doc_id": pdf["doc_id"].array, "piece": pdf["piece"].array, "size": pdf["size"].array, "bin": [f"{key[0]}-{b}" for b, _ in found], "offset": [o for _, o in found]})

    parts = items.where(rest > 0).select(F.col("doc_id").cast("string").alias("doc_id"), "source", "cluster", "row", whole.alias("piece"), rest.alias("size"), "tie")
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("tie"), F.lit(shards)).cast("int"))
    packed = parts.groupBy("shard").applyInPandas(run, "doc_id string, piece long, size long, bin string, offset long")
    packed = packed.withColumn("doc_id", F.col("doc_id").cast("long"))  # as text, pandas keeps null and large ids apart
    return packed.unionByName(full).unionByName(empty)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate clusters are SimHash's components, three words a shingle and three bits of difference: near copies keep apart, too."""
    return pack(with_component(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "_cluster"), cluster_col="_cluster")
