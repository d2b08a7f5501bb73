"""Scans, lookups, projections, orders and multi-gets over node tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions.keys import node_id, shard_of
from veldspar.operators.predicates import Condition, where
from veldspar.sources.tables import key_of


def by_type(nodes: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    found = nodes.where(F.col("type") == kind)
    return found if limit is None else found.orderBy("id").limit(limit)


def project(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``id`` and ``type`` first; without columns, all properties by name."""
    rest = columns if columns else sorted(c for c in df.columns if c not in ("id", "type"))
    return df.select("id", "type", *[c for c in rest if c not in ("id", "type")])


def select(df: DataFrame, columns: Sequence[str] | None = None, conditions: Sequence[Condition] = (), order: Sequence[tuple[str, bool]] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """``order``: (column, descending) pairs, first key first; nulls are lowest. OFFSET holds without LIMIT too."""
    out = where(df, conditions)
    if order:
        out = out.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order])
    out = out.offset(offset) if offset else out
    return project(out if limit is None else out.limit(limit), columns)


def get(nodes: DataFrame, ref: str) -> DataFrame:
    """The node of a full id, or of a bare id or path. A full id of a table with its key columns is looked up by these."""
    key = key_of(ref, nodes)
    if key is not None:
        return nodes.where(key).where(F.col("id") == ref)
    return nodes.where((F.col("id") == ref) | (node_id(F.col("id")) == node_id(F.lit(ref))) & (~F.lit(":" in ref)))


def multi_get(spark: SparkSession, nodes: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``pos`` and the nodes of ``ids`` in their order; ids that are not there give nulls."""
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, id string")
    found = [key_of(x, nodes) for x in dict.fromkeys(ids)]
    known = [x for x in found if x is not None]
    if known and len(known) == len(found):
        nodes = nodes.where(reduce(Column.__or__, known))
    return asked.join(nodes, "id", "left").orderBy("pos")


def shard_scan(nodes: DataFrame, shards: int, limit: int) -> DataFrame:
    """At most ``limit`` nodes over all shards, in the order of (shard, id): never fewer than there are."""
    return nodes.withColumn("shard", shard_of(F.col("id"), shards)).orderBy("shard", "id").limit(limit)


def union_types(frames: Sequence[DataFrame], conditions: Sequence[Condition] = ()) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return where(out, conditions)


def key_range(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows of the half-open range, in key order."""
    if start is not None:
        df = df.where(F.col(column) >= start)
    if end is not None:
        df = df.where(F.col(column) < end)
    return df.orderBy(column)


def prefix_scan(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).startswith(prefix)).orderBy(column)


def key_values(typed: DataFrame) -> DataFrame:
    rest = sorted(c for c in typed.columns if c not in ("id", "type"))
    return typed.select("id", F.to_json(F.struct(*rest)).alias("value"))


def metadata(typed: DataFrame) -> DataFrame:
    """id, type, payload_size (bytes of its JSON), property_count (not null)."""
    rest = sorted(c for c in typed.columns if c not in ("id", "type"))
    return typed.select("id", "type", F.octet_length(F.to_json(F.struct(*rest))).alias("payload_size"), sum((F.col(c).isNotNull().cast("int") for c in rest), F.lit(0)).alias("property_count"))


def page(df: DataFrame, key: str, after: object = None, size: int = 100) -> DataFrame:
    """A keyset page: the next ``size`` rows after a key."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)
