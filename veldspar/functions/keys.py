"""Identifiers and keys."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(ref: Column) -> Column:
    """The bare id of ``id``, ``type:id`` or ``path/id``."""
    return F.element_at(F.split(ref, "[:/]"), -1)


def property_key(value: Column, kind: str) -> Column:
    """Canonical text of a property value by kind: s, i, f, b, n or j."""
    shown = {"s": value, "i": value.cast("string"), "f": F.format_string("%.10f", value), "b": value.cast("string"), "n": F.lit(""), "j": F.to_json(value) if kind == "j" else value}
    return F.concat(F.lit(f"{kind}:"), shown[kind])


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def ring(shards: int, places: int = 150) -> list[tuple[int, int]]:
    """(hash, shard) of ``places`` virtual nodes for each shard, in the order of hashes."""
    made = [(xxhash.xxh64_intdigest(f"{s}:{i}".encode(), 42), s) for s in range(shards) for i in range(places)]
    return sorted((h - (1 << 64) if h >> 63 else h, s) for h, s in made)


def ring_shard(key: Column, points: list[tuple[int, int]]) -> Column:
    """The shard of a key: that of the first point of the ring at or after its hash, or of the first point. The ring is a literal.
    """
    hashes, shards = F.array(*[F.lit(h) for h, _ in points]), F.array(*[F.lit(s) for _, s in points])
    h = F.xxhash64(key)
    before = F.size(F.filter(hashes, lambda x: x < h))
    return F.element_at(shards, F.when(before >= len(points), 1).otherwise(before + 1).cast("int"))


def as_int(value: Column) -> Column:
    return value.cast("long")


def as_float(value: Column) -> Column:
    return value.cast("double")
