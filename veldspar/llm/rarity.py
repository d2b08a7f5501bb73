"""How frequent each of very many 64-bit items is: counts by hashed place over all rows, as a table of bounded size.

Tasks send sparse counts at 2^26 places, in slices; the slices are added up in the cluster, folded to as many places as
the input asks for, and come to the driver as one byte a place: the logarithm of the count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.blobs import put, take

FINEST, COARSEST = 26, 21
SLICE_BITS = 6
STEPS = 8
HELD = 2_000_000
TASKS = 16


class Sums:
    """Counts of a task by place; ``rows`` gives them up as (slice, blob) when many are held, and at the end."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, items: np.ndarray) -> None:
        self.held.append((items & np.uint64((1 << FINEST) - 1)).astype(np.uint32))
        self.n += len(items)

    def rows(self, all_of: bool = False) -> list[tuple[int, bytes]]:
        if not self.n or not (all_of or self.n > HELD):
            return []
        place, count = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.n = [], 0
        own = (place & np.uint32((1 << SLICE_BITS) - 1)).astype(np.uint8)
        order = np.argsort(own, kind="stable")
        place, count = place[order] >> np.uint32(SLICE_BITS), count[order].astype(np.uint32)
        cut = np.searchsorted(own[order], np.arange((1 << SLICE_BITS) + 1))
        return [(i, put(np.diff(place[a:b], prepend=np.uint32(0)), count[a:b])) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]


@dataclass
class Ranks:
    """One byte a place, 8 steps an octave of its count; ``usual`` is what a typical place holds: the median."""

    table: np.ndarray
    bits: int
    usual: int

    def of(self, items: np.ndarray) -> np.ndarray:
        place = (items & np.uint64((1 << FINEST) - 1)).astype(np.int64)
        inner = (place >> SLICE_BITS) & ((1 << (self.bits - SLICE_BITS)) - 1)
        return self.table[(place & ((1 << SLICE_BITS) - 1)) << (self.bits - SLICE_BITS) | inner]

    def own(self, rank: np.ndarray) -> np.ndarray:
        """At most how many occurrences beyond the usual a rank stands for: what a place has above it is one item's own."""
        return np.maximum(0, np.exp2((rank.astype(float) + 1) / STEPS).astype(np.int64) - self.usual)


def ranks(sums: DataFrame, total: int) -> Ranks:
    """The table of (slice, blob) rows of ``total`` occurrences: a place for some 64 of them, 2^21 to 2^26 places."""
    bits = min(FINEST, max(COARSEST, (max(1, total) // 64).bit_length()))
    size = 1 << (bits - SLICE_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place, count = take(blob.as_py())
                place = np.cumsum(place, dtype=np.int64) & (size - 1)
                if i not in found:
                    found[i] = np.zeros(size, np.int64)
                np.add.at(found[i], place, count)
        rows = [(i, np.minimum(255, np.log2(np.maximum(c, 1)) * STEPS).astype(np.uint8).tobytes()) for i, c in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "ranks"])

    table = np.zeros((1 << SLICE_BITS, size), np.uint8)
    for r in sums.select("slice", "blob").repartition(TASKS, "slice").mapInArrow(add, "slice int, ranks binary").collect():
        table[r["slice"]] = np.frombuffer(bytes(r["ranks"]), np.uint8)
    table = table.ravel()
    return Ranks(table, bits, int(np.exp2(np.median(table) / STEPS)))


def parts_for(df: DataFrame, total: int, each: int) -> int:
    """Partitions for ``total`` items with at most some ``each`` in one: at least the session's shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // each))


def total_of(stored: DataFrame, column: str) -> int:
    return int(stored.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0])


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Marks:
    """Which items were marked: a bit a place, of which there are at most 2^29. Others may share a place: it lets more through, never less."""

    table: np.ndarray
    bits: int

    def has(self, items: np.ndarray) -> np.ndarray:
        at = (_stirred(items) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def marks(rows: DataFrame, items_of: Callable[[pa.RecordBatch], np.ndarray], finest: int = 29) -> Marks:
    """Marks of the items (64-bit hashes) of ``rows``, with some 16 places a row while the bound allows; slices of them come to the driver."""
    bits = min(finest, max(COARSEST, (16 * rows.count()).bit_length()))
    width = bits - SLICE_BITS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_stirred(items_of(batch)) >> np.uint64(64 - bits))
            cut = np.searchsorted(at >> np.uint64(width), np.arange((1 << SLICE_BITS) + 1))
            found = [(i, put(at[a:b] & np.uint64((1 << width) - 1))) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.binary())], names=["slice", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(i, np.zeros(1 << width, bool))[take(blob.as_py())[0].astype(np.int64)] = True
        blobs = [np.packbits(x).tobytes() for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "blob"])

    table = np.zeros((1 << SLICE_BITS, 1 << (width - 3)), np.uint8)
    sent = rows.mapInArrow(send, "slice int, blob binary").repartition(TASKS, "slice")
    for r in sent.mapInArrow(add, "slice int, blob binary").collect():
        table[r["slice"]] = np.frombuffer(bytes(r["blob"]), np.uint8)
    return Marks(table.ravel(), bits)
